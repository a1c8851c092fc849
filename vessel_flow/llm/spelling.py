"""Spelling variants by blocked Gram matrices.

Two words one edit apart have letter counts that differ by one (a letter put in
or left out) or by one up and one down (a letter replaced): the squared
distance of their count vectors is at most two, and their lengths are equal or
adjacent.  For a block of words with count matrix X the product X X' (numpy)
gives all squared distances of the block at once; pairs at one or two are kept
and their edit is verified on the words.

Blocks stay small without losing a pair.  Take the shorter word of a pair, of
length s, and halve it: the edit lies behind the first half or before the
second, so the words share the first s/2 letters or the last s - s/2.  A word
therefore joins the blocks of its own length and of the length below, each
under its first and under its last half; a block holds words of lengths s and
s + 1 with one half in common.  A block of more than ``block`` words is halved
again in the part that is not yet common, until it fits or only a letter is
left, where a block has no more words than letters and pairs of letters.  So
no block grows with the vocabulary.

Words are counted by partial aggregates, so a frequent word is no hot key.
A form has at least ``times`` the count of its variant, hence chains of forms
are short (the counts rise by that factor each time); roots are found by
doubling the step.

Defined cases: a null text has no words; a null id reads as an empty one in
the hash that damages words; ties between forms go to the smallest word in code
point order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

NOT_LETTER = r"[^A-Za-zÀ-ÿ]+"
A_Z, A_Z_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Params:
    length: int = 7  # code points a word has at least
    count: int = 2  # occurrences it has at least
    times: int = 10  # a form has so many times its variant's count
    damage: int = 31  # of the occurrences whose hash it divides a letter is removed; 0: none
    block: int = 1024  # words compared in one product at most
    tile: int = 256  # rows of small blocks that are multiplied together


def words(docs: DataFrame, params: Params) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    run = F.col("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.filter(
        F.split(F.translate("text", A_Z, A_Z_LOW), NOT_LETTER),
        lambda x: F.char_length(x) >= params.length)).alias("run"))
    if params.damage:
        h = F.crc32(F.concat("id", F.lit(":"), run))
        at = F.pmod("h", F.char_length(run)).cast("int")
        runs = runs.withColumn("h", h).select(F.when(
            F.col("h") % params.damage == 0,
            F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run).alias("run"))
    return (runs.groupBy(run.alias("word")).agg(F.count(F.lit(1)).alias("n"))
            .where((F.char_length("word") >= params.length) & (F.col("n") >= params.count)))


def _halves(rows: DataFrame) -> DataFrame:
    """The rows (word, s, head, tail) under both halves of the part of ``s``
    letters of which ``head`` first and ``tail`` last ones are common."""
    half = "((s - head - tail) div 2)"
    first = rows.withColumn("head", F.expr(f"head + {half}"))
    last = rows.withColumn("tail", F.expr(f"s - head - {half}"))
    return first.unionByName(last).select("word", "s", "head", "tail", F.xxhash64(
        "s", "head", "tail", F.expr("substr(word, 1, head)"), F.expr("right(word, tail)")).alias("key"))


def blocks(vocabulary: DataFrame, params: Params) -> DataFrame:
    """(key, s, word): the words of every block."""
    size = F.char_length("word")
    rows = vocabulary.select("word", F.explode(F.array(size, size - 1)).alias("s"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    rows = common.stored(_halves(rows), "spelling-blocks")
    done = None
    while True:
        sizes = rows.groupBy("key").agg(
            F.count(F.lit(1)).alias("size"), F.min(F.expr("s - head - tail")).alias("open"),
            F.min(F.char_length("word")).alias("short"), F.max("s").alias("s"))
        sizes = sizes.where("size > 1 and short = s")  # a pair needs a word of the shorter length
        large = (F.col("size") > params.block) & (F.col("open") > 1)
        fit = rows.join(sizes.where(~large).select("key"), "key", "left_semi").select("key", "s", "word")
        done = fit if done is None else done.unionByName(fit)
        wide = sizes.where(large).select("key")
        if wide.isEmpty():
            return done
        rows = common.stored(_halves(rows.join(wide, "key", "left_semi").select("word", "s", "head", "tail")),
                             "spelling-blocks")


def one_edit(a: str, b: str) -> bool:
    """Exactly one letter put in, left out or replaced; len(a) <= len(b)."""
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1:] == b[k + 1:] and a != b if len(a) == len(b) else a[k:] == b[k + 1:]


def gram_pairs(words: list[str], block: np.ndarray, s: np.ndarray) -> list[tuple[str, str]]:
    """Pairs of words of one block (``block`` numbers them) one edit apart, the
    first of length ``s``, the second of that or one more."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(words)), size) * 256 + letters, minlength=256 * len(words))
    counts = counts.reshape(len(words), 256)
    counts = counts[:, counts.any(axis=0)].astype(np.float64)  # exact: counts are far below 2^26
    square = np.einsum("ij,ij->i", counts, counts)
    shorter = np.flatnonzero(size == s)
    apart = square[shorter, None] + square[None, :] - 2 * (counts[shorter] @ counts.T)
    near = (apart >= 1) & (apart <= 2) & (block[shorter, None] == block[None, :])
    out = []
    for i, j in zip(*np.nonzero(near)):
        a, b = shorter[i], j
        if (size[a] < size[b] or words[a] < words[b]) and one_edit(words[a], words[b]):
            out.append((words[a], words[b]))
    return out


def near_words(vocabulary: DataFrame, params: Params) -> DataFrame:
    """(a, b): each pair of words one edit apart, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str]] = []  # whole blocks, then the one that goes on

        def pairs(rows: list[tuple[int, int, str]]) -> list[tuple[str, str]]:
            key, s, word = zip(*rows)
            number = np.unique(np.array(key, np.int64), return_inverse=True)[1]
            return gram_pairs(list(word), number, np.array(s, np.int64))

        def give(found: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.string()) for k in (0, 1)], ["a", "b"])

        begin = 0  # of the last block in held
        for b in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[-1][0] != row[0]:
                    if len(held) >= params.tile:
                        found += pairs(held)
                        held = []
                    begin = len(held)
                held.append(row)
                if begin and len(held) - begin > params.tile:  # a large block alone
                    found += pairs(held[:begin])
                    held, begin = held[begin:], 0
            yield give(found)
        if held:
            yield give(pairs(held))

    rows = blocks(vocabulary, params)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, "key").sortWithinPartitions("key").select("key", "s", "word")
            .mapInArrow(run, "a string, b string").distinct())


def _roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) without cycles -> (word, root)."""
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = common.stored(steps.join(on, "root", "left"), "spelling-roots")
        steps = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.where("next is not null").isEmpty():
            return steps


def variants(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = common.stored(words(docs, params), "spelling-words")
    pairs = common.stored(near_words(vocabulary.select("word"), params), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counts = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # the most frequent near word, the smallest of several
    near = (both.join(counts, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")))
    found = common.stored(
        vocabulary.join(near, "word", "left")
        .withColumn("form_n", F.when(-F.col("best.less") >= params.times * F.col("n"), -F.col("best.less")))
        .select("word", F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form"), "n",
                F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"), "spelling-forms")
    roots = _roots(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
