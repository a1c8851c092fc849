"""Substring deduplication by recompression.

A text's words are parsed into symbols in rounds.  The first round names runs
of one word, each later one pairs: a symbol's class, left or right, is a bit of
its hashed name, and a left symbol that stands before a right one becomes one
new symbol with it.  A name is a hash of what the symbol stands for, so every
task of the cluster gives equal parts the same name without a dictionary.

Of a stretch of ``window`` words the inner symbols do not depend on the words
around it.  ``interior`` follows, round by round, how far that holds: the
outermost run may go on outside, a right symbol at the left border may belong
to a symbol outside, and so may a left one at the right border; all others are
the same wherever the stretch occurs.  The widest inner symbol stands for the
stretch, and a stretch without one (it consists of one or two runs) stands for
itself.  Stretches beside each other mostly have the same widest symbol.

* Whole texts first: texts with the same words have the same digest.  Of each
  such group the row with the smallest id goes on; all windows of the others
  start earlier there.
* Round 1 in Spark: how often does each chosen symbol occur?  Equal stretches
  have the same symbol, so what occurs once holds no repeat and is left alone.
* Round 2: stretches of shared symbols are compared whole, by a hash of all
  their words beside the symbol's name (96 bits), and those that also start
  earlier (smaller id, then smaller start) are told.  Each task first tells
  the repeats among its own stretches and hands on one row for each different
  stretch, so a frequent one has at most as many rows as there are tasks.

Lists are never longer than a document.

Defined cases: a null text has no words; fewer words than a window are kept;
a null id comes before all others; rows of one id are one document, whose equal
starts are not earlier than each other, and equal rows have equal results; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .repetition import WordHashes, ngram_hashes

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64((1 << 56) - 1)


@dataclass(frozen=True)
class Params:
    window: int = 20
    rounds: int = 3  # of pairs; symbols stand for 2^rounds words at most, or runs
    block: int = 200_000  # words parsed at once
    held: int = 2_000_000  # stretches of a task that are compared at once


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split() splits at exactly \t..\r and space


def run_symbols(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, starts) of the maximal runs of equal words."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    return mix(h[start] + np.diff(np.append(start, len(h))).astype(np.uint64) * _B), start


def is_left(name: np.ndarray, level: int) -> np.ndarray:
    return mix(name + _A * np.full(1, level, np.uint64)) & np.uint64(1) == 0


def pair_symbols(name: np.ndarray, start: np.ndarray, doc: np.ndarray,
                 left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols once every left one is joined with a right one behind it."""
    joined = np.zeros(len(name), bool)
    joined[:-1] = left[:-1] & ~left[1:] & (doc[start[1:]] == doc[start[:-1]])
    out = name.copy()
    at = np.flatnonzero(joined)
    out[at] = mix(mix(name[at]) + name[at + 1])
    keep = np.ones(len(name), bool)
    keep[at + 1] = False
    return out[keep], start[keep]


def interior(h: np.ndarray, doc: np.ndarray, at: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """For each window (starting at ``at``) the widest inner symbol, the
    leftmost of several: width and 56 bits of its name, and its place; without
    one 0 and the window's own place."""
    n = len(h)
    name, start = run_symbols(h, doc)
    index = np.zeros(n, np.int64)
    index[start] = 1
    index = np.cumsum(index) - 1  # word -> its run
    ends = np.append(start, n)
    lo, hi = ends[index[at] + 1], start[index[at + params.window - 1]]
    alive = np.flatnonzero(lo < hi)
    lo, hi = lo[alive], hi[alive]
    place = np.zeros(n + 1, np.int64)  # border -> number of the symbol that begins there
    for level in range(1, params.rounds + 1):
        left = is_left(name, level)
        place[start] = np.arange(len(start))
        place[n] = len(start)
        ends = np.append(start, n)
        first, last = place[lo], place[hi] - 1
        lo = np.where(left[first], lo, ends[first + 1])
        hi = np.where(left[last], start[last], hi)
        inside = lo < hi
        alive, lo, hi = alive[inside], lo[inside], hi[inside]
        name, start = pair_symbols(name, start, doc, left)

    width = np.minimum(np.diff(np.append(start, n)), 255).astype(np.uint64)
    value = np.zeros(n + 1, np.uint64)
    value[start] = (width << np.uint64(56)) | (name & _LOW)
    out, where = np.zeros(len(at), np.uint64), at.copy()
    best = np.arange(n + 1)  # best[p]: leftmost place of the largest value among p .. p + reach - 1
    better = lambda x, y: np.where(value[x] >= value[y], x, y)
    reach, size = 1, hi - lo
    while len(alive):
        here = (size >= reach) & (size < 2 * reach)
        where[alive[here]] = better(best[lo[here]], best[hi[here] - reach])
        if size.max(initial=0) < 2 * reach:
            break
        best = better(best, np.append(best[reach:], np.full(reach, n)))
        reach *= 2
    out[alive] = value[where[alive]]
    return out, where


def _blocks(texts: pa.Array, hashes: WordHashes, limit: int) -> Iterator[tuple[int, int, list[list[bytes]], np.ndarray]]:
    """(from, to, words of each text, hashes of all words) of runs of texts."""
    since, words, total = 0, [], 0
    for i, t in enumerate(texts):
        words.append(split(t.as_py()))
        total += len(words[-1])
        if total >= limit or i + 1 == len(texts):
            flat = [w for x in words for w in x]
            yield since, i + 1, words, np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
            since, words, total = i + 1, [], 0


def _windows(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts behind each other: text of each word, first words of the texts,
    starts of all windows."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    base = np.cumsum(sizes) - sizes
    here = np.arange(len(doc)) - base[doc]
    return doc, base, np.flatnonzero(here + window <= sizes[doc])


def parse(docs: DataFrame, params: Params) -> DataFrame:
    """(doc_id, key, n_words, sha, at, name) of every row: the symbols that
    stand for its windows, each from window ``at`` to the next one's.  A text
    whose words the task has met before has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in batches:
            for lo, hi, words, h in _blocks(b.column(2), hashes, params.block):
                sizes = np.array([len(w) for w in words], np.int64)
                doc, base, at = _windows(sizes, params.window)
                sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
                new = np.ones(len(sha), bool)
                for i, x in enumerate(sha):
                    new[i] = x not in seen
                    seen.add(x)
                if len(seen) > 500_000:
                    seen.clear()
                at = at[new[doc[at]]]
                cuts = np.zeros(0, np.int64)
                name = np.zeros(0, np.uint64)
                if len(at):
                    name, where = interior(h, doc, at, params)
                    alone = np.flatnonzero(name == 0)
                    if len(alone):
                        name[alone] = mix(ngram_hashes(h, params.window)[at[alone]]) & _LOW
                    new = np.ones(len(at), bool)
                    new[1:] = (where[1:] != where[:-1]) | (name[1:] != name[:-1])
                    cuts, name = at[new], name[new]
                ends = np.searchsorted(doc[cuts] if len(cuts) else cuts, np.arange(len(sizes) + 1)).astype(np.int32)
                starts = (cuts - base[doc[cuts]] if len(cuts) else cuts).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(sizes),
                    pa.array(sha, pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(starts)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(name.view(np.int64)))],
                    ["doc_id", "key", "n_words", "sha", "at", "name"])

    return docs.select("doc_id", "key", "text").mapInArrow(
        run, "doc_id long, key long, n_words long, sha string, at array<int>, name array<long>")


def _stretches(docs: DataFrame, lists: DataFrame, params: Params) -> DataFrame:
    """(key, doc_id, at, hash, check, late) of the windows of shared symbols.
    ``lists`` has ``doc_id`` and the lists at, till, name for each key; ``late``
    tells that the task holds the same window with an earlier place."""
    kinds = [("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("hash", pa.int64()), ("check", pa.int32())]

    def told(parts: list[tuple]) -> pa.RecordBatch:
        """Rows of several blocks: (keys, documents, whether they are known) of
        the texts, and text, start, hash and check of each stretch."""
        sizes = [len(p[0]) for p in parts]
        key, doc, known, row, at, h, check = (np.concatenate(c) for c in zip(*parts))
        row = row + np.repeat(np.cumsum(sizes) - sizes, [len(p[3]) for p in parts])
        # places as one number: the document's rank (an unknown one comes first), then the start
        rank = np.where(known, np.unique(doc, return_inverse=True)[1] + 1, 0)
        place = (rank[row] << 32) | at
        order = np.lexsort((place, h))
        here, hash_, check_ = place[order], h[order], check[order]
        same = (hash_[1:] == hash_[:-1]) & (check_[1:] == check_[:-1])
        first = np.concatenate([[0], np.flatnonzero(~same) + 1])[np.concatenate([[0], np.cumsum(~same)])]
        late = np.zeros(len(order), bool)
        late[order] = here != here[first]
        columns = [pa.array(key[row]), pa.array(doc[row], mask=~known[row]), pa.array(at), pa.array(h), pa.array(check), pa.array(late)]
        return pa.RecordBatch.from_arrays(columns, [*(k for k, _ in kinds), "late"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, parts, held = WordHashes(), set(), [], 0
        for b in batches:
            keys = b.column(0).to_pylist()
            new = np.ones(len(keys), bool)
            for i, k in enumerate(keys):  # equal rows
                new[i] = k not in seen
                seen.add(k)
            if len(seen) > 500_000:
                seen.clear()
            b = b.filter(pa.array(new))
            known = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            key, doc = b.column(0).to_numpy(), b.column(1).fill_null(0).to_numpy()
            for lo, hi, words, h in _blocks(b.column(2), hashes, params.block):
                base = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1]
                at, till, name = (b.column(c).slice(lo, hi - lo) for c in (3, 4, 5))
                runs = np.diff(at.offsets.to_numpy())
                at, till, name = (x.flatten().to_numpy() for x in (at, till, name))
                size = (till - at).astype(np.int64)
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = np.repeat(at, size) + within
                row = np.repeat(np.repeat(np.arange(hi - lo), runs), size)
                full = mix(ngram_hashes(h, params.window))
                parts.append((key[lo:hi], doc[lo:hi], known[lo:hi], row, start.astype(np.int32),
                              full[base[row] + start].view(np.int64), np.repeat(name.astype(np.int32), size)))
                held += len(start)
                if held > params.held:
                    yield told(parts)
                    parts, held = [], 0
        if parts:
            yield told(parts)

    return (docs.join(lists, "key").select("key", lists["doc_id"], "text", "at", "till", "name")
            .mapInArrow(run, "key long, doc_id long, at int, hash long, check int, late boolean"))


def _joined(flagged: DataFrame, params: Params) -> DataFrame:
    """(key, start, till): the stretches that repeated windows (key, at) cover,
    lists for each key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (at[1:] > at[:-1] + params.window)
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(key)) - 1
            of = key[start]
            rows = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            lists = pa.array(np.append(rows, len(of)).astype(np.int32))
            return pa.RecordBatch.from_arrays([
                pa.array(of[rows]), pa.ListArray.from_arrays(lists, pa.array(at[start])),
                pa.ListArray.from_arrays(lists, pa.array(at[end] + np.int32(params.window)))], ["key", "start", "till"])

        key, at = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for b in batches:
            key, at = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([at, b.column(1).to_numpy()])
            if len(key):  # the last document may go on
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield give(key[:cut], at[:cut])
                key, at = key[cut:], at[cut:]
        if len(key):
            yield give(key, at)

    n = int(flagged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (flagged.repartition(n, "key").sortWithinPartitions("key", "at")
            .mapInArrow(run, "key long, start array<int>, till array<int>"))


def _without(docs: DataFrame, stretches: DataFrame, texts: bool) -> DataFrame:
    """(key, n_removed, kept_sha256[, kept]) of the rows of which something is
    removed; ``stretches`` as ``_joined`` gives them."""
    kinds = [("key", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
    kinds = kinds if texts else kinds[:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text, start, till in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words, since, parts, gone = split(text.as_py()), 0, [], 0
                for lo, hi in zip(start, till):
                    parts += words[since:lo]
                    since, gone = hi, gone + hi - lo
                kept = b" ".join(parts + words[since:])
                rows.append((key, gone, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] if texts else [])))
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], [k for k, _ in kinds])

    return (docs.join(stretches, "key").select("key", "text", "start", "till")
            .mapInArrow(run, "key long, n_removed long, kept_sha256 string" + ", kept string" * texts))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       common.row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def repeats(docs: DataFrame, parsed: DataFrame, firsts: DataFrame, params: Params) -> DataFrame:
    """(key, start, till): the stretches of each chosen row that start earlier
    elsewhere.  ``firsts`` has the key and the document of the chosen rows."""
    runs = F.expr("""transform(sequence(0, size(at) - 1), i -> struct(at[i] as at,
        if(i + 1 < size(at), at[i + 1], cast(n_words - {0} + 1 as int)) as till, name[i] as name))""".format(params.window))
    occurs = (parsed.where(F.size("at") > 0).join(firsts.select("key", F.col("doc_id").alias("first")), "key")
              .select("key", "first", F.explode(runs).alias("run")).select("key", "first", "run", F.col("run.name").alias("name")))
    # each place of a symbol in a row is a run of its own
    shared = occurs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    lists = (occurs.join(shared, "name").groupBy("key").agg(F.first("first").alias("doc_id"), F.collect_set("run").alias("runs"))
             .select("key", "doc_id", F.col("runs.at"), F.col("runs.till"), F.col("runs.name")))
    windows = common.stored(_stretches(docs, common.stored(lists, "recompression-runs"), params), "recompression-windows")
    # a row for each different window of a task
    places = Window.partitionBy("hash", "check").orderBy("doc_id", "at")
    later = windows.where(~F.col("late")).withColumn("rank", F.rank().over(places)).where("rank > 1")
    flagged = windows.where("late").select("key", "at").unionByName(later.select("key", "at"))
    return common.stored(_joined(flagged, params), "recompression-repeats")


def dedup(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text",
          texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` once
    all words inside repeated windows are removed; with ``texts`` also ``kept``,
    the words that stay, joined by blanks."""
    docs = _source(docs, id_col, text_col)
    parsed = common.stored(parse(docs, params), "recompression-symbols")
    firsts = common.stored(parsed.groupBy("sha").agg(
        F.min(F.struct("doc_id")).alias("first"), F.max_by("key", F.size("at")).alias("key"))
        .select("sha", "first.doc_id", "key"), "recompression-firsts")
    changed = _without(docs, repeats(docs, parsed, firsts, params), texts)
    changed = changed.groupBy("key").agg(*[F.first(c).alias(c) for c in changed.columns if c != "key"])
    chosen = firsts.select("sha", F.col("doc_id").alias("first"), "key").join(changed, "key", "left").drop("key")
    own = F.col("doc_id").eqNullSafe(F.col("first"))
    whole = ~own & (F.col("n_words") >= params.window)  # all of it stands in the group's first text
    out = parsed.select("doc_id", "key", "n_words", "sha").join(chosen, "sha").select(
        "doc_id", "key", "n_words",
        F.when(whole, F.col("n_words")).when(own, F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).when(own, F.col("kept_sha256")).alias("kept_sha256"), "sha",
        *([F.when(whole, F.lit("")).when(own, F.col("kept")).alias("kept")] if texts else []))
    out = (out.withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
           .withColumn("kept_sha256", F.coalesce("kept_sha256", "sha")).drop("sha"))
    if not texts:
        return out.drop("key")
    plain = F.array_join(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""), " ")
    source = docs.select("key", plain.alias("plain")).dropDuplicates(["key"])
    return out.join(source, "key").withColumn("kept", F.coalesce("kept", "plain")).drop("key", "plain")
