"""Benchmark decontamination by winnowing, with built-in functions only.

Of every ``W`` consecutive ``K``-word hashes the smallest is kept as a
fingerprint (the leftmost of equal ones).  Two texts that share
``K + W - 1 = WINDOW`` consecutive words therefore share a fingerprint at the
same place of the shared words.  Fingerprints of documents and benchmark items
are joined; each hit is extended to all windows of ``WINDOW`` words around it,
which are compared word for word with the benchmark's windows.

Items of fewer words than a window are one window of their own length; for the
lengths that occur (at most ``WINDOW - 1``), all hashes of that many words are
joined instead.

Only fingerprints, not texts, take part in the first join; texts are read
again for rows with a hit.  The benchmark's tables are written, so that Spark
knows their size and broadcasts them only below its threshold.

Defined cases: null and empty texts have no words; an item without words has
no window; a null item id is listed as "null"; rows equal in id and text share
a result; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common
from .spans import let, words

K, W = 5, 6
WINDOW = K + W - 1
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.translate(w, UPPER, LOWER))


_FINGERPRINT = "struct<hash:long,at:int,length:int>"


def _at_places(h: Column, places: Column, k: int, length: int) -> Column:
    """The 64-bit hashes of the k words from each place."""
    return F.transform(places, lambda i: F.struct(
        F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("hash"), i.alias("at"), F.lit(length).alias("length")))


def _of_length(h: Column, length: int) -> Column:
    n = F.size(h)
    if length < WINDOW:
        return F.when(n >= length, _at_places(h, F.sequence(F.lit(0), n - length), length, length))
    # K words' hash in the high half of a long and the place in the low half: of equal hashes the leftmost is smallest
    grams = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.shiftleft(
        F.hash(*[F.get(h, i + j) for j in range(K)]).cast("long"), 32) + i)
    chosen = let(grams, lambda g: F.array_distinct(F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.least(*[F.get(g, i + j) for j in range(W)]))))
    places = F.transform(chosen, lambda x: x.bitwiseAND(0xFFFFFFFF).cast("int"))
    return F.when(n >= WINDOW, _at_places(h, places, K, length))


def fingerprints(tokens: Column, lengths: list[int]) -> Column:
    """Of all ``lengths``: winnowed hashes for a whole window, all hashes of that
    many words for a shorter one.  Words that are equal after lower-casing A-Z
    have equal hashes."""
    none = F.array().cast(f"array<{_FINGERPRINT}>")
    return let(F.transform(tokens, lambda w: F.xxhash64(F.lower(w))), lambda h: F.concat(
        *[F.coalesce(_of_length(h, length), none) for length in lengths]))


def _exploded(rows: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """One row a fingerprint: hash, at, length.  The words are split once for
    all lengths."""
    tokens = words(F.coalesce("text", F.lit("")))
    return rows.select(*keep, F.explode(fingerprints(tokens, lengths)).alias("f")).select(*keep, "f.*")


def hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """key -> n_hit, items: hit words and sorted item ids of contaminated rows."""
    items = common.stored(
        bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                     F.col(item_text_col).alias("text")).withColumn("words", exact(words(F.coalesce("text", F.lit("")))))
        .where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(WINDOW))), "bench-items")
    windows = common.stored(
        items.select("item", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("words") - F.col("length")),
            lambda i: F.array_join(F.slice("words", i + 1, F.col("length")), " "))).alias("window"))
        .groupBy("window").agg(F.collect_set("item").alias("items")), "bench-windows")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most WINDOW values

    rows = docs.select(common.row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    if not lengths:
        return docs.sparkSession.createDataFrame([], "key long, n_hit long, items array<string>")
    # an item has fingerprints of its own length only
    own = _exploded(items.withColumnRenamed("length", "own"), lengths, "own").where("length = own")
    table = common.stored(own.select("hash", "length").distinct(), "bench-fingerprints")
    found = _exploded(rows, lengths, "key").join(table, ["hash", "length"], "left_semi").select("key", "at", "length")
    near = common.stored(found.groupBy("key").agg(F.collect_set(F.struct("at", "length")).alias("found")),
                         "winnow-hits")

    def around(x: Column) -> Column:
        """Windows that may hold a fingerprint: up to W - 1 words before it."""
        back = F.when(x["length"] == WINDOW, W - 1).otherwise(0)
        last = F.least(x["at"], F.size("words") - x["length"])
        return F.transform(F.sequence(F.greatest(x["at"] - back, F.lit(0)), last),
                           lambda i: F.struct(i.alias("at"), x["length"].alias("length")))

    spread = (rows.join(near, "key").select("key", "found", exact(words(F.coalesce("text", F.lit("")))).alias("words"))
              .select("key", F.explode(let(F.col("words"), lambda ws: F.transform(
                  F.array_distinct(F.flatten(F.transform("found", around))),
                  lambda x: F.struct(x["at"].alias("at"), x["length"].alias("length"),
                                     F.array_join(F.slice(ws, x["at"] + 1, x["length"]), " ").alias("window"))))).alias("x"))
              .select("key", "x.*"))
    return (spread.join(windows, "window")
            .groupBy("key").agg(F.collect_set(F.struct("at", "length")).alias("at"),
                                F.collect_set("items").alias("items"))
            .select("key", F.size(F.array_distinct(F.flatten(F.transform(
                "at", lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1))))).cast("long").alias("n_hit"),
                F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each row of ``docs``."""
    none = F.array().cast("array<string>")
    return (docs.select(F.col(id_col).alias("doc_id"), common.row_key(F.col(id_col), F.col(text_col)).alias("key"),
                        F.size(words(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("n_words"))
            .join(hits(docs, bench, id_col, text_col), "key", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns."""
    bad = hits(docs, bench, id_col, text_col).select(F.col("key").alias("__key"))
    return (docs.withColumn("__key", common.row_key(F.col(id_col), F.col(text_col)))
            .join(bad, "__key", "left_anti").drop("__key"))
