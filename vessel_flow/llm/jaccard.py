"""N-gram Jaccard join by parity sketches.

A document is its set of word shingles.  Two sets of sizes a and b with Jaccard
similarity t or more differ in at most ``(1 - t) / (1 + t) * (a + b)``
shingles.  Shingles are XOR-hashed into a sketch of S segments, and a shingle
that only one set holds changes one segment, so the number of unlike segments
never exceeds the symmetric difference.

* Size bands: a set joins in its own band and, where a partner 1/t times its
  size lies in the next one, in that too.  A band's largest difference D gives
  S = D + 1 + spare segments.
* Pigeonhole: linked sets agree in at least ``spare + 1`` segments.  A set
  with at most ``spare`` empty segments therefore agrees with each partner in
  one that is not empty, and only those become join keys; a set with more
  empty ones joins on these too.  No link is lost.
* Prefix: the more segments linked sets must agree in, the more keys a set can
  leave out.  With e empty segments it agrees with each partner in at least
  ``spare + 1 - e`` that are not empty.  Each set leaves out the ``spare - e``
  keys that most sets share (ties by key, one order for all sets): of the keys
  that two linked sets share, both leave out only the widest, and the least
  wide one stays with both.  So a passage that many documents hold makes no
  candidates.
* Verification: pairs that share a key are first tested by a bit sketch of
  about a bit a shingle, whose Hamming distance also bounds the difference
  from below, then by their exact sets.

Equal sets are one node from the start.  Components are built in rounds, so
that large groups are never expanded into all pairs.  The candidates of a set are
the smallest and the largest set of each of its keys.  First every set is
compared with the candidate that it shares most keys with; then with those in
other components; last, pairs of sets that share a key and still lie in
different components are tested by their bit sketches, in numpy blocks of at
most ``tile`` by ``tile`` sets: first the nearest pair of each two components
becomes a row and is verified, then, in blocks with more, all that pass between
components that are still apart.

Defined cases: a null text, or one without words, has no shingles and is
linked with nothing; fewer words than a shingle are one shingle; rows equal in
id and text are one group; a null id never names a group unless all its ids
are null.  Sets are named by a 64-bit hash of their sorted shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .components import components
from .repetition import WordHashes, ngram_hashes

_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80  # linked if 100 * intersection >= percent * union
    filter_bits: int = 24  # of the bitmap that picks texts to verify
    tile: int = 1024  # sets of one key that are compared in one task at most

    def differ(self, total: int) -> int:
        """Largest symmetric difference of linked sets with ``total`` members."""
        return (100 - self.percent) * total // (100 + self.percent)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(words))
    return np.unique(mix(ngram_hashes(h, k) ^ np.uint64(k)))


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Bands:
    """Size bands and the segments of their sketches."""

    def __init__(self, params: Params):
        self.params = params
        self.bounds = [1]

    def of(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self.bounds.append(max(self.bounds[-1] + 1, self.bounds[-1] * 3 // 2))
        return int(np.searchsorted(self.bounds, size, side="right")) - 1

    def segments(self, band: int) -> tuple[int, int]:
        """(S, spare) of a band; (0, 0) where only equal sets are linked."""
        self.of(self.bounds[min(band, len(self.bounds) - 1)])
        while len(self.bounds) <= band + 1:
            self.of(self.bounds[-1])
        most = self.params.differ(2 * (self.bounds[band + 1] - 1))
        # more spare segments than the smallest sets of a band are likely to leave empty
        spare = max(-(-3 * (most + 1) // 10), min(2 * (most + 1), 8))
        return (most + 1 + spare, spare) if most else (0, 0)

    def keys(self, s: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Join keys of a set in each band that it joins, one for each segment,
        and their tag: twice the number of keys that it can leave out in the
        band (-1: none, its empty segments are used), plus 1 for the next band."""
        out = []
        for k, band in enumerate(range(self.of(len(s)), self.of(len(s) * 100 // self.params.percent) + 1)):
            total, spare = self.segments(band)
            if not total:
                continue
            seg = ((s >> np.uint64(32)) * np.uint64(total)) >> np.uint64(32)
            at = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1])
            salt = mix(seg[at] + np.uint64((band + 1) << 32))
            keys = mix(np.bitwise_xor.reduceat(mix(s + np.uint64(1)), at) ^ salt)
            left = max(-1, spare - (total - len(at)))
            if left < 0:
                empty = np.setdiff1d(np.arange(total, dtype=np.uint64), seg[at])
                keys = np.concatenate([keys, mix(mix(empty + np.uint64((band + 1) << 32)))])
            out.append((keys, 2 * left + k))
        return out


#: The fine sketch has so many bits for each one of the plain sketch: a pair that it does not part is nearly linked.
FINE = 4


def sketch(s: np.ndarray, times: int = 1) -> np.ndarray:
    """Parity bits, at least ``times`` a shingle; the number of longs is a power
    of two, so that a longer sketch folds onto a shorter one by XOR of its halves."""
    size = 64 * times * max(4, 1 << (max(len(s) - 1, 1) // 64).bit_length())
    bits = mix(s ^ np.uint64(0x5EED)) & np.uint64(size - 1)
    return np.packbits(np.bincount(bits.astype(np.int64), minlength=size) & 1).view(np.int64)


def fold(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


def _lists(parts: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, kind)))


def parse(docs: DataFrame, params: Params) -> DataFrame:
    """(doc_id, k, n, sid, sketch, fine, bands) of every row; sid is null and
    the sketches are empty without shingles.  ``bands`` holds the join keys of the set, with
    their tag; a set that the task has met before needs none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands, seen = WordHashes(), Bands(params), set()
        none = np.zeros(0, np.int64)
        for b in batches:
            n, sids, plain, fine, keys, tags, counts, held, since = [], [], [], [], [], [], [], 0, 0
            for i, t in enumerate(b.column(2)):
                s = shingles(t.as_py(), hashes, params.words)
                n.append(len(s))
                sid = set_id(s) if len(s) else None
                sids.append(sid)
                long = sketch(s, FINE) if len(s) else none
                plain.append(fold(long, len(long) // FINE))
                fine.append(long.tobytes() if len(s) else None)
                found = []
                if len(s) and sid not in seen:
                    if len(seen) > 500_000:  # equal sets that come later are found again after the exchange
                        seen.clear()
                    seen.add(sid)
                    found = bands.keys(s)
                counts.append(len(found))
                for k, tag in found:
                    keys.append(k.view(np.int64))
                    tags.append(tag)
                    held += len(k)
                if held > 200_000 or i + 1 == len(b):
                    each = pa.StructArray.from_arrays([pa.array(tags, pa.int32()), _lists(keys, np.int64)], ["tag", "keys"])
                    ends = pa.array(np.cumsum([0, *counts]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0)[since:i + 1], b.column(1)[since:i + 1], pa.array(n, pa.int64()), pa.array(sids, pa.int64()),
                         _lists(plain, np.int64), pa.array(fine, pa.binary()), pa.ListArray.from_arrays(ends, each)],
                        ["doc_id", "k", "n", "sid", "sketch", "fine", "bands"])
                    n, sids, plain, fine, keys, tags, counts, held, since = [], [], [], [], [], [], [], 0, i + 1
    return docs.select("doc_id", "k", "text").mapInArrow(
        run, "doc_id long, k long, n long, sid long, sketch array<long>, fine binary, "
             "bands array<struct<tag: int, keys: array<long>>>")


def shared_keys(parsed: DataFrame) -> DataFrame:
    """(key, sid, tag) of all keys that two or more different sets share."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose key stands in a row beside them; sorted input."""
        last = None  # (key, sid, tag, whether it was given out)
        for b in batches:
            key, sid, tag = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if last is not None:
                key, sid, tag = (np.concatenate([[x], c]) for x, c in zip(last, (key, sid, tag)))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])
            key, sid, tag = key[new], sid[new], tag[new]
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            mask = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            given = bool(last and last[3])
            held = (key[-1], sid[-1], tag[-1], bool(mask[-1]) if len(key) > 1 else given)
            if given:
                mask[0] = False
            last = held
            yield pa.RecordBatch.from_arrays([pa.array(key[mask]), pa.array(sid[mask]),
                                              pa.array(tag[mask].astype(np.int32))], ["key", "sid", "tag"])

    keyed = (parsed.select("sid", F.explode("bands").alias("band"))
             .select(F.explode("band.keys").alias("key"), "sid", "band.tag"))
    return keyed.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(runs, "key long, sid long, tag int")


def needed(keys: DataFrame) -> DataFrame:
    """``keys`` without the widest of each set, as many as it can leave out.
    A window's group is the shared keys of one set in one band."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("sets"))
    widest = Window.partitionBy("sid", "tag").orderBy(F.desc("sets"), "key")
    return (keys.join(sizes, "key").withColumn("rank", F.row_number().over(widest))
            .where("rank > shiftright(tag, 1)").select("key", "sid"))


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of 2^bits bits over the hashes of ``keys``: at most 2^bits / 64
    rows reach the driver.  It only picks texts to read: a bit set by another
    key costs time, never a link."""
    slot = F.pmod(F.xxhash64("k", F.lit("bitmap")), F.lit(1 << bits))
    words = (keys.select((slot / 64).cast("int").alias("w"), (slot % 64).cast("int").alias("b"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("x")).toPandas())
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["x"].to_numpy(np.int64)
    return out


def members(docs: DataFrame, wanted: DataFrame, params: Params) -> DataFrame:
    """(sid, shingles) of the sets of the texts with keys ``wanted``."""
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, params.filter_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in batches:
            rows = []
            for slot, k, t in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)):
                if not held.value[slot >> 6] >> (slot & 63) & 1 or k in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(k)
                s = shingles(t.as_py(), hashes, params.words)
                if len(s):
                    rows.append((set_id(s), s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.binary())], ["sid", "shingles"])

    slot = F.pmod(F.xxhash64("k", F.lit("bitmap")), F.lit(1 << params.filter_bits))
    return (docs.select(slot.alias("slot"), "k", "text")
            .mapInArrow(run, "sid long, shingles binary").dropDuplicates(["sid"]))


def near(pairs: DataFrame, nodes: DataFrame, params: Params) -> DataFrame:
    """Pairs (a, b) that neither their sizes nor their bit sketches part."""
    side = lambda c: nodes.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"),
                                  F.col("sketch").alias(f"s{c}"))
    # partners' sizes are alike, so the longer sketch has at most twice the longs
    fold = lambda x, y: (f"if(size({x}) > size({y}), transform(sequence(0, size({y}) - 1), "  # noqa: E731
                         f"i -> {x}[i] ^ {x}[i + size({y})]), {x})")
    apart = f"aggregate(zip_with({fold('sa', 'sb')}, {fold('sb', 'sa')}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(f"100 * least(na, nb) >= {params.percent} * greatest(na, nb)")
            .where(f"({100 + params.percent}) * ({apart}) <= ({100 - params.percent}) * (na + nb)")
            .select(*pairs.columns))


class _Sketches:
    """Bit sketches of several lengths, compared pair by pair: by number of
    longs, those of that length and those of twice it, folded onto it."""

    def __init__(self, sketches: list[np.ndarray]):
        self.longs = np.fromiter(map(len, sketches), np.int64, len(sketches))
        self.rows, self.place = {}, {}
        for size in np.unique(self.longs).tolist():
            fits = np.flatnonzero((self.longs == size) | (self.longs == 2 * size))
            self.rows[size] = np.stack([fold(sketches[i], size) for i in fits]).view(np.uint64)
            self.place[size] = np.zeros(len(sketches), np.int64)
            self.place[size][fits] = np.arange(len(fits))

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hamming distances of pairs."""
        out, short = np.zeros(len(i), np.int64), np.minimum(self.longs[i], self.longs[j])
        for size, table in self.rows.items():
            at = np.flatnonzero(short == size)
            for part in np.array_split(at, 1 + len(at) * size // 2_000_000):
                p, q = self.place[size][i[part]], self.place[size][j[part]]
                out[part] = np.bitwise_count(table[p] ^ table[q]).sum(axis=1, dtype=np.int64)
        return out

    def all_pairs(self, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) of ``rows`` for which ``keep(i, j, distance)``, tested
        row against row in blocks; i stands before j."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in np.unique(self.longs[rows]).tolist():
            some, table = rows[self.longs[rows] == size], self.rows[size]
            for other in (some, rows[self.longs[rows] == 2 * size]):
                if not len(other):
                    continue
                mine, theirs = table[self.place[size][some]], table[self.place[size][other]]
                step = max(1, 1_000_000 // (len(other) * size))
                for at in range(0, len(some), step):
                    d = np.bitwise_count(mine[at:at + step, None, :] ^ theirs[None, :, :]).sum(axis=2, dtype=np.int64)
                    i, j = some[at:at + step, None], other[None, :]
                    ok = keep(i, j, d)
                    x, y = np.nonzero(ok & (i < j) if other is some else ok)
                    left.append(np.minimum(some[at + x], other[y]))
                    right.append(np.maximum(some[at + x], other[y]))
        return np.concatenate(left), np.concatenate(right)


#: Rows of a block from which on it is compared as a matrix of its own.
LARGE = 128


def block_pairs(block: np.ndarray, side: np.ndarray, root: np.ndarray, n: np.ndarray, fine: list[np.ndarray],
                params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) and fine distances of the pairs inside each block (rows of
    a block stand together) that belong to different components and that neither
    sizes nor bit sketches part.  ``side``: 0 for a block of one tile; of a
    block of two tiles (1 and 2) only pairs across are tested."""
    plain = _Sketches([fold(x, len(x) // FINE) for x in fine])
    allowed = lambda i, j, d: (100 + params.percent) * d <= (100 - params.percent) * (n[i] + n[j])
    apt = lambda i, j: ((root[i] != root[j]) & ((side[i] == 0) | (side[i] != side[j]))
                        & (100 * np.minimum(n[i], n[j]) >= params.percent * np.maximum(n[i], n[j])))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
    small = np.ones(len(block), bool)
    for lo, hi in zip(starts[:-1], starts[1:]):
        if hi - lo >= LARGE:
            small[lo:hi] = False
            i, j = plain.all_pairs(np.arange(lo, hi), lambda i, j, d: allowed(i, j, d) & apt(i, j))
            left.append(i)
            right.append(j)
    rest, step = np.flatnonzero(small), 1
    while step < len(rest):
        i = np.flatnonzero(block[rest[step:]] == block[rest[:-step]])
        if not len(i):
            break
        i, j = rest[i], rest[i + step]
        ok = apt(i, j)
        i, j = i[ok], j[ok]
        ok = allowed(i, j, plain.apart(i, j))
        left.append(i[ok])
        right.append(j[ok])
        step += 1
    i, j = np.concatenate(left), np.concatenate(right)
    d = _Sketches(fine).apart(i, j)
    ok = allowed(i, j, d)
    return i[ok], j[ok], d[ok]


def blocks(members: DataFrame, params: Params) -> DataFrame:
    """(block, side, sid, root, n, fine): the sets of each key, those of a key
    of more than ``params.tile`` sets under each pair of its tiles, so that no
    task holds a whole large key.  ``members``: (key, sets, sid, root, n, fine)."""
    tiles = F.ceil(F.col("sets") / F.lit(params.tile)).cast("int")
    return (members.withColumn("tile", F.pmod(F.xxhash64("sid"), tiles).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
            .select(F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other")).alias("block"),
                    F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2)
                    .alias("side"), "sid", "root", "n", "fine"))


def pairs_in_blocks(dealt: DataFrame, params: Params, every: bool) -> DataFrame:
    """(a, b, block): pairs of sets in a common block and different components
    that may be linked; ``dealt`` as ``blocks`` gives them.

    Pairs are tested in numpy, and only those that pass become rows; unless
    ``every``, only the nearest of a block between any two components, with the
    block's number if there are more (else null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def give(rows: list[tuple]) -> pa.RecordBatch:
            block, side, sid, root, n = (np.array(c, np.int64) for c in list(zip(*rows))[:5])
            i, j, d = block_pairs(block, side, root, n, [np.frombuffer(r[5], np.int64) for r in rows], params)
            more = np.ones(len(i), bool)
            if not every:
                p, q = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
                order = np.lexsort((d / (n[i] + n[j]), q, p, block[i]))
                i, j, p, q = i[order], j[order], p[order], q[order]
                new = np.ones(len(i), bool)
                new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | (block[i[1:]] != block[i[:-1]])
                at = np.flatnonzero(new)
                more = np.diff(np.append(at, len(i))) > 1
                i, j = i[at], j[at]
            a, b = np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(block[i], mask=~more)], ["a", "b", "block"])

        begin = 0  # of the last block in held
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] != row[0]:
                    if len(held) >= 4 * params.tile:
                        yield give(held)
                        held = []
                    begin = len(held)
                held.append(row)
                if begin and len(held) - begin > 2 * params.tile:
                    yield give(held[:begin])
                    held, begin = held[begin:], 0
        if held:
            yield give(held)

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, "a long, b long, block long")


def linked(pairs: DataFrame, shingled: DataFrame, params: Params) -> DataFrame:
    """The pairs (a, b) whose exact sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= params.percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: shingled.select(F.col("sid").alias(c), F.col("shingles").alias(f"s{c}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
            .mapInArrow(run, "a long, b long"))


def classes(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, k, root) of every row; k is the hash
    of its text, root names its component (null without shingles)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("text"))
    whole = common.stored(parse(docs, params), "jaccard-parsed")
    shared = common.stored(shared_keys(whole), "jaccard-keys")
    found = common.stored(whole.drop("bands"), "jaccard-sets")
    common.discard(whole)
    keys = common.stored(needed(shared), "jaccard-needed")
    common.discard(shared)
    touched = keys.select("sid").distinct()
    nodes = common.stored(
        found.where("sid is not null").join(touched, "sid", "left_semi").groupBy("sid")
        .agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("fine").alias("fine")),
        "jaccard-nodes")

    def texts_of(pairs: DataFrame) -> DataFrame:
        """Shingles of all sets of the pairs."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        return common.stored(members(docs, nodes.join(wanted, "sid", "left_semi").select("k"), params),
                             "jaccard-shingles")

    # candidates: the ends of each key, by the number of keys they share
    ends = keys.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"))
    stars = (keys.join(ends, "key").select("sid", F.explode(F.array("lo", "hi")).alias("other")).where("sid <> other")
             .groupBy(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"))
             .agg(F.count(F.lit(1)).alias("shared")))
    stars = common.stored(near(stars, nodes, params), "jaccard-candidates")
    shingled = texts_of(stars)
    each = stars.select(F.explode(F.array("a", "b")).alias("sid"), "a", "b", "shared")
    best = (each.groupBy("sid").agg(F.max_by(F.struct("a", "b"), F.struct("shared", "a", "b")).alias("pair"))
            .select("pair.*").distinct())
    links = common.stored(linked(best, shingled, params), "jaccard-links")
    roots = components(links)

    def root_of(df: DataFrame, c: str) -> DataFrame:  # by the latest roots
        return df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(
            f"root_{c}", F.coalesce(f"root_{c}", c))

    more = root_of(root_of(stars, "a"), "b").where("root_a <> root_b").select("a", "b").join(best, ["a", "b"], "left_anti")
    links = links.unionByName(common.stored(linked(more, shingled, params), "jaccard-links"))
    roots = components(links)

    # keys whose sets still lie in two or more components, one for all keys that the same sets share
    rooted = root_of(keys, "sid")
    mixed = (rooted.groupBy("key").agg(
        F.min("root_sid").alias("p"), F.max("root_sid").alias("q"), F.count(F.lit(1)).alias("sets"),
        F.bit_xor(F.xxhash64("sid")).alias("who")).where("p <> q")
        .groupBy("p", "q", "sets", "who").agg(F.min("key").alias("key")))
    # each set goes with its sketch to the blocks of its keys; pairs are tested there
    def dealt() -> DataFrame:
        here = root_of(keys.join(mixed.select("key", "sets"), "key"), "sid").withColumnRenamed("root_sid", "root")
        return blocks(here.join(nodes.select("sid", "n", "fine"), "sid"), params)

    def tested(pairs: DataFrame) -> DataFrame:
        pairs = common.stored(pairs.select("a", "b").distinct().join(stars, ["a", "b"], "left_anti"), "jaccard-rest")
        return common.stored(linked(pairs, texts_of(pairs), params), "jaccard-links")

    mixed = common.stored(mixed, "jaccard-mixed")
    nearest = common.stored(pairs_in_blocks(dealt(), params, every=False), "jaccard-nearest")
    if not nearest.isEmpty():
        links = links.unionByName(tested(nearest))
        roots = components(links)
        open_ = nearest.where("block is not null").select("block").distinct()
        if not open_.isEmpty():  # what else is near between components that are still apart
            rest = dealt().join(open_, "block", "left_semi")
            links = links.unionByName(tested(pairs_in_blocks(rest, params, every=True)))
            roots = components(links)

    named = found.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "doc_id", "k", "n", "sid", F.coalesce("root", "sid").alias("root"))
    first = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("first"))
    return named.join(first, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"), "k", "root")


def one_of_each(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The row with the smallest id of each group, with its columns; rows
    without shingles all stay."""
    keep = classes(docs, params).where("doc_id <=> component_id and root is not null")
    # of equal ids in one group the text with the smallest hash, and of equal rows one
    keep = keep.groupBy("doc_id", "root").agg(F.min("k").alias("k")).select(F.xxhash64("doc_id", "k").alias("__k"))
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(has_words).withColumn("__k", F.xxhash64("doc_id", F.xxhash64("text")))
    # one exchange of the texts, by row key, serves the join and the choice among equal rows
    kept = rows.join(keep, "__k", "left_semi").dropDuplicates(["__k"])
    return kept.select(*docs.columns).unionByName(docs.where(~has_words))
