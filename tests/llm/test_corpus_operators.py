"""Operators 11 to 13 against brute force: substring deduplication, spelling
variants, centroid clustering."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_cases import LOWER, SCHEMA, documents, frame, prose, space_words
from vessel_flow.llm import orchard, recompression, spelling
from vessel_flow.llm.repetition import WordHashes


def by_repr(rows):
    return sorted(map(repr, map(tuple, rows)))


# --- substring deduplication ----------------------------------------------------


def brute_repeats(rows, window=20):
    """(doc_id, n_words, n_removed, kept) of (id, text) rows."""
    place = lambda d, k: ((d is not None, d or 0), k)  # noqa: E731  null before all
    first = {}
    for d, t in rows:
        w = space_words(t)
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            first[x] = min(first.get(x, place(d, k)), place(d, k))
    out = []
    for d, t in rows:
        w = space_words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] != place(d, k):
                gone.update(range(k, k + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def digest(rows):
    return [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows]


def check_repeats(spark, rows, params=recompression.Params()):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows, params.window)
    assert by_repr(recompression.dedup(docs, params).collect()) == by_repr(digest(want))
    return docs, want


def test_repeats_odd_rows(spark):
    rows = [r[:2] for r in documents()]
    want = digest(brute_repeats(rows))
    assert by_repr(recompression.dedup(frame(spark)).collect()) == by_repr(want)


def test_repeats_kept_texts(spark):
    rows = [(1, prose(random.Random(1), 60)), (3, None), (4, " a  b\n")]
    rows += [(2, "x " + rows[0][1] + " y"), (2, "x " + rows[0][1] + " y")]
    docs, want = check_repeats(spark, rows)
    got = recompression.dedup(docs, texts=True).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert by_repr(got) == by_repr(want)


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 20), (3, 8), (4, 33)])
def test_repeats_planted(spark, seed, window):
    """Passages of lengths about the window, in other surroundings, also of few
    different words and of runs, so that symbols reach across the borders."""
    r = random.Random(seed)
    pools = [[prose(r, 1) for _ in range(n)] for n in (1, 2, 3, 8, 400)]
    some = lambda n: [r.choice(r.choice(pools)) if r.random() < 0.2 else r.choice(pools[-1]) for _ in range(n)]
    planted = [[r.choice(p) for _ in range(window + r.randint(-1, 5))] for p in pools for _ in range(4)]
    planted += [["a"] * k + ["b"] * (window - k) for k in (0, 1, window // 2)]
    rows = []
    for i in range(60):
        w = some(r.randint(0, 30))
        for _ in range(r.randint(0, 4)):
            w += r.choice(planted) + some(r.randint(0, 3))
        rows.append((r.randint(-5, 45), " ".join(w)))
    check_repeats(spark, rows, recompression.Params(window=window, block=100))


def test_equal_windows_have_equal_symbols():
    """What stands for a window does not depend on the words around it."""
    r = np.random.default_rng(7)
    p = recompression.Params()
    for size in (2, 3, 6, 50, 10 ** 6):
        inner = r.integers(1, size + 1, p.window).astype(np.uint64)
        seen = set()
        for _ in range(40):
            left, right = (r.integers(1, size + 1, r.integers(0, 12)).astype(np.uint64) for _ in range(2))
            h = recompression.mix(np.concatenate([left, inner, right]))
            name, _ = recompression.interior(h, np.zeros(len(h), np.int64), np.arange(len(h) - p.window + 1), p)
            seen.add(int(name[len(left)]))
        assert len(seen) == 1


def test_repeats_empty_table(spark):
    assert recompression.dedup(frame(spark, [])).collect() == []


def test_parsing_takes_linear_time():
    import time
    hashes, took = WordHashes(), []
    for n in (100_000, 400_000):
        h = np.array([hashes[b"w%d" % (i % 7)] for i in range(n)], np.uint64)
        t = time.process_time()
        recompression.interior(h, np.zeros(n, np.int64), np.arange(n - 19), recompression.Params())
        took.append(time.process_time() - t)
    assert took[1] < 10 * took[0] + 0.5


# --- spelling variants ------------------------------------------------------------


def brute_variants(rows, p=spelling.Params()):
    count = Counter()
    for d, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run if h % p.damage else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    vocabulary = {w: n for w, n in count.items() if len(w) >= p.length and n >= p.count}
    near = defaultdict(set)
    by_gap = defaultdict(list)
    for w in vocabulary:
        for k in range(len(w)):
            by_gap[len(w), k, w[:k] + w[k + 1:]].append(w)
            if (short := w[:k] + w[k + 1:]) in vocabulary:
                near[w].add(short)
                near[short].add(w)
    for group in by_gap.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    best = {w: min(near[w], key=lambda x: (-vocabulary[x], x), default=None) for w in vocabulary}
    form = {w: b if b and vocabulary[b] >= p.times * vocabulary[w] else None for w, b in best.items()}
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocabulary.get(form[w])))
    return out


def misspelt(seed):
    r = random.Random(seed)
    base = ["".join(r.choices("aeinrstéü", k=r.randint(6, 11))) for _ in range(12)] + ["aaaaaaa", "a" * 300, "×÷Àÿ" * 2]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = r.choice(base)
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(w) + 1)
                w = r.choice([w[:k] + r.choice("aeinst") + w[k:], w[:k] + w[k + 1:], w[:k] + r.choice("aeinst") + w[k + 1:]])
            words.append(r.choice([w, w.upper(), w.title()]))
        rows.append((i if i % 9 else None, r.choice([" ", ", ", "\n", "1"]).join(words)))
    return rows + [(500, None), (501, ""), (502, "x"), (503, rows[0][1]), (503, rows[0][1])]


@pytest.mark.parametrize("params", [spelling.Params(), spelling.Params(block=3, tile=5), spelling.Params(times=2, count=1, length=3)])
def test_variants_against_brute_force(spark, params):
    rows = misspelt(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_repr(spelling.variants(docs, params).collect()) == by_repr(brute_variants(rows, params))


def test_variants_odd_rows(spark):
    rows = documents()
    assert by_repr(spelling.variants(frame(spark)).collect()) == by_repr(brute_variants([r[:2] for r in rows]))


def test_variants_empty_table(spark):
    assert spelling.variants(frame(spark, [])).collect() == []


def test_blocks_stay_small(spark):
    """A group of words that share a half is halved until it fits, and no pair is lost."""
    r = random.Random(5)
    words = sorted({"prefix" + "".join(r.choices("abc", k=8)) for _ in range(600)})
    vocabulary = spark.createDataFrame([(w,) for w in words], "word string")
    p = spelling.Params(block=32, tile=16)
    sizes = [x["count"] for x in spelling.blocks(vocabulary, p).groupBy("key").count().collect()]
    assert max(sizes) <= p.block
    got = {(x.a, x.b) for x in spelling.near_words(vocabulary, p).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and sum(x != y for x, y in zip(a, b)) == 1}


def test_one_edit():
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "xabc") and spelling.one_edit("abc", "abcx")
    assert not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "acb") and not spelling.one_edit("abc", "xabd")


# --- centroid clustering ------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, cluster int, distance long, v string, c int"


def brute_clusters(rows, p):
    grid = [(i, [math.floor(p.scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == p.dim and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = sorted((hashlib.sha256(f"{p.seed}:{'null' if i is None else i}".encode()).hexdigest(), v) for i, v in grid)
    centroids = [v for _, v in by_hash[:p.k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(p.rounds):
        groups = defaultdict(list)
        for _, v in grid:
            groups[nearest(v)[1]].append(v)
        for k, vs in groups.items():
            centroids[k] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)[::-1]) for i, v in grid]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return [(i, c, d, inertia[c], sum(inertia.values())) for i, c, d in found], centroids


@pytest.mark.parametrize("seed,values", [(1, 3), (2, 40), (3, 1000)])
def test_clusters_against_brute_force(spark, seed, values):
    """Few different values give many ties, also between centroids."""
    r = random.Random(seed)
    p = orchard.Params(k=9, rounds=4, dim=5)
    vector = lambda: [r.randrange(-values, values) / 256 for _ in range(p.dim)]
    rows = [(i, vector()) for i in range(150)]
    rows += [(7, rows[7][1]), (7, vector()), (None, vector()), (900, None), (901, []), (902, vector()[:4]), (903, vector() + [0.0]),
             (904, [None, *vector()[1:]]), (905, [math.nan, *vector()[1:]]), (906, [math.inf, *vector()[1:]])]
    rows += [(1000 + i, rows[3][1]) for i in range(80)]
    got, centroids = orchard.cluster(spark.createDataFrame([(*x, 1, 2, "v", 3) for x in rows], VECTORS), p)
    want, moved = brute_clusters(rows, p)
    assert centroids.tolist() == moved
    assert by_repr(got.collect()) == by_repr(want)


def test_clusters_of_fewer_vectors_and_none(spark):
    p = orchard.Params(k=9, rounds=2, dim=2)
    got, centroids = orchard.cluster(spark.createDataFrame([(1, [0.5, -0.5], 1, 1, "", 1)], VECTORS), p)
    assert [tuple(x) for x in got.collect()] == [(1, 0, 0, 0, 0)] and centroids.tolist() == [[128, -128]]
    got, _ = orchard.cluster(spark.createDataFrame([], VECTORS), p)
    assert got.collect() == []


def test_orchard_walks_short_lists():
    """Far apart groups: most centroids are never met."""
    r = np.random.default_rng(1)
    c = r.integers(-10 ** 6, 10 ** 6, (40, 8))
    x = np.repeat(c, 50, axis=0) + r.integers(-9, 10, (2000, 8))
    lists = orchard.Lists(c)
    met = 0
    plain = lists._distance

    def counted(rows, to):
        nonlocal met
        met += len(rows)
        return plain(rows, to)

    lists._distance = counted
    number, _ = lists.nearest(x)
    assert (number == np.repeat(np.arange(40), 50)).all() and met < 0.6 * 40 * len(x)
