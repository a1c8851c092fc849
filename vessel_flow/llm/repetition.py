"""Quality rules on repetition: rolling hashes of several n-gram lengths.

Words are maximal runs of characters other than space and \\t..\\r.  Each word
gets a 64-bit hash; the hash of an n-gram is a polynomial over its words'
hashes, built for all positions at once in numpy.  For every length in
``NGRAMS`` the rule measures which part of the text's word characters lies
inside n-grams that occur twice or more, and which part of its line characters
lies in repeated lines.

Defined cases: a null text has no words; texts without words fail the base
rule; very long texts take memory in proportion to their own words only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

#: n-gram length -> largest share of word characters inside repeated n-grams.
NGRAMS = {4: 0.50, 6: 0.40, 8: 0.30, 10: 0.25}
#: Largest share of characters in lines that repeat an earlier line.
LINE_SHARE = 0.30
BASE_WINDOW = 8
MIN_WORDS = 20
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, dup_line_share double, "
          + ", ".join(f"dup{n}_share double" for n in NGRAMS))

_MULT = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash by word; forgets all once it holds ``limit`` words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) | 1
        return h


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position (wrapping 64-bit arithmetic)."""
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out *= _MULT
        out ^= out >> np.uint64(29)
        out += h[k:k + m]
    return out


def repeated_words(h: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words inside an n-gram that occurs twice or more."""
    inside = np.zeros(len(h), dtype=bool)
    if len(h) <= n:
        return inside
    g = ngram_hashes(h, n)
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return inside
    hit = np.zeros(len(g), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    step = np.zeros(len(h) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str | None, hashes: WordHashes) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() splits at exactly BLANK
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANK))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    n_dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            if line in seen:
                n_dup_lines += 1
                dup_line_chars += len(line)
            else:
                seen.add(line)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    n_repeat = int(repeated_words(h, BASE_WINDOW).sum())
    failed = n < MIN_WORDS or 100 * n_repeat > 30 * n
    line_share = dup_line_chars / max(1, len(text))
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    total = max(1, int(size.sum()))
    shares = [float(size[repeated_words(h, k)].sum()) / total for k in NGRAMS]
    kept = not failed and line_share <= LINE_SHARE and all(s <= t for s, t in zip(shares, NGRAMS.values()))
    return (n, word_chars, n_symbols, n_dup_lines, n_repeat, failed, kept, line_share, *shares)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * (1 + len(NGRAMS))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = [measure(t.as_py(), hashes) for t in batch.column(1)]
        cols = zip(*rows) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures and verdicts for each row of ``docs``."""
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(_columns, SCHEMA))
