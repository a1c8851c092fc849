"""Hierarchical multi-length packing of token sequences.

Documents are tokenized and routed to context-size tiers.  Whole long windows
are cut from long documents; what remains of each document goes to the
smallest tier that holds it.  Tiers are packed from the longest down: a window
takes one piece of its own tier, and its gap is filled with the largest
shorter pieces that fit, the last one cut if nothing fits.  Sequences are
dealt to step groups so that every group has a like mix of tiers.

Packing is local to a task: it works on blocks of at most ``block_tokens``
tokens plus one document, carries unfinished windows on to the next block, and
cuts the last rest of a task into powers of two, which need no padding.  There
is no shuffle; a lost task is simply run again.

Defined cases: a null text is an empty one, which has just the end token;
repeated and null ids are packed like others; a very long text is cut into
windows as it is met.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")


@dataclass(frozen=True)
class Params:
    vocabulary: str
    ranks: str  # the same vocabulary as a rank file
    pattern: str  # splits text before the merges
    end_id: int = 1
    tiers: tuple[int, ...] = (256, 512, 1024, 2048)
    block_tokens: int = 1 << 20
    group_tokens: int = 1 << 17


class Encoder:
    """Token ids of texts.

    A blank between two other characters always begins a new pre-token, so the
    ids of a text are those of its blank-separated chunks in a row, each chunk
    with the blank before it; ids of chunks are remembered.  Texts with other
    white space next to a blank, or with the marker of special tokens, are
    encoded whole by the vocabulary's own tokenizer."""

    limit = 400_000

    def __init__(self, params: Params):
        import tiktoken
        from tokenizers import Tokenizer

        with open(params.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = Tokenizer.from_file(params.vocabulary)
        self.merge = tiktoken.Encoding("packing", pat_str=params.pattern, mergeable_ranks=ranks,
                                       special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def _miss(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise ValueError(chunk)
        if len(self.known) >= self.limit:
            self.known.clear()
        out = self.known[chunk] = np.array(self.merge(" " + chunk), dtype="<u4").tobytes()
        return out

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if "<|" not in text:
            head, *rest = text.split(" ")
            try:
                if head and not head[-1].isspace():
                    known, miss = self.known.get, self._miss
                    parts = [known(c) or miss(c) for c in rest]
                    first = np.array(self.merge(head), dtype="<u4").tobytes()
                    return np.frombuffer(first + b"".join(parts), dtype="<u4")
            except ValueError:
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")


@dataclass
class Piece:
    doc: int | None
    ids: np.ndarray
    start: int
    total: int

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.doc, self.ids[:n], self.start, self.total),
                Piece(self.doc, self.ids[n:], self.start + n, self.total))


@dataclass
class Packer:
    """Packs the documents of one task; ``take`` and ``finish`` return rows."""

    params: Params
    first_id: int = 0
    sequences: int = 0
    groups: int = 0
    held: int = 0
    lengths: list[int] = field(default_factory=list)  # of the pieces that wait, ascending
    waiting: list[Piece] = field(default_factory=list)
    full: list[tuple[int, list[Piece]]] = field(default_factory=list)

    def _wait(self, p: Piece) -> None:
        at = bisect.bisect_left(self.lengths, len(p.ids))
        self.lengths.insert(at, len(p.ids))
        self.waiting.insert(at, p)

    def _pop(self, at: int) -> Piece:
        self.lengths.pop(at)
        return self.waiting.pop(at)

    def take(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        window, n = self.params.tiers[-1], len(ids)
        for start in range(0, n - n % window, window):
            self.full.append((window, [Piece(doc, ids[start:start + window], start, n)]))
        if n % window:
            self._wait(Piece(doc, ids[n - n % window:], n - n % window, n))
        self.held += n
        return self._pack() if self.held >= self.params.block_tokens else []

    def _fill(self, pieces: list[Piece], room: int) -> int:
        """Adds waiting pieces that fit, the last one cut; the room left."""
        while room and self.waiting:
            at = bisect.bisect_right(self.lengths, room) - 1
            p = self._pop(max(at, 0))
            if at < 0:
                p, rest = p.cut(room)
                self._wait(rest)
            pieces.append(p)
            room -= len(p.ids)
        return room

    def _pack(self) -> list[tuple]:
        carried: list[Piece] = []
        for low, tier in reversed(list(zip((0, *self.params.tiers[:-1]), self.params.tiers))):
            while self.lengths and self.lengths[-1] > low:
                pieces = [self._pop(len(self.lengths) - 1)]
                if self._fill(pieces, tier - len(pieces[0].ids)):
                    carried += pieces
                else:
                    self.full.append((tier, pieces))
        for p in carried:
            self._wait(p)
        self.held = sum(self.lengths)
        return self._emit()

    def _emit(self) -> list[tuple]:
        rows: list[tuple] = []
        total = sum(t for t, _ in self.full)
        groups = max(1, round(total / self.params.group_tokens))
        # longest tiers first and there and back over the groups: like mixes, like sums
        for k, (tier, pieces) in enumerate(sorted(self.full, key=lambda x: -x[0])):
            turn, place = divmod(k, groups)
            group = self.groups + (place if turn % 2 == 0 else groups - 1 - place)
            offset = 0
            for p in pieces:
                rows.append((p.doc, p.start, len(p.ids), zlib.crc32(np.ascontiguousarray(p.ids)), p.total,
                             self.first_id + self.sequences, offset, tier, self.first_id + group))
                offset += len(p.ids)
            self.sequences += 1
        self.groups += groups
        self.full = []
        return rows

    def finish(self) -> list[tuple]:
        """Packs all that waits; the last rest goes into powers of two."""
        rows = self._pack()
        while self.waiting:
            size = 1 << min(sum(self.lengths).bit_length() - 1, self.params.tiers[-1].bit_length() - 1)
            pieces: list[Piece] = []
            self._fill(pieces, size)
            self.full.append((size, pieces))
        return rows + (self._emit() if self.full else [])


def pack(docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(params)
        packer = Packer(params, TaskContext.get().partitionId() << 40)
        end = np.array([params.end_id], dtype="<u4")
        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32()}[c.split()[1]])
                            for c in SCHEMA.split(", ")])

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)],
                                                 schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from out(packer.take(doc, np.concatenate([encoder.ids(text.as_py() or ""), end])))
        yield from out(packer.finish())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, SCHEMA)
