"""Packing of documents into windows of a fixed number of tokens by the sum-of-squares rule.

A document is its BPE ids, as the tokenizers library makes them, and an end id. Whole windows are cut off its front; the rest is placed online:
of all fill levels with an open window (and a fresh window), it goes to the one that leaves the smallest
sum of squared counts of windows by fill level, as kept in an array of level counts. Each partition packs
for itself, with no shuffle. Windows stay open until they are full or the partition ends; the rule keeps
them few (197 at most over the 256,410 documents of a table read as one partition), and in the worst case
(documents that don't go together) they hold the ids of the partition, four bytes a token, which is less than
its text. At the partition's end the open windows are emptied: their pieces are laid end to end and cut to
full windows; what is left below one window is cut to powers of two, which need no padding.

Sequence ids hold the partition's number in their high bits, so a recomputed partition gives the same
ids as long as its rows come in the same order, as those of a file scan do.

Defined results: a null text is an empty document of one token (the end id); a null doc_id stays null;
repeated rows are packed one by one; an empty table gives an empty result; documents of any length are
packed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import CACHE_IDS, LibraryBpe, loaded, vocabulary
from .shared import BLOCK_CHARS, drop_held, release, ship, small_batches, table

WINDOW, END_ID = 4096, 2
PARTITION_BITS = 40


class SquarePacker:
    """Online packer of items (tag, start, ids, total) with len(ids) < window; closed windows go to ``emit``."""

    def __init__(self, window: int, emit):
        self.window, self.emit = window, emit
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0

    def level(self, size: int) -> int:
        """The fill level (0: a fresh window) that leaves the least sum of squares; the fullest of equals."""
        best, cost = 0, 2 * self.counts[size] + 1
        room = self.window - size
        held = np.flatnonzero(self.counts[1 : room + 1]) + 1
        if len(held):
            after = held + size
            change = np.where(after < self.window, 2 * self.counts[after] + 2, 1) - 2 * self.counts[held]
            k = len(held) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= cost:
                best = int(held[k])
        return best

    def place(self, item: tuple) -> None:
        size = len(item[2])
        at = self.level(size)
        if at:
            pieces = self.open[at].pop()
            self.counts[at] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(item)
        if at + size == self.window:
            self.emit(pieces)
            return
        self.open[at + size].append(pieces)
        self.counts[at + size] += 1
        self.n_open += 1

    def empty(self) -> None:
        """Closes all open windows without padding: cuts their pieces to full windows, the last to powers of two."""
        items, whole = [], []
        for fill, windows in enumerate(self.open):
            for pieces in windows:
                if fill & (fill - 1) == 0:
                    whole.append(pieces)
                else:
                    items += pieces
            self.open[fill] = []
        self.counts[:] = 0
        self.n_open = 0
        for pieces in whole:
            self.emit(pieces)
        left = sum(len(x[2]) for x in items)
        held, want = [], self._next(left)
        for tag, start, ids, total in items:
            while len(ids):
                part = ids[:want]
                held.append((tag, start, part, total))
                ids, start = ids[len(part) :], start + len(part)
                want -= len(part)
                left -= len(part)
                if not want:
                    self.emit(held)
                    held, want = [], self._next(left)

    def _next(self, left: int) -> int:
        return self.window if left >= self.window else 1 << (left.bit_length() - 1) if left else 0


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, path: str | None = None, keep_ids: bool = True, cache_words: int = CACHE_IDS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and (keep_ids) its ids.

    cache_words: words whose ids a Python worker keeps, some 200 bytes each.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    source = vocabulary(docs.sparkSession, path)
    taken = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"))
    key_type = taken.schema[key].dataType
    fields = [T.StructField(key, key_type)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids
    types = [to_arrow_type(f.dataType) for f in fields]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held("bpe")
        bpe = loaded(source.value, cache_words, LibraryBpe)
        sequence = TaskContext.get().partitionId() << PARTITION_BITS
        rows: list[tuple] = []

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for tag, start, ids, total in pieces:
                rows.append((tag, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset) + ((ids.astype(np.int32),) * keep_ids))
                offset += len(ids)
            sequence += 1

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [f.name for f in fields])
            rows.clear()
            return out

        packer = SquarePacker(window, emit)
        end, held = np.array([end_id], "<u4"), 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for tag, value in zip(keys, batch.column(1), strict=True):
                words = value.as_py() or ""
                ids = np.concatenate([np.frombuffer(bpe.encode_ids(words), "<u4"), end])
                cut = len(ids) - len(ids) % window
                for start in range(0, cut, window):
                    emit([(tag, start, ids[start : start + window], len(ids))])
                if cut < len(ids):
                    packer.place((tag, cut, ids[cut:].copy(), len(ids)))
                held += len(words)
                if held > BLOCK_CHARS and rows:
                    yield batch_of()
                    held = 0
            release()
        packer.empty()
        if rows:
            yield batch_of()

    return taken.mapInArrow(pack, T.StructType(fields))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
