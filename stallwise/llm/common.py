"""Words, hashes and stored tables that the operators of this folder share.

Texts are handled as the UTF-8 bytes that Arrow already holds: a word is a run of bytes
other than space, tab, line feed, vertical tab, form feed and carriage return, which is the
pattern ``[^\\x20\\x09-\\x0D]+``. Hashes of words and of runs of words come from prefix sums
of a polynomial modulo 2**64, so any run costs the same.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stallwise.functions.work import cut, fresh_path  # noqa: F401

U64 = np.uint64
NO_ID = (1 << 63) - 1  # stands for a NULL id, and sorts last
SLICE = 1 << 20  # bytes of text that are handled at once, unless one text is longer
HASHED = (1 << 18) - 1  # bytes whose prefix sums are held at once, unless one word is longer
_BASE = 0x9E3779B97F4A7C55
pa.set_memory_pool(pa.system_memory_pool())  # gives back what a worker frees; the default pool keeps it
GIVE_BACK_S = 0.5  # between two times that a worker gives back memory
BATCH = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = (np.ones(1, U64), np.ones(1, U64))


def plainly_named(docs: DataFrame) -> DataFrame:
    """``docs``, unless a column has a name of those that the operators add on the way."""
    taken = [c for c in docs.columns if c.startswith("__")]
    if taken:
        raise ValueError(f"column names that begin with two underscores are reserved: {taken}")
    return docs


def document_columns(text: str = "text", ident: str = "doc_id") -> dict[str, Column]:
    """``__doc`` and ``__crc``: rows with the same id and the same text are one document."""
    return {
        "__doc": F.coalesce(F.col(ident).cast("long"), F.lit(NO_ID)),
        "__crc": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")),
    }


def give_back() -> None:
    """Hand the memory that is free in this process to the system; the C library would keep it."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def given_back(function: Callable) -> Callable:
    """``function`` over batches, on the way and after which the worker gives back the memory that it has freed.

    A worker stays for later tasks, and a stage with two functions leaves twice as many as there are cores. What
    each of them holds on to adds up from stage to stage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = time.monotonic()
        try:
            for batch in function(batches):
                yield batch
                if time.monotonic() - done > GIVE_BACK_S:
                    give_back()
                    done = time.monotonic()
        finally:
            give_back()

    return run


def mapped(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most BATCH, whatever the length of the texts.

    Spark's own bound of 64 MB lets several batches in each worker and in the memory beside the
    heap fill an executor. A size that the session sets itself is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) in (None, "64MB", "67108864b"):
        conf.set(_BATCH_SETTING, BATCH)
    return df.mapInArrow(given_back(function), schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _powers = tuple(
            np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))]) for b in (_BASE, inverse)
        )
    return _powers


class Prefix:
    """Hashes of any run of ``values`` by its ends."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        power, self.inverse = _powers_to(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * power[:n], out=self.sums[1:])

    def run(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        return mix((self.sums[after] - self.sums[first]) * self.inverse[first] + (after - first).astype(U64))


class Words:
    """The words of some texts: ends in bytes, hashes, and where each text begins."""

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, separator: np.ndarray = _SEPARATOR
    ) -> None:
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        letter = ~separator[data]
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = letter[:-1]
        self.start = np.flatnonzero(letter & (~before | begin[:n]))
        after = np.zeros(n, bool)
        after[:-1] = letter[1:]
        self.end = np.flatnonzero(letter & (~after | begin[1:])) + 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.n = len(self.start)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first ``most`` bytes."""
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        out = np.empty(self.n, U64)
        at = 0
        while at < self.n:
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + HASHED, side="right")))
            run = Prefix(self.data[base : self.end[to - 1]].astype(U64) + U64(1))
            out[at:to] = run.run(self.start[at:to] - base, end[at:to] - base)
            at = to
        return out

    def owner(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts (NULL counts as empty) and where each begins and the last ends."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``most`` bytes of text, or a single longer text."""
    for batch in batches:
        _, offsets = text_buffer(column(batch, text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words_of(batch: pa.RecordBatch, text: str = "text", lower: bool = False) -> Words:
    return Words(*text_buffer(column(batch, text)), lower)


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow array of lists from their joined values."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def blobs(data: bytes | np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow array of byte strings from their joined bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    if ends[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    raise ValueError("more than 2 GB of bytes in one batch")


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted keys, with the number of rows at the end."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), n)


def squeezed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` as zstd bytes: on natural text a shuffle moves a third less than with lz4 blocks."""
    names, at = df.columns, df.columns.index(text)
    fields = [T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in df.schema]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=1)
        for part in slices(batches, text):
            made = [None if t is None else codec.compress(t.encode()) for t in part.column(at).to_pylist()]
            yield pa.record_batch([pa.array(made, pa.binary()) if i == at else c for i, c in enumerate(part.columns)], names)

    return mapped(df, squeeze, T.StructType(fields))


def unsqueezed(
    batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = 256, most: int = SLICE
) -> Iterator[pa.RecordBatch]:
    """The batches of a squeezed table with their texts again, in parts of a bounded size."""
    codec = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index(text)
        for begin in range(0, batch.num_rows, rows):
            part = batch.slice(begin, rows)
            made = [None if x is None else codec.decompress(x) for x in part.column(at).to_pylist()]
            held = pa.array(made, pa.binary()).cast(pa.string())
            whole = pa.record_batch([held if i == at else c for i, c in enumerate(part.columns)], part.schema.names)
            yield from slices(iter([whole]), text, most)


def merged(doc: np.ndarray, crc: np.ndarray, start: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of documents with those that touch or overlap made one; any order in, sorted out."""
    order = np.lexsort((start, crc, doc))
    doc, crc, start, after = doc[order], crc[order], start[order], after[order]
    if not len(doc):
        return doc, crc, start, after
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])
    # the farthest end so far within each document: ends are lifted above those of documents before
    lift = np.cumsum(new).astype(np.int64) * (int(after.max()) + 1)
    far = np.maximum.accumulate(after + lift) - lift
    new[1:] |= start[1:] > far[:-1]
    begin = np.flatnonzero(new)
    return doc[begin], crc[begin], start[begin], far[np.append(begin[1:], len(doc)) - 1]
