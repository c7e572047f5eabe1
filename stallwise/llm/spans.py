"""Cut word spans out of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stallwise.llm.common import Words, column, document_columns, mapped, squeezed, text_buffer, unsqueezed

def _gathered(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space, and the lengths of the results."""
    owner = words.owner()[keep]
    start, size = words.start[keep], words.end[keep] - words.start[keep] + 1
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    step = np.ones(total, np.int64)
    if total:
        step[0] = start[0]
        step[ends[:-1]] = start[1:] - (start[:-1] + size[:-1] - 1)
    place = np.cumsum(step)
    np.minimum(place, len(words.data) - 1, out=place)
    out = words.data[place]
    out[ends - 1] = 0x20
    solid = np.ones(total, bool)
    solid[ends[last] - 1] = False
    lengths = np.bincount(owner, weights=size - last, minlength=len(words.first) - 1).astype(np.int64)
    return out[solid], lengths


def _trimmed(words: Words, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts without the removed words and the space that follows each of them."""
    upto = np.append(words.start[1:], len(words.data))
    ends = words.offsets[1:][words.owner()]
    upto = np.minimum(upto, ends)
    change = np.zeros(len(words.data) + 1, np.int64)
    np.add.at(change, words.start[removed], 1)
    np.add.at(change, upto[removed], -1)
    keep = np.cumsum(change[:-1]) == 0
    lengths = np.diff(np.concatenate([[0], np.cumsum(keep)])[words.offsets])
    return words.data[keep], lengths


def _cutter(text: str, names: list[str], joined: bool):
    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unsqueezed(batches, text):
            words = Words(*text_buffer(column(part, text)))
            spans = column(part, "__spans")
            counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = spans.flatten()
            first = np.repeat(words.first[:-1], counts)
            limit = np.repeat(words.first[1:], counts)
            start = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64) + first
            after = start + flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
            change = np.zeros(words.n + 1, np.int64)
            np.add.at(change, np.minimum(start, limit), 1)
            np.add.at(change, np.minimum(after, limit), -1)
            removed = np.cumsum(change[:-1]) > 0
            gone = np.concatenate([[0], np.cumsum(removed)])[words.first]
            data, lengths = _gathered(words, np.flatnonzero(~removed)) if joined else _trimmed(words, removed)
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            made = pa.Array.from_buffers(
                pa.string(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]
            )
            arrays = [made if n == text else column(part, n) for n in names]
            arrays += [pa.array(np.diff(words.first)), pa.array(np.diff(gone))]
            yield pa.record_batch(arrays, [*names, "n_words", "n_removed"])

    return cut_out


def without_spans(docs: DataFrame, spans: DataFrame, text: str, ident: str, joined: bool) -> DataFrame:
    """``docs`` with the spans cut from ``text``, and ``n_words`` and ``n_removed``.

    ``spans`` has ``__doc``, ``__crc``, ``start``, ``n`` in words; spans may overlap. With
    ``joined`` the kept words are joined by one space; else the text stays as it is but for
    the removed words and the space after each. A NULL text counts as empty and comes back empty.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    listed = spans.groupBy("__doc", "__crc").agg(F.collect_list(F.struct("start", "n")).alias("__spans"))
    whole = squeezed(docs.select(*names).withColumns(document_columns(text, ident)), text)
    joint = whole.join(listed, ["__doc", "__crc"], "left")
    fields = [docs.schema[n] for n in names]
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    return mapped(joint.select(*names, "__spans"), _cutter(text, names, joined), T.StructType(fields + more))
