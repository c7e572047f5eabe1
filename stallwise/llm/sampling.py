"""Minimisers of word windows, and which of them occur more than once in the corpus.

Every window of ``length`` words holds the smallest hash of its ``k``-word runs; equal
windows choose equal runs, at the same offset. So a window that occurs twice has a chosen
run that occurs twice, and the windows without one need no further look.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stallwise.llm.common import Prefix, U64, Words, lists, longs, mapped, mix, runs, signed, slices, words_of
_LOW = U64((1 << 28) - 1)
HELD = 400_000  # positions that one task combines before they are shuffled


@dataclass
class Pieces:
    """Runs of windows (by their first words) that choose the same position."""

    at: np.ndarray  # the word where the chosen run begins
    first: np.ndarray  # the first window
    last: np.ndarray  # the last window
    key: np.ndarray  # hash of the chosen run


def sliding(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def pieces_of(words: Words, prefix: Prefix, k: int, length: int) -> Pieces:
    none = np.zeros(0, np.int64)
    if words.n < length:
        return Pieces(none, none, none, none.view(U64))
    place = np.arange(words.n - k + 1)
    key = prefix.run(place, place + k)
    chosen = (sliding(key & ~_LOW | place.astype(U64), length - k + 1) & _LOW).astype(np.int64)
    owner = words.owner()
    windows = np.flatnonzero(owner[: words.n - length + 1] == owner[length - 1 :])
    chosen = chosen[windows]
    ends = runs(chosen)
    first, last = windows[ends[:-1]], windows[ends[1:] - 1]
    at = chosen[ends[:-1]]
    return Pieces(at, first, last, mix(key[at] ^ U64(0x5851F42D4C957F2D)))


def _sampler(k: int, length: int, lower: bool):
    def combined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, doc, at = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        key, doc, at = key[order], doc[order], at[order]
        ends = runs(key)
        size = np.diff(ends)
        many = np.repeat(size > 1, size)
        lead = ends[:-1][size > 1]
        ask = ~many
        known_doc, known_at = doc[many], at[many]
        order = np.lexsort((known_at, known_doc))
        known_doc, known_at = known_doc[order], known_at[order]
        ends = runs(known_doc)
        docs = known_doc[ends[:-1]]
        asks, leads, tells = ask.sum(), len(lead), len(docs)
        none = np.zeros(leads, np.int64)
        return pa.record_batch(
            [
                pa.array(np.concatenate([signed(key[ask]), signed(key[lead]), signed(mix(docs.astype(U64)))])),
                pa.array(np.repeat(np.array([0, 2, 1], np.int8), [asks, leads, tells])),
                pa.array(np.concatenate([doc[ask], none, docs])),
                pa.array(np.concatenate([at[ask], size[size > 1], np.zeros(tells, np.int64)]).astype(np.int32)),
                lists(known_at.astype(np.int32), np.concatenate([np.zeros(asks + leads, np.int64), np.diff(ends)]), pa.int32()),
            ],
            ["route", "kind", "doc", "at", "known"],
        )

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for part in slices(batches):
            words = words_of(part, lower=lower)
            pieces = pieces_of(words, Prefix(words.hashes()), k, length)
            owner = words.owner()[pieces.at]
            held.append((pieces.key, longs(part, "__doc")[owner], pieces.at - words.first[owner]))
            count += len(owner)
            if count >= HELD:
                yield combined(held)
                held, count = [], 0
        if count:
            yield combined(held)

    return sample


def _repeated(most: int | None):
    """Documents with their known positions and, of runs chosen at more than ``most`` places, the hash."""
    names = ["__key", "known", "head"]

    def told(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        route, kind, doc, at = rows
        ends = runs(route)
        size = np.diff(ends)
        if most is not None:
            places = np.add.reduceat(np.where(kind == 2, at, 1), ends[:-1])
            common = route[ends[:-1]][places > most]
            yield pa.record_batch([pa.nulls(len(common), pa.int64()), pa.nulls(len(common), pa.list_(pa.int32())), pa.array(common)], names)
        twice = np.flatnonzero(np.repeat(size > 1, size) & (kind == 0))
        order = np.lexsort((at[twice], doc[twice]))
        doc, at = doc[twice][order], at[twice][order]
        ends = runs(doc)
        known = lists(at, np.diff(ends), pa.int32())
        yield pa.record_batch([pa.array(doc[ends[:-1]]), known, pa.nulls(len(known), pa.int64())], names)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by route; the last route of a batch waits for the next batch."""
        tail = None
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            sure = batch.filter(pa.array(kinds == 1))
            yield pa.record_batch([sure.column(2), sure.column(4), pa.nulls(sure.num_rows, pa.int64())], names)
            rows = [batch.column(i).to_numpy()[kinds != 1] for i in range(4)]
            if tail is not None:
                rows = [np.concatenate(x) for x in zip(tail, rows)]
            cutoff = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            tail = [x[cutoff:] for x in rows]
            if cutoff:
                yield from told([x[:cutoff] for x in rows])
        if tail is not None and len(tail[0]):
            yield from told(tail)

    return repeated


def document_key() -> Column:
    """Names a document among all, those without an id too; should two share it, they only look at more positions."""
    return F.xxhash64("__doc", "__crc").alias("__key")


def known_positions(docs: DataFrame, k: int, length: int, most: int | None = None, lower: bool = False) -> DataFrame:
    """``__key``, ``known``: chosen word positions whose k words are chosen elsewhere too, in parts.

    ``docs`` has ``__doc``, ``__crc`` and ``text``. With ``most``, rows with a ``head`` instead tell the hashes of
    runs chosen at more than so many places.

    Positions are dealt by the hash of their words. What a task sees twice itself is known at once: those
    rows are spread evenly and only one row, with their number, stands for the run, so a run that a third
    of all documents share brings one row from each task to the task of its hash.
    """
    named = docs.select(document_key().alias("__doc"), "text")
    sampled = mapped(named, _sampler(k, length, lower), "route long, kind byte, doc long, at int, known array<int>")
    dealt = sampled.repartition("route").sortWithinPartitions("route")
    return mapped(dealt, _repeated(most), "__key long, known array<int>, head long")


def positions_of(known: DataFrame) -> DataFrame:
    """``__key``, ``marks``: all known positions of a document."""
    return known.filter("head is null").groupBy("__key").agg(F.flatten(F.collect_list("known")).alias("marks"))


def marked(marks: pa.Array, words: Words, at: np.ndarray) -> np.ndarray:
    """Which of the positions ``at`` are among the marks of their texts."""
    flat = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    wanted = flat + np.repeat(words.first[:-1], counts)
    # a mark of another text with the same id may lie outside this one
    wanted = wanted[wanted < np.repeat(words.first[1:], counts)]
    hit = np.zeros(words.n + 1, bool)
    hit[wanted] = True
    return hit[at]
