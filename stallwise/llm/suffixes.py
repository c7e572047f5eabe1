"""Suffix-array dedup over suffixes at minimiser positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from stallwise.llm.common import (
    SLICE, Prefix, U64, blobs, column, cut, document_columns, longs, mapped, merged, mix, plainly_named, runs, signed, squeezed, unsqueezed,
    words_of,
)
from stallwise.llm.sampling import document_key, known_positions, marked, pieces_of, positions_of
from stallwise.llm.spans import without_spans

HELD = 30_000  # suffixes that one task combines before they are shuffled
MANY = 1000  # places of a head, above which its suffixes part into windows
PARTED = 5000  # suffixes that part at once
SUFFIXES = "kind byte, head long, route long, doc long, crc long, at int, left int, n int, words binary"
NAMES = ["kind", "head", "route", "doc", "crc", "at", "left", "n", "words"]
SPANS = "doc long, crc long, start int, n int"


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)


def _spans(doc: np.ndarray, crc: np.ndarray, start: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    doc, crc, start, after = merged(doc, crc, start, after)
    arrays = [pa.array(doc), pa.array(crc), pa.array(start.astype(np.int32)), pa.array((after - start).astype(np.int32))]
    return pa.record_batch(arrays, ["doc", "crc", "start", "n"])


def _suffixes(k: int, length: int):
    """Sampled suffixes with the words around them, for the marked positions only.

    ``words`` are the 32-bit hashes of the words that windows of ``length`` over the position cover:
    ``left`` of them before it, the suffix after. What a task holds twice with the same words is settled
    at once: only the earliest goes on, the others return their windows as spans (kind 1).
    """

    def combined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        head, whole, doc, crc, at, left, size, words = (np.concatenate(x) for x in zip(*held))
        begin = np.cumsum(size) - size
        order = np.lexsort((at, doc, whole, head))
        ends = runs(head[order], whole[order])
        lead = order[np.repeat(ends[:-1], np.diff(ends))]
        later = (doc[order] != doc[lead]) | (at[order] != at[lead])
        gone, stay = order[later], order[~later]
        start = at[gone] - left[gone]
        told = merged(doc[gone], crc[gone], start, start + size[gone])
        none = np.zeros(len(told[0]), np.int64)
        own = words[_expand(begin[stay], size[stay])]
        arrays = [
            np.repeat(np.array([1, 0], np.int8), [len(none), len(stay)]),
            np.concatenate([none, signed(head[stay])]),
            np.concatenate([signed(mix(told[0].astype(U64))), signed(head[stay])]),
            np.concatenate([told[0], doc[stay]]),
            np.concatenate([told[1], crc[stay]]),
            np.concatenate([told[2], at[stay]]).astype(np.int32),
            np.concatenate([none, left[stay]]).astype(np.int32),
            np.concatenate([told[3] - told[2], size[stay]]).astype(np.int32),
        ]
        raw = blobs(own.astype("<u4"), np.concatenate([none, size[stay] * 4]))
        return pa.record_batch([*(pa.array(x) for x in arrays), raw], NAMES)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for part in unsqueezed(batches, most=SLICE // 4):
            words = words_of(part)
            hashes = words.hashes()
            prefix = Prefix(hashes)
            pieces = pieces_of(words, prefix, k, length)
            take = marked(column(part, "marks"), words, pieces.at)
            at, first, last, key = (x[take] for x in (pieces.at, pieces.first, pieces.last, pieces.key))
            owner = words.owner()[first]
            size = last + length - first
            held.append(
                (
                    key,
                    prefix.run(first, last + length) + (at - first).astype(U64),
                    longs(part, "__doc")[owner],
                    longs(part, "__crc")[owner],
                    at - words.first[owner],
                    at - first,
                    size,
                    (hashes[_expand(first, size)] >> U64(32)).astype(np.uint32),
                )
            )
            count += len(first)
            if count >= HELD:
                yield combined(held)
                held, count = [], 0
        if count:
            yield combined(held)

    return suffixes


def _parted(length: int):
    """Suffixes of heads with many places as one row a window (kind 2); spans and other suffixes as they are.

    A window of such a head is named by its head and the hash of its words, and dealt by both, so that no
    task gets all windows of a head. What a task sees of a window a second time is settled at once.
    """

    def windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        head, doc, crc, at, left, size = (longs(batch, c) for c in ("head", "doc", "crc", "at", "left", "n"))
        words = np.frombuffer(b"".join(column(batch, "words").to_pylist()), "<u4")
        prefix = Prefix(words.astype(U64) + U64(1))
        count = size - length + 1
        first = _expand(np.cumsum(size) - size, count)
        start = _expand(at - left, count)
        head, doc, crc, at = (np.repeat(x, count) for x in (head, doc, crc, at))
        # where the head stands in the window is part of the name
        key = mix(prefix.run(first, first + length) + mix((at - start).astype(U64)) + head.view(U64))
        order = np.lexsort((start, doc, key, head))
        ends = runs(head[order], key[order])
        lead = order[np.repeat(ends[:-1], np.diff(ends))]
        later = (doc[order] != doc[lead]) | (start[order] != start[lead])
        gone, stay = order[later], order[~later]
        told = merged(doc[gone], crc[gone], start[gone], start[gone] + length)
        none = np.zeros(len(told[0]), np.int64)
        arrays = [
            np.repeat(np.array([1, 2], np.int8), [len(none), len(stay)]),
            np.concatenate([none, head[stay]]),
            np.concatenate([signed(mix(told[0].astype(U64))), signed(key[stay])]),
            np.concatenate([told[0], doc[stay]]),
            np.concatenate([told[1], crc[stay]]),
            np.concatenate([told[2], start[stay]]).astype(np.int32),
            np.zeros(len(none) + len(stay), np.int32),
            np.concatenate([told[3] - told[2], np.full(len(stay), length)]).astype(np.int32),
        ]
        raw = pa.nulls(len(none) + len(stay), pa.binary())
        yield pa.record_batch([*(pa.array(x) for x in arrays), raw], NAMES)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = column(batch, "many")
            yield batch.filter(pa.compute.invert(many)).select(NAMES)
            rest = batch.filter(many)
            for at in range(0, rest.num_rows, PARTED):
                yield from windows(rest.slice(at, PARTED))

    return parted


def suffix_array(group: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``matrix`` in lexical order by group, and how many words each shares with the row before."""
    order = np.lexsort((*matrix.T[::-1], group))
    rows = matrix[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
    common[group[order][1:] != group[order][:-1]] = 0
    return order, np.concatenate([[0], common])


class Seen:
    """First places of the windows of a head whose suffixes come in several batches."""

    def __init__(self) -> None:
        self.head: int | None = None
        self.first: dict[int, tuple[int, int]] = {}  # by a hash of the window and where the suffix is in it


def repeats(
    head: np.ndarray, doc: np.ndarray, at: np.ndarray, left: np.ndarray, size: np.ndarray, words: np.ndarray, length: int, k: int, seen: Seen
) -> tuple[np.ndarray, np.ndarray]:
    """Windows that were met at an earlier place: (suffix, words to its left), for suffixes in order of head and place.

    The suffixes are sorted by head and words; neighbours that share r words form a range of
    the array, which ends where the shared length falls below r. A window with a words to the left of
    a suffix needs length - a shared words from it on, so it repeats only within such a
    range, and there if the extension to the left agrees, matched by hash.
    """
    begin = np.cumsum(size) - size
    n = len(doc)
    group = np.cumsum(np.concatenate([[0], head[1:] != head[:-1]])) if n else np.zeros(0, np.int64)
    if n and seen.head != head[0]:
        seen.first = {}
    going_on = {0} if n and seen.head == head[0] else set()
    right = np.zeros((n, length), np.uint32)
    step = np.arange(length)[None, :]
    within = left[:, None] + step < size[:, None]
    right[within] = words[((begin + left)[:, None] + step)[within]]
    order, common = suffix_array(group, right)
    prefix = Prefix(words.astype(U64) + U64(1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    kept: dict[int, tuple[int, int]] = {}
    for a in range(length - k + 1):
        can = (left[order] >= a) & (size[order] - left[order] >= length - a)
        if not can.any():
            continue
        range_ = np.cumsum(common < length - a)[can]
        row = order[can]
        place = begin[row] + left[row]
        back = prefix.run(place - a, place)
        by = np.lexsort((at[row], doc[row], back, range_))
        ends = runs(range_[by], back[by])
        lead = row[by[ends[:-1]]]
        old_doc, old_at = doc[lead].copy(), at[lead] - a
        border = np.flatnonzero((group[lead] == group[-1]) | np.isin(group[lead], list(going_on)))
        at_head = begin[lead[border]] + left[lead[border]]
        ahead = prefix.run(at_head, at_head + length - a) + mix(back[by[ends[border]]] + U64(a))
        for i, key in zip(border.tolist(), ahead.tolist()):
            mine = (int(old_doc[i]), int(old_at[i]))
            if group[lead[i]] in going_on:
                mine = seen.first.get(key, mine)
                old_doc[i], old_at[i] = mine
            if group[lead[i]] == group[-1]:
                kept[key] = mine
        whose = np.repeat(np.arange(len(lead)), np.diff(ends))
        mine = row[by]
        later = (doc[mine] != old_doc[whose]) | (at[mine] - a != old_at[whose])
        found.append((mine[later], np.full(int(later.sum()), a)))
    if n:
        if group[-1] not in going_on:
            seen.first = {}
        seen.first.update(kept)
        seen.head = int(head[-1])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*found)) if found else (none, none)


def _neighbours(k: int, length: int):
    """Rows come sorted by route, then place; suffixes with one head are compared with each other."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        first: dict[tuple[int, int], tuple[int, int]] = {}  # the last window of the slice before, and its first place
        for whole in batches:
            for at in range(0, whole.num_rows, 10_000):
                batch = whole.slice(at, 10_000)
                kind = longs(batch, "kind")
                known = batch.filter(pa.array(kind == 1))
                start = longs(known, "at")
                yield _spans(longs(known, "doc"), longs(known, "crc"), start, start + longs(known, "n"))
                window = batch.filter(pa.array(kind == 2))
                if window.num_rows:
                    own, route, doc, crc, start = (longs(window, c) for c in ("head", "route", "doc", "crc", "at"))
                    # rows are in order of place within a route, and the sort here is stable
                    order = np.lexsort((own, route))
                    ends = runs(route[order], own[order])
                    lead = order[ends[:-1]]
                    names = list(zip(route[lead].tolist(), own[lead].tolist()))
                    places = [first.get(x, y) for x, y in zip(names, zip(doc[lead].tolist(), start[lead].tolist()))]
                    old = np.repeat(np.array(places, np.int64), np.diff(ends), axis=0)
                    later = order[(doc[order] != old[:, 0]) | (start[order] != old[:, 1])]
                    yield _spans(doc[later], crc[later], start[later], start[later] + length)
                    first = {x: y for x, y in zip(names, places) if x[0] == int(route[-1])} | {x: y for x, y in first.items() if x[0] == int(route[-1])}
                open_ = np.flatnonzero(kind == 0)
                head = longs(batch, "head")[open_]
                ends = runs(head)
                size = np.diff(ends)
                alone = np.repeat(size == 1, size)  # but for the first and last, which other batches may hold too
                if len(alone):
                    alone[0] = alone[0] and seen.head != head[0]
                    alone[-1] = False
                open_ = open_[~alone]
                part = batch.take(pa.array(open_))
                doc, crc, place, left, n = (longs(part, c) for c in ("doc", "crc", "at", "left", "n"))
                words = np.frombuffer(b"".join(column(part, "words").to_pylist()), "<u4")
                suffix, a = repeats(head[~alone], doc, place, left, n, words, length, k, seen)
                start = place[suffix] - a
                yield _spans(doc[suffix], crc[suffix], start, start + length)

    return neighbours


def parted_suffixes(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Settled spans, suffixes dealt by their heads and, for heads of more than MANY places, windows dealt by their words."""
    base = docs.select("__doc", "__crc", "text")
    known = cut(known_positions(base, k, length, MANY), "positions")
    # stored, so that Spark knows its size and broadcasts it only below the session's threshold
    heads = cut(known.filter("head is not null").select("head", F.lit(True).alias("many")), "common-heads")
    joint = squeezed(base.select("*", document_key())).join(positions_of(known), "__key")
    suffixes = mapped(joint, _suffixes(k, length), SUFFIXES)
    flagged = suffixes.join(heads, "head", "left").withColumn("many", F.coalesce("many", F.lit(False)) & (F.col("kind") == 0))
    return mapped(flagged, _parted(length), SUFFIXES)


def repeated_passages(docs: DataFrame, length: int = 50, k: int = 16) -> DataFrame:
    """``__doc``, ``__crc``, ``start``, ``n``: passages whose ``length``-word windows start earlier too."""
    dealt = parted_suffixes(docs, length, k).repartition("route").sortWithinPartitions("route", "doc", "at")
    return mapped(dealt, _neighbours(k, length), SPANS).toDF("__doc", "__crc", "start", "n")


def dedup_passages(
    docs: DataFrame, length: int = 50, k: int = 16, text: str = "text", ident: str = "doc_id"
) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``n_words`` and ``n_removed``.

    A passage repeats if ``length`` of its words in a row (runs of bytes other than ASCII white
    space, as they are) also stand in a document of smaller id or earlier in the same one. All
    words of such windows go, with the space that follows them; the earliest copy stays.
    Everything is judged on the input.

    Suffixes are sampled where a run of ``k`` words has the smallest hash of a window: every window
    holds such a position, and equal windows hold the same. Suffixes whose heads of k words
    occur once drop out. Those of heads with more than MANY places part into their windows, which
    meet by hash, so that no task holds a whole head. The others are sorted by head, then, head by
    head, by all their words: neighbours in that array that share enough words form ranges, and within
    a range matches extend to the left. Head, word and window hashes of 64 or 32 bits stand for the words: two different
    windows of one head pass for equal only if their words agree in 64-bit hashes of both parts, or of the whole window.

    NULL text: no words, and it comes back empty. NULL ids: one document after all others. Rows
    of the same id and text are one document and get the same answer. Passages never cross
    documents; shorter documents stay whole. Texts are read whole.
    """
    base = plainly_named(docs).withColumns(document_columns(text, ident)).withColumn("text", F.col(text))
    spans = repeated_passages(base.filter("text is not null"), length, k)
    return without_spans(docs, spans, text, ident, joined=False)
