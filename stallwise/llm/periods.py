"""Periodic runs of words by seeds on diagonals."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from stallwise.llm.common import Prefix, U64, column, mapped, mix, runs, slices, text_buffer
LEAST = 6  # words of a run
REPEATS = 4  # periods of a run
SPLIT = 1 << 16  # bytes of text that are split into words at once


def least_overlap(low: int, least: int = LEAST, repeats: int = REPEATS) -> int:
    """Words that a run shares at least with itself one period on, for periods from ``low`` to below twice that."""
    return min(max(least, repeats * q) - q for q in range(low, 2 * low))


def seeds(words: np.ndarray, first: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, ...]:
    """``place``, ``lag``: neighbouring occurrences of a gram in one document that may belong to a run.

    ``words`` are hashes of the words of some documents, ``first`` where each begins and the last
    ends. Periods are taken in classes from ``low`` to below twice that, with grams as long as
    the least overlap of the class. That is at least a period (``repeats`` is 3 or more), and a stretch
    that repeats with smallest period q holds no occurrence nearer than q of such a gram. So
    neighbouring occurrences are all the pairs needed: never more than words, in each class.
    """
    prefix = Prefix(words)
    ends = np.repeat(first[1:], np.diff(first))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    alive = np.arange(len(words))
    longest = int(np.diff(first).max(initial=0))
    places, lags = [], []
    low, last = 1, 0
    while max(least, repeats * low) <= longest:
        k = least_overlap(low, least, repeats)
        if k < last:
            alive = np.arange(len(words))
        last = k
        at = alive[alive + k <= ends[alive]]
        key = prefix.run(at, at + k) + mix(owner[at].astype(U64))
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        same = (key[1:] == key[:-1]) & (owner[at[1:]] == owner[at[:-1]])
        lag = np.diff(at)
        near = np.flatnonzero(same & (lag >= low) & (lag < 2 * low))
        places.append(at[near])
        lags.append(lag[near])
        # a longer gram that occurs twice begins with a shorter one that does
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        alive = np.sort(at[twice])
        low *= 2
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, lag = np.concatenate(places), np.concatenate(lags)
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def _matching(one: np.ndarray, other: np.ndarray) -> int:
    """How many leading entries agree."""
    step, at = 16, 0
    while at < len(one):
        differ = np.flatnonzero(one[at : at + step] != other[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at += step
        step *= 4
    return len(one)


def periodic_runs(
    ids: np.ndarray, first: np.ndarray, least: int = LEAST, repeats: int = REPEATS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``doc``, ``start``, ``length``, ``period`` of the runs, by document, start and period.

    ``ids`` numbers the words of some documents, equal words alike; ``start`` counts within the
    document. Seeds are extended to both sides, word by word. For each lag the table of what is
    covered furthest passes over seeds inside a stretch that has been extended already.
    """
    covered: dict[int, int] = {}
    found = []
    place, lag = seeds(mix(ids.astype(U64) + U64(1)), first, least, repeats)
    for i, q in zip(place.tolist(), lag.tolist()):
        if i < covered.get(q, -1):
            continue
        doc = int(np.searchsorted(first, i, side="right")) - 1
        begin, end = int(first[doc]), int(first[doc + 1])
        right = i + _matching(ids[i : end - q], ids[i + q : end])
        left = i - _matching(ids[begin:i][::-1], ids[begin + q : i + q][::-1])
        covered[q] = max(right, i + 1)
        length = right - left + q
        if right > i and length >= max(least, repeats * q):
            found.append((doc, left - begin, length, q))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    doc, start, length, period = np.array(sorted(found), np.int64).T
    # one stretch has one smallest period, which came from the lowest class
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    order = np.lexsort((period[new], start[new], doc[new]))
    return doc[new][order], start[new][order], length[new][order], period[new][order]


def numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of some texts the number of each word, where each text begins in them, and the words by number."""
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    parts, first = [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        count, at = 0, a
        while at < b:
            to = min(at + SPLIT, b)
            while to < b and raw[to] not in b" \t\n\v\f\r":
                to += 1
            words = raw[at:to].split()  # at the six bytes that part words, and no others
            parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
            count += len(words)
            at = to
        first.append(first[-1] + count)
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.array(first, np.int64), list(known)


def doubled(ids: np.ndarray, ident: int | None) -> np.ndarray:
    """The words of a document with a part of it said over again, as a hash of its id decides."""
    h = zlib.crc32(str(ident).encode()) if ident is not None else 1
    n = len(ids)
    if h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return ids[np.where(i < a, i, a + (i - a) % p)]


def _best(start: list[int], length: list[int], period: list[int]) -> tuple[int | None, ...]:
    """Start, length, period and thousandths of the exponent of the run that repeats most often."""
    best = None
    for s, n, q in zip(start, length, period):  # by start, then period: the first of equals stays
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])


FOUND = T.StructType(
    [T.StructField("n_runs", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("start", "length", "period", "exponent_milli")]
    + [T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("collapsed", T.StringType())]
)


def _finder(text: str, ident: str | None, names: list[str], least: int, repeats: int, digests: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            ids, first, words = numbered(*text_buffer(column(part, text)))
            if ident is not None:
                idents = column(part, ident).to_pylist()
                cuts = zip(first[:-1].tolist(), first[1:].tolist(), idents)
                ids = np.concatenate([np.zeros(0, np.int64), *(doubled(ids[a:b], i) for a, b, i in cuts)])
            doc, start, length, period = periodic_runs(ids, first, least, repeats)
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, first[doc] + start + period, 1)
            np.add.at(change, first[doc] + start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            own: dict[int, tuple[int, int]] = {}
            ends = runs(doc).tolist()
            for i, j in zip(ends[:-1], ends[1:]):
                own[int(doc[i])] = (i, j)
            rows = []
            for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                i, j = own.get(d, (0, 0))
                s, n, q = start[i:j].tolist(), length[i:j].tolist(), period[i:j].tolist()
                left = b" ".join(map(words.__getitem__, ids[a:b][kept[a:b]].tolist()))
                if digests:
                    lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s, n, q)).encode()
                    rows.append((j - i, *_best(s, n, q), sha256(lines).hexdigest(), sha256(left).hexdigest()))
                else:
                    rows.append((j - i, *_best(s, n, q), [list(x) for x in zip(s, n, q)], left))
            told = list(zip(*rows)) or [()] * 7
            arrays = [column(part, n) for n in names] + [pa.array(c, pa.int64()) for c in told[:5]]
            if digests:
                arrays += [pa.array(c, pa.string()) for c in told[5:]]
            else:
                arrays += [pa.array(told[5], pa.list_(pa.list_(pa.int64()))), pa.array(told[6], pa.binary()).cast(pa.string())]
            made = [*FOUND.names[:5], *(("runs_sha256", "collapsed_sha256") if digests else FOUND.names[5:])]
            yield pa.record_batch(arrays, [*names, *made])

    return find


def with_runs(
    docs: DataFrame, text: str = "text", least: int = LEAST, repeats: int = REPEATS, double_by: str | None = None, digests: bool = False
) -> DataFrame:
    """``docs`` and its periodic runs: ``n_runs``, the foremost one, ``runs`` and ``collapsed``.

    Words are runs of bytes other than white space, numbered from 0. A run is a stretch of words
    with smallest period q (words q apart are equal) of at least ``least`` words and ``repeats`` periods that
    no neighbouring word extends. ``runs`` has [start, length, period] by start, then period;
    ``start``, ``length``, ``period``, ``exponent_milli`` are those of the run with most periods
    (of equals the first), NULL without runs. ``collapsed`` has the words joined by one space,
    without those that a run repeats, which is all but its first period. With ``digests`` both come as
    SHA-256 (``runs_sha256`` of lines "start,length,period", ``collapsed_sha256``).

    Each document is one row and is searched by itself in the task that reads it, without a shuffle:
    grams of the least overlap are indexed for classes of periods, neighbouring occurrences give
    a place and a lag, and stretches are extended word by word. ``double_by`` names an id column: one
    document in ten, by a hash of its id, has a part said over again first; a NULL id never.

    NULL or blank text: no words, no runs, empty ``collapsed``. Repeated rows are told each by itself;
    an empty table gives an empty one; input columns with the names of new ones are replaced.
    """
    if repeats < 3 or least < 2:
        raise ValueError("runs need three periods and two words at least, so that neighbouring seeds find them")
    made = T.StructType(
        FOUND.fields[:5] + [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]
        if digests
        else FOUND.fields
    )
    names = [c for c in docs.columns if c not in made.names]
    needed = [n for n in (text, double_by) if n is not None]
    if set(needed) - set(names):
        raise ValueError(f"columns {needed} are needed, and none of them may be named like a result: {made.names}")
    schema = T.StructType([docs.schema[n] for n in names] + made.fields)
    return mapped(docs.select(*names), _finder(text, double_by, names, least, repeats, digests), schema)
