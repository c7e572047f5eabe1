"""Substring dedup by compacting a De Bruijn graph of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stallwise.llm.common import (
    Prefix, U64, column, cut, document_columns, lists, longs, mapped, merged, mix, plainly_named, runs, signed, squeezed, unsqueezed, words_of,
)
from stallwise.llm.sampling import document_key, known_positions, marked, pieces_of, positions_of
from stallwise.llm.spans import without_spans

HELD = 150_000  # paths that one task combines before they are shuffled
SPANS = "doc long, crc long, start int, n int"


def edges_of(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each path, joined."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)


def _span_arrays(doc: np.ndarray, crc: np.ndarray, start: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    doc, crc, start, after = merged(doc, crc, start, after)
    return [doc, crc, start.astype(np.int32), (after - start).astype(np.int32)]


def earliest(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys and place, and which rows (in it) have their keys at an earlier place."""
    order = np.lexsort((at, doc, *reversed(keys)))
    ends = runs(*(k[order] for k in keys))
    lead = order[np.repeat(ends[:-1], np.diff(ends))]
    return order, (doc[order] != doc[lead]) | (at[order] != at[lead])


def _told(spans: list[np.ndarray], rows: list[np.ndarray], more: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """Settled spans (kind 1, spread over tasks by document) and open rows (kind 0) in one batch."""
    doc, crc, start, n = spans
    none = np.zeros(len(doc), np.int64)
    route = signed(mix(doc.astype(U64)))
    arrays = [np.repeat(np.array([1, 0], np.int8), [len(doc), len(rows[0])])]
    arrays += [np.concatenate(x) for x in zip([route, none, doc, crc, start, n], rows)]
    arrays = [pa.array(x) for x in arrays]
    arrays += [pa.concat_arrays([pa.nulls(len(doc), x.type), x]) for x in more]
    return pa.record_batch(arrays, names)


PATHS = "kind byte, h long, path long, doc long, crc long, at int, n int, edges array<long>"
EDGES = "kind byte, h long, edge long, doc long, crc long, at int, n int"


def _paths(k: int, length: int):
    """Paths of the graph in documents: edges in a row that choose the same repeated node."""

    def combined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, path, doc, crc, at, n, edges = (np.concatenate(x) for x in zip(*held))
        begin = np.cumsum(n) - n
        order, later = earliest([h, path], doc, at)
        gone, stay = order[later], order[~later]
        spans = _span_arrays(doc[gone], crc[gone], at[gone], at[gone] + n[gone] + length - 1)
        rows = [signed(h[stay]), signed(path[stay]), doc[stay], crc[stay], at[stay].astype(np.int32), n[stay].astype(np.int32)]
        listed = lists(signed(edges[edges_of(begin[stay], n[stay])]), n[stay], pa.int64())
        return _told(spans, rows, [listed], ["kind", "h", "path", "doc", "crc", "at", "n", "edges"])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for part in unsqueezed(batches):
            words = words_of(part)
            prefix = Prefix(words.hashes())
            pieces = pieces_of(words, prefix, k, length)
            take = marked(column(part, "marks"), words, pieces.at)
            at, first, last, key = (x[take] for x in (pieces.at, pieces.first, pieces.last, pieces.key))
            owner = words.owner()[first]
            n = last - first + 1
            edge = edges_of(first, n)
            held.append(
                (
                    key,
                    prefix.run(first, last + length) + (at - first).astype(U64),
                    longs(part, "__doc")[owner],
                    longs(part, "__crc")[owner],
                    first - words.first[owner],
                    n,
                    prefix.run(edge, edge + length),
                )
            )
            count += len(first)
            if count >= HELD:
                yield combined(held)
                held, count = [], 0
        if count:
            yield combined(held)

    return paths


def _edges(length: int):
    """Edges of branching paths one by one; those that a task sees again at a later place are settled."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                part = batch.slice(at, 50_000)
                h, doc, crc, place = (longs(part, c) for c in ("h", "doc", "crc", "at"))
                listed = column(part, "edges")
                n = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                edge = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                h, doc, crc, place = np.repeat(h, n), np.repeat(doc, n), np.repeat(crc, n), edges_of(place, n)
                order, later = earliest([h, edge], doc, place)
                gone, stay = order[later], order[~later]
                spans = _span_arrays(doc[gone], crc[gone], place[gone], place[gone] + length)
                rows = [h[stay], edge[stay], doc[stay], crc[stay], place[stay].astype(np.int32), np.full(len(stay), length, np.int32)]
                yield _told(spans, rows, [], ["kind", "h", "edge", "doc", "crc", "at", "n"])

    return edges


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, crc, start, n = (longs(batch, c) for c in ("doc", "crc", "start", "n"))
        arrays = _span_arrays(doc, crc, start, start + n)
        yield pa.record_batch([pa.array(x) for x in arrays], ["doc", "crc", "start", "n"])


def repeated_spans(docs: DataFrame, length: int, k: int) -> DataFrame:
    """``__doc``, ``__crc``, ``start``, ``n``: spans whose ``length``-word windows start earlier too."""
    base = docs.select("__doc", "__crc", "text")
    marks = positions_of(known_positions(base, k, length))
    joint = squeezed(base.select("*", document_key())).join(marks, "__key")
    place = F.struct("doc", "at")

    def judged(df: DataFrame, name: str) -> DataFrame:
        first = F.min(place).over(Window.partitionBy("h", name))
        return df.withColumn("later", (F.col("kind") == 1) | (place != first))

    paths = judged(mapped(joint, _paths(k, length), PATHS), "path")
    paths = cut(paths.withColumn("edges", F.when(~F.col("later"), F.col("edges"))), "paths")
    words = F.when(F.col("kind") == 1, F.col("n")).otherwise(F.col("n") + length - 1)
    whole = paths.filter("later").select("doc", "crc", F.col("at").alias("start"), words.alias("n"))
    firsts = paths.filter("not later")
    branching = firsts.groupBy("h").agg(F.min("path").alias("x"), F.max("path").alias("y")).filter("x <> y").select("h")
    branches = firsts.select("h", "doc", "crc", "at", "edges").join(branching, "h")
    edges = judged(mapped(branches, _edges(length), EDGES), "edge")
    parts = edges.filter("later").select("doc", "crc", F.col("at").alias("start"), "n")
    spans = mapped(whole.union(parts), _settled, SPANS)
    return spans.toDF("__doc", "__crc", "start", "n")


def dedup_substrings(
    docs: DataFrame, length: int = 20, k: int = 6, text: str = "text", ident: str = "doc_id"
) -> DataFrame:
    """``docs`` without words of repeated windows, and ``n_words`` and ``n_removed``.

    A window is ``length`` words in a row; words are runs of bytes other than ASCII white
    space, taken as they are. A window goes if its words also start in a smaller document id
    or earlier in the same document, and a word goes if any such window covers it. All
    windows are judged on the input. The kept words are joined by one space.

    Windows are the edges of a De Bruijn graph. Each belongs to the smallest hash of its
    ``k``-word runs, a sampled node; nodes that occur once in the corpus drop out first.
    Edges in a row at one node form a path. Equal paths meet in one join: where all of a
    node's paths are equal nothing branches, and every path but the earliest goes whole.
    Paths of a branching node part into edges, which are matched one by one. Every path and
    edge carries its document and position, from which the spans follow. Two independent
    64-bit hashes name a path or an edge.

    NULL text: no words. NULL ids: one document after all others. Rows of the same id and
    text are one document and get the same answer; a second text under the same id is
    judged by its own positions. Windows never cross documents. Shorter documents stay whole.
    """
    base = plainly_named(docs).withColumns(document_columns(text, ident)).withColumn("text", F.col(text))
    spans = repeated_spans(base.filter("text is not null"), length, k)
    return without_spans(docs, spans, text, ident, joined=True)
