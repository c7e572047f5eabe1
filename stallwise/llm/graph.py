"""Connected components of a table of links, by Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stallwise.llm.common import cut, mapped
HELD = 400_000  # links that one task holds while it shortens them


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer links with the same components: each node of up to HELD links to its smallest."""

    def shortened(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*links))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = list(range(len(nodes)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        roots = np.array([top(x) for x in range(len(nodes))], np.int64)
        moved = roots != np.arange(len(nodes))
        return pa.record_batch([pa.array(nodes[roots][moved]), pa.array(nodes[moved])], ["a", "b"])

    links, held = [], 0
    for batch in batches:
        if batch.num_rows:
            links.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            held += batch.num_rows
        if held >= HELD:
            yield shortened(links)
            links, held = [], 0
    if links:
        yield shortened(links)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component``: for each end of a link (``a``, ``b``) the smallest node it reaches.

    Each task first replaces its links by a forest. Then, round by round, every node moves to
    the smallest neighbour of its smallest neighbour and the links move along, until none
    joins different nodes. A hub never meets in one task: minima are combined before the
    shuffle, and adaptive execution splits the joins. NULL ends and loops are left out.
    """
    clean = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    rest = cut(mapped(clean, _forest, "a long, b long"), "links")
    moves: list[DataFrame] = []
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        onward = near.select(F.col("a").alias("p"), F.col("p").alias("q"))
        move = cut(near.join(onward, "p").select(F.col("a").alias("node"), F.col("q").alias("to")), "moves")
        moves.append(move)
        first = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        second = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = rest.join(first, "a").join(second, "b").filter("x <> y")
        pairs = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        rest = cut(mapped(pairs, _forest, "a long, b long"), "links")
    if not moves:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = moves[-1].select("node", F.col("to").alias("component"))
    for move in reversed(moves[:-1]):
        later = labels.select(F.col("node").alias("to"), F.col("component").alias("c"))
        labels = move.join(later, "to", "left").select("node", F.coalesce("c", "to").alias("component"))
    return labels
