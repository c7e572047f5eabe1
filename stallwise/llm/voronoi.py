"""Exact top-k inner products by a Voronoi kNN join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stallwise.llm.common import NO_ID, column, cut, mapped, runs, text_buffer
PIVOTS = 256  # of all lengths of vectors together, sampled by hash; the bound of all summaries
QUERIES = 16_384  # in one group
SHARD = 65_536  # rows that meet a group in one task, about
SHARDS = 16  # at least
MOST = 1 << 24  # of a component in whole numbers; larger ones count as not finite
SLACK = 1e-6  # relative, of bounds; scores are whole numbers
Summaries = dict[int, tuple[np.ndarray, np.ndarray]]  # by length: ids and vectors of members next to the pivots


def _whole(scale: float):
    """Components as whole numbers, in bytes; NULL where a vector takes no part."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = column(batch, "embedding")
            size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            flat = vectors.flatten()
            x = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale)  # NULL comes as NaN
            with np.errstate(invalid="ignore"):
                bad = ~(np.abs(x) <= MOST)
            spoilt = np.concatenate([[0], np.cumsum(bad)])
            good = ~vectors.is_null().to_numpy(zero_copy_only=False) & (spoilt[ends[1:]] == spoilt[ends[:-1]])
            raw = np.where(bad, 0, x).astype(np.int32)
            made = [raw[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), good.tolist())]
            yield pa.record_batch([column(batch, "vec"), pa.array(size.astype(np.int32)), pa.array(made, pa.binary())], ["vec", "size", "x"])

    return whole


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as rows, in double precision: sums of products are exact below 2**53."""
    held, _ = text_buffer(vectors)
    return np.frombuffer(held.tobytes(), np.int32).reshape(len(vectors), size).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exactly."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    size = column(batch, "size").to_numpy(zero_copy_only=False)
    for n in np.unique(size).tolist():
        some = np.flatnonzero(size == n)
        yield n, some, batch.take(pa.array(some))


def _placer(pivots: dict[int, np.ndarray]):
    """The cell of the nearest pivot, and how far it is; vectors of a length without pivots lie around the origin."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for size, some, part in by_size(batch):
                x = matrix(column(part, "x"), size)
                known = pivots.get(size, np.zeros((1, size)))
                for at in range(0, len(x), 1024):
                    y = x[at : at + 1024]
                    square = (known * known).sum(1) - 2 * (y @ known.T)
                    nearest = square.argmin(1)
                    cell[some[at : at + 1024]] = nearest
                    away[some[at : at + 1024]] = np.sqrt(((y - known[nearest]) ** 2).sum(1))
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return place


def _bounder(summaries: Summaries, k: int):
    """Of each query the k-th best score among the summaries' members; NULL if there are fewer."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.zeros(batch.num_rows, np.int64)
            known = np.zeros(batch.num_rows, bool)
            vec = column(batch, "vec").to_numpy(zero_copy_only=False)
            for size, some, part in by_size(batch):
                ids, members = summaries.get(size, (np.zeros(0, np.int64), np.zeros((0, size))))
                if len(ids) <= k:
                    continue
                x = matrix(column(part, "x"), size)
                for at in range(0, len(x), 1024):
                    here = some[at : at + 1024]
                    score = products(x[at : at + 1024], members)
                    own = vec[here][:, None] == ids[None, :]
                    score[own] = np.iinfo(np.int64).min
                    enough = (~own).sum(1) >= k
                    least[here] = np.partition(score, len(ids) - k, 1)[:, len(ids) - k]
                    known[here] = enough
            made = pa.array(least, mask=~known)
            yield pa.record_batch([*batch.columns, made], [*batch.schema.names, "least"])

    return bound


@dataclass
class Cell:
    """What is known of the queries of one cell."""

    pivot: np.ndarray
    reach: float  # of its queries, from the pivot
    least: float  # no query of the cell needs a lower score
    group: int  # first of its groups
    groups: int


def _needed(x: np.ndarray, norm: np.ndarray, cell: Cell) -> np.ndarray:
    """Rows that may score ``least`` with some query of the cell: q.x = p.x + (q - p).x <= p.x + reach * |x|."""
    if cell.least == -np.inf:
        return np.ones(len(x), bool)
    most = x @ cell.pivot + cell.reach * norm
    return most >= cell.least - SLACK * (1 + abs(cell.least) + norm * cell.reach)


def _dealer(cells: dict[int, list[Cell]], shards: dict[int, int]):
    """Each row to the groups of queries that need it, once to each, in the shard of its id."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, part in by_size(batch):
                known = cells.get(size, [])
                if not known:
                    continue
                x = matrix(column(part, "x"), size)
                norm = np.sqrt((x * x).sum(1))
                wanted: dict[int, np.ndarray] = {}
                for cell in known:
                    needed = _needed(x, norm, cell)
                    for group in range(cell.group, cell.group + cell.groups):
                        wanted[group] = wanted.get(group, False) | needed
                shard = column(part, "mark").to_numpy(zero_copy_only=False) % shards[size]
                for group, needed in wanted.items():
                    some = np.flatnonzero(needed)
                    if len(some):
                        n = len(some)
                        held = part.take(pa.array(some))
                        fixed = [pa.array(np.full(n, v, np.int32)) for v in (size, group)]
                        where = [pa.array(shard[some].astype(np.int32)), pa.array(np.ones(n, np.int32))]
                        rest = [column(held, "vec"), column(held, "x"), pa.nulls(n, pa.int64()), column(held, "cell"), column(held, "mark")]
                        yield pa.record_batch([*fixed, *where, *rest], DEALT)

    return deal


DEALT = ["size", "grp", "shard", "side", "vec", "x", "least", "cell", "mark"]


class Best:
    """The k best partners of some queries so far, ties to the smaller id."""

    def __init__(self, vec: np.ndarray, mark: np.ndarray, x: np.ndarray, least: np.ndarray, k: int) -> None:
        self.vec, self.mark, self.x, self.least, self.k = vec, mark, x, least.copy(), k
        self.query = self.partner = self.score = np.zeros(0, np.int64)

    def meet(self, vec: np.ndarray, x: np.ndarray, which: np.ndarray) -> None:
        for at in range(0, len(which), 512):
            here = which[at : at + 512]
            score = products(self.x[here], x)
            a, b = np.nonzero((score >= self.least[here][:, None]) & (self.vec[here][:, None] != vec[None, :]))
            self._add(here[a], vec[b], score[a, b])

    def _add(self, query: np.ndarray, partner: np.ndarray, score: np.ndarray) -> None:
        query, partner, score = (np.concatenate(p) for p in ((self.query, query), (self.partner, partner), (self.score, score)))
        order = np.lexsort((partner, -score, query))
        query, partner, score = query[order], partner[order], score[order]
        ends = runs(query)
        rank = np.arange(len(query)) - np.repeat(ends[:-1], np.diff(ends))
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        keep = rank < self.k
        self.query, self.partner, self.score = query[keep], partner[keep], score[keep]


def _solver(cells: dict[int, list[Cell]], k: int):
    """Best partners of a group's queries in one shard: queries come first, then rows, in batches."""
    low = np.iinfo(np.int64).min

    def told(best: Best) -> pa.RecordBatch:
        who = [pa.array(best.vec[best.query]), pa.array(best.mark[best.query])]
        return pa.record_batch([*who, pa.array(best.partner), pa.array(best.score)], ["query", "mark", "vec", "score"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, best, mine = None, [], None, {}
        for batch in batches:
            rows = [column(batch, n).to_numpy(zero_copy_only=False) for n in DEALT[:4]]
            ends = runs(*rows).tolist()
            for i, j in zip(ends[:-1], ends[1:]):
                size, group, shard, side = (int(r[i]) for r in rows)
                if here != (size, group, shard):
                    if best is not None:
                        yield told(best)
                    here, held, best = (size, group, shard), [], None
                part = batch.slice(i, j - i)
                if side == 0:
                    held.append(part)
                    continue
                if not held and best is None:
                    continue
                if best is None:
                    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                    least = column(table, "least").fill_null(low).to_numpy(zero_copy_only=False)
                    best = Best(column(table, "vec").to_numpy(), column(table, "mark").to_numpy(), matrix(column(table, "x"), size), least, k)
                    cell = column(table, "cell").to_numpy()
                    mine = {int(c): np.flatnonzero(cell == c) for c in np.unique(cell)}
                for at in range(0, part.num_rows, 2048):
                    some = part.slice(at, 2048)
                    vec, x = column(some, "vec").to_numpy(), matrix(column(some, "x"), size)
                    norm = np.sqrt((x * x).sum(1))
                    for c, which in mine.items():
                        needed = _needed(x, norm, cells[size][c])
                        if needed.any():
                            best.meet(vec[needed], x[needed], which)
        if best is not None:
            yield told(best)

    return solve


def top_products(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, ident: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: of each query its ``k`` highest inner products, exactly.

    Vectors are taken as floor(``scale`` * component). Queries are the rows whose id is divisible by
    ``every``; their candidates are all rows of another id and the same length, with fewer than
    ``k`` all of them. Ties go to the smaller id.

    Pivots are sampled by hash, PIVOTS at most, and every row goes to the cell of the nearest. A cell's
    summary is its k + 1 members next to the pivot; the k-th best score of a query with the members
    of all summaries is a bound that its answers reach. Queries of a cell form groups of QUERIES at most,
    small cells share one. With the reach of a cell's queries around their pivot p and the
    lowest of their bounds, a row x is needed only if p.x + reach * |x| reaches that bound: it is sent
    once to each group that needs it. A group's rows are dealt into shards, each
    solved by a task that holds the queries and streams the rows; only scores that reach a query's bound leave
    it, ``k`` at most, and a last ranking joins the shards. On the driver there are only pivots and summaries.

    Vectors that are NULL or hold a NULL or non-finite component, or one beyond MOST / ``scale``, take
    no part. A repeated query row is asked once, different vectors under one id each; repeated
    candidates count each. NULL ids
    are no queries, and as candidates rank after all others. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.coalesce(F.col(ident).cast("long"), F.lit(NO_ID)).alias("vec"), F.col(vector).cast("array<double>").alias("embedding"))
    rows = mapped(rows, _whole(scale), "vec long, size int, x binary").filter("x is not null")
    rows = cut(rows, "whole-vectors")
    sizes = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(PIVOTS).collect()}
    total = max(1, sum(sizes.values()))
    sample = rows.filter(F.pmod(F.xxhash64("x"), F.lit(max(1, total // (8 * PIVOTS)))) == 0).select("size", "x").distinct()
    pivots: dict[int, list[bytes]] = {}
    for r in sample.orderBy(F.xxhash64("x", "size"), "x").limit(PIVOTS).collect():
        pivots.setdefault(r["size"], []).append(bytes(r["x"]))
    known = {n: np.array([np.frombuffer(b, np.int32) for b in sorted(v)], np.float64).reshape(len(v), n) for n, v in pivots.items()}
    placed = mapped(rows, _placer(known), "vec long, size int, x binary, cell int, away double")
    placed = cut(placed.withColumn("mark", F.pmod(F.xxhash64("vec", "x"), F.lit(1 << 30)).cast("int")), "cells")

    nearest = F.row_number().over(Window.partitionBy("size", "cell").orderBy("away", "vec"))
    members = placed.filter(F.col("size").isin(*known)) if known else placed.limit(0)
    members = members.withColumn("rank", nearest).filter(F.col("rank") <= k + 1).select("size", "vec", "x")
    gathered: dict[int, list[tuple[int, bytes]]] = {}
    for r in members.collect():  # PIVOTS * (k + 1) rows at most
        gathered.setdefault(r["size"], []).append((r["vec"], bytes(r["x"])))
    summaries: Summaries = {
        n: (np.array([v for v, _ in m], np.int64), np.array([np.frombuffer(x, np.int32) for _, x in m], np.float64).reshape(len(m), n))
        for n, m in gathered.items()
    }
    asked = placed.filter((F.col("vec") % every == 0) & (F.col("vec") != NO_ID)).dropDuplicates(["vec", "size", "x"])
    queries = mapped(asked, _bounder(summaries, k), "vec long, size int, x binary, cell int, away double, mark int, least long")
    queries = cut(queries, "queries")

    # one row for each cell: bounded by the pivots, and by one cell for each length without any
    bounds = queries.groupBy("size", "cell").agg(
        F.count("*").alias("n"), F.max("away").alias("reach"), F.min("least").alias("least"), F.count_if(F.col("least").isNull()).alias("open")
    )
    cells: dict[int, dict[int, Cell]] = {}
    group, room = 0, 0
    for r in sorted(bounds.collect(), key=lambda r: (r["size"], r["cell"])):
        many = -(-r["n"] // QUERIES)
        if many > 1 or r["n"] > room or r["size"] not in cells:
            group += 1
            room = 0 if many > 1 else QUERIES
        room -= min(room, r["n"])
        pivot = known.get(r["size"], np.zeros((1, r["size"])))[r["cell"]]
        least = -np.inf if r["open"] else float(r["least"])
        cells.setdefault(r["size"], {})[r["cell"]] = Cell(pivot, r["reach"], least, group, many)
        group += many - 1
    shards = {n: max(SHARDS, -(-sizes.get(n, SHARD) // SHARD)) for n in cells}
    out = "size int, grp int, shard int, side int, vec long, x binary, least long, cell int, mark int"
    flat = {n: list(c.values()) for n, c in cells.items()}
    data = mapped(placed, _dealer(flat, shards), out)
    named = [(n, c, cell.group, cell.groups, shards[n]) for n, own in cells.items() for c, cell in own.items()]
    plan = spark.createDataFrame(named, "size int, cell int, first int, groups int, shards int")
    asking = queries.join(F.broadcast(plan), ["size", "cell"])  # a row for each cell
    asking = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    own_group = (F.col("first") + F.pmod(F.col("mark"), F.col("groups"))).alias("grp")
    asking = asking.select("size", own_group, "shard", F.lit(0).alias("side"), "vec", "x", "least", "cell", "mark")
    key = ["size", "grp", "shard"]
    dealt = asking.union(data).repartition(*key).sortWithinPartitions(*key, "side", "vec")
    found = mapped(dealt, _solver(cells, k), "query long, mark int, vec long, score long")
    best = Window.partitionBy("query", "mark").orderBy(F.desc("score"), "vec")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(
        F.col("query").alias("query_id"), "rank", F.when(F.col("vec") != NO_ID, F.col("vec")).alias("vec_id"), "score"
    )
