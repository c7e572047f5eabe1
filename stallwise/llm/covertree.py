"""Exact threshold pairs of vectors by dual traversal of cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stallwise.llm.common import NO_ID, column, cut, mapped, runs, text_buffer
from stallwise.llm.graph import components

BLOCK = 2000  # vectors in one tree
FAN = 32  # cells that one cell is parted into, at most, around centres sampled by hash
LEVELS = 8  # of cells below a label; cells that are still too large have several blocks
SHARE = 16 * BLOCK  # vectors that meet a cell's centres in one task, about
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)  # of unit vectors; below them points are compared
SLACK = 1e-9  # of bounds; links themselves are decided by the cosine alone


class Tree:
    """A cover tree over unit vectors: one root, then a level for each radius.

    Levels are nested (the centre of a node is the centre of one of its children) and every
    point lies within a level's radius of its node's centre. ``centre[i]`` and ``parent[i]`` are by
    node of level i, ``node[i]`` by point, ``reach[i]`` is how far a node's points really go.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.centre: list[np.ndarray] = []
        self.parent: list[np.ndarray] = []
        self.node: list[np.ndarray] = []
        self.reach: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self._add(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(len(x), np.int64))
        for radius in RADII:
            self._split(radius)
        self._children = [self._lists(up) for up in (*self.parent[1:], self.node[-1])]
        self._points = [self._lists(node) for node in self.node]

    @staticmethod
    def _lists(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(up, kind="stable")
        return order, np.searchsorted(up[order], np.arange(up.max() + 2))

    def _add(self, centre: np.ndarray, parent: np.ndarray, node: np.ndarray) -> None:
        dots = np.einsum("ij,ij->i", self.x, self.x[centre[node]])
        reach = np.zeros(len(centre))
        size = np.bincount(node, minlength=len(centre))
        np.maximum.at(reach, node, np.sqrt(np.maximum(2 - 2 * dots, 0)))
        reach[size == 1] = 0
        for held, value in zip((self.centre, self.parent, self.node, self.reach, self.size), (centre, parent, node, reach, size)):
            held.append(value)

    def _split(self, radius: float) -> None:
        old, node = self.centre[-1], self.node[-1]
        fresh = node.copy()  # who stays within the radius keeps the old node, which goes on
        centre, parent = old.tolist(), list(range(len(old)))
        order, ends = self._lists(node)
        near = 1 - radius * radius / 2  # the cosine at that distance
        for a in np.flatnonzero(self.reach[-1] > radius).tolist():
            points = order[ends[a] : ends[a + 1]]
            points = points[self.x[points] @ self.x[old[a]] < near]
            while len(points):
                some = points[:64]
                close = self.x[some] @ self.x[some].T >= near
                chosen = [0]
                for i in range(1, len(some)):
                    if not close[i, chosen].any():
                        chosen.append(i)
                cosine = self.x[points] @ self.x[some[chosen]].T
                best = cosine.argmax(1)
                covered = cosine[np.arange(len(points)), best] >= near
                covered[chosen] = True
                best[chosen] = np.arange(len(chosen))
                fresh[points[covered]] = len(centre) + best[covered]
                centre += some[chosen].tolist()
                parent += [a] * len(chosen)
                points = points[~covered]
        self._add(np.array(centre, np.int64), np.array(parent, np.int64), fresh)

    def children(self, level: int, node: int) -> np.ndarray:
        """Nodes of the next level; below the last level, points."""
        order, ends = self._children[level]
        return order[ends[node] : ends[node + 1]]

    def points(self, level: int, node: int) -> np.ndarray:
        order, ends = self._points[level]
        return order[ends[node] : ends[node + 1]]


class Links:
    """Of each point the weight of its partners; components by hooking roots."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight = weight
        self.count = np.zeros(len(weight), np.int64)
        self.root = np.arange(len(weight))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.weight[b])
        np.add.at(self.count, b, self.weight[a])
        self.join(a, b)

    def add_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each point of a with each of b, without listing the pairs."""
        self.count[a] += self.weight[b].sum()
        self.count[b] += self.weight[a].sum()
        self.join(np.concatenate([a, b]), np.concatenate([np.full(len(a), b[0]), np.full(len(b), a[0])]))

    def add_among(self, a: np.ndarray) -> None:
        self.count[a] += self.weight[a].sum() - self.weight[a]
        self.join(a, np.full(len(a), a[0]))


def dual(left: Tree, right: Tree, shift: int, cosine: float, links: Links) -> None:
    """Link all pairs of a left and a right point at the cosine or above; right ones are ``shift`` on.

    Pairs of nodes go down one level at a time. A pair is dropped if its centres are farther
    apart than the threshold and both reaches; it links all its points at once if they are nearer
    even with both reaches added; else its children meet. With one tree on both sides each pair
    of nodes is met once, and a node also meets itself.
    """
    same = left is right
    limit = math.sqrt(2 - 2 * cosine)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(len(RADII) + 1):
        last = level == len(RADII)
        next_a, next_b = [], []
        alone = left.size[level][a] == 1  # met from the other side, where they share few nodes
        for flipped, chosen in ((False, ~alone), (True, alone)):
            one, two = (right, left) if flipped else (left, right)
            heads_of, others = (b[chosen], a[chosen]) if flipped else (a[chosen], b[chosen])
            order = np.argsort(heads_of, kind="stable")
            heads_of, others = heads_of[order], others[order]
            heads = runs(heads_of)
            for s, e in zip(heads[:-1].tolist(), heads[1:].tolist()):
                rows = one.children(level, heads_of[s])
                groups = [two.children(level, q) for q in others[s:e].tolist()]
                columns = np.concatenate(groups)
                twin = np.repeat(others[s:e] == heads_of[s], [len(g) for g in groups]) & same
                for at in range(0, len(rows), 512):
                    some = rows[at : at + 512]
                    u = level + 1
                    x = one.x[some if last else one.centre[u][some]]
                    dots = x @ two.x[columns if last else two.centre[u][columns]].T
                    if last:
                        p, q = np.nonzero(dots >= cosine)
                    else:  # few are left, and all else looks at them only
                        bound = one.reach[u][some][:, None] + (two.reach[u][columns] + limit + SLACK)
                        p, q = np.nonzero(2 - 2 * dots <= bound * bound)
                    once = ~twin[q] | (some[p] < columns[q])
                    p, q = p[once], q[once]
                    cosines, p, q = dots[p, q], some[p], columns[q]
                    p, q = (q, p) if flipped else (p, q)
                    if last:
                        links.add(p, q + shift)
                        continue
                    single = (left.size[u][p] == 1) & (right.size[u][q] == 1)
                    met = single & (cosines >= cosine)
                    links.add(left.centre[u][p[met]], right.centre[u][q[met]] + shift)
                    p, q, cosines = p[~single], q[~single], cosines[~single]
                    away = np.sqrt(np.maximum(2 - 2 * cosines, 0))
                    sure = away + left.reach[u][p] + right.reach[u][q] <= limit - SLACK
                    for i, j in zip(p[sure].tolist(), q[sure].tolist()):
                        links.add_all(left.points(u, i), right.points(u, j) + shift)
                    next_a.append(p[~sure])
                    next_b.append(q[~sure])
                if same and not last and twin.any():
                    u = level + 1
                    for node in rows[left.size[u][rows] > 1].tolist():
                        if 2 * left.reach[u][node] <= limit - SLACK:
                            links.add_among(left.points(u, node))
                        else:
                            next_a.append(np.array([node]))
                            next_b.append(np.array([node]))
        if not next_a:
            return
        a, b = np.concatenate(next_a), np.concatenate(next_b)
        if same:
            a, b = np.minimum(a, b), np.maximum(a, b)


def linked(x: np.ndarray, weight: np.ndarray, side: np.ndarray, cosine: float) -> Links:
    """Links within the vectors of side 0, or between those of side 0 and side 1."""
    order = np.argsort(side, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    links = Links(weight[order])
    cutoff = int(np.count_nonzero(side == 0))
    left = Tree(x[order[:cutoff]])
    if cutoff == len(x):
        dual(left, left, 0, cosine, links)
    elif cutoff:
        dual(left, Tree(x[order[cutoff:]]), cutoff, cosine, links)
    links.count, links.root = links.count[back], order[links.root][back]
    return links


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes; NULL for those that are null, zero or not finite throughout."""
    for batch in batches:
        vectors = column(batch, "embedding")
        size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # NULL comes as NaN
        out: list[bytes | None] = [None] * len(size)
        for n in np.unique(size[size > 0]).tolist():
            some = np.flatnonzero(size == n)
            x = flat[begin[some][:, None] + np.arange(n)]
            top = np.abs(x).max(1)
            good = np.isfinite(top) & (top > 0)
            x = x[good] / top[good][:, None]
            x /= np.sqrt((x * x).sum(1))[:, None]
            for i, row in zip(some[good].tolist(), x):
                out[i] = row.tobytes()
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec", "label", "unit"])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each vector the nearest centre of its cell and how far it is; centres stand before the vectors."""
    names = ["label", "bytes", "cell", "rep", "weight", "unit"]
    key, known = None, []
    for batch in batches:
        task = column(batch, "task").to_numpy(zero_copy_only=False)
        ends = runs(task).tolist()
        for i, j in zip(ends[:-1], ends[1:]):
            if task[i] != key:
                key, known = task[i], []
            part = batch.slice(i, j - i)
            first = int(np.count_nonzero(column(part, "side").to_numpy(zero_copy_only=False) == 0))
            known += [np.frombuffer(x) for x in column(part.slice(0, first), "unit").to_pylist()]
            for at in range(first, part.num_rows, 2048):
                some = part.slice(at, 2048)
                dots = np.array([np.frombuffer(x) for x in column(some, "unit").to_pylist()]) @ np.array(known).T
                near = dots.argmax(1)
                away = np.sqrt(np.maximum(2 - 2 * dots[np.arange(len(near)), near], 0))
                arrays = [*(column(some, n) for n in names), pa.array(near.astype(np.int32)), pa.array(away)]
                yield pa.record_batch(arrays, [*names, "idx", "away"])


def _pruner(limit: float):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = (column(batch, n).to_pylist() for n in ("a", "b", "ca", "cb", "ra", "rb"))
            for a, b, x, y, ra, rb in zip(*columns):
                if a == b:
                    keep.append(True)
                    continue
                away = math.sqrt(max(2 - 2 * float(np.frombuffer(x) @ np.frombuffer(y)), 0))
                keep.append(away <= limit + ra + rb + SLACK)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["label", "bytes", "a", "b", "ia", "ib"])

    return prune


KEY = ["label", "bytes", "cell"]


def _centres(held: DataFrame, large: DataFrame, level: int) -> DataFrame:
    """Up to FAN vectors of each large cell, numbered; two at least."""
    wanted = F.least(F.lit(FAN), F.ceil(F.col("size") / BLOCK)).alias("wanted")
    mark = F.xxhash64("unit", F.lit(level))
    some = held.join(large.select(*KEY, "size", wanted), KEY).filter(F.pmod(mark, F.col("size")) < 8 * F.col("wanted"))
    order = Window.partitionBy(*KEY).orderBy(mark, "rep")  # of some 8 * wanted rows
    some = some.withColumn("idx", F.row_number().over(order) - 1).filter("idx < wanted")
    some = some.withColumn("found", F.count("*").over(Window.partitionBy(*KEY))).filter("found > 1")
    return some.select(*KEY, "idx", "unit", F.ceil(F.col("size") / SHARE).alias("shares"))


def cells_of(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points with the smallest cell that holds them, and the tree of cells.

    A label is a cell; a cell of more than BLOCK points is parted among centres of its own, and so
    on. Points meet their cell's centres in shares, so no task holds a cell.
    """
    names = [*KEY, "rep", "weight", "unit"]
    held = points.withColumn("cell", F.lit("")).select(*names)
    none = [F.lit(0.0).alias("reach"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("binary").alias("centre")]
    sizes = cut(held.groupBy(*KEY).agg(F.count("*").alias("size")).select(*KEY, "size", *none), "cells")
    leaves, nodes = [], []
    for level in range(LEVELS + 1):
        large = sizes.filter(F.col("size") > BLOCK)
        if level == LEVELS or large.isEmpty():
            leaves.append(held)
            nodes.append(sizes.withColumn("inner", F.lit(False)))
            break
        centres = cut(_centres(held, large, level), "centres")
        split = centres.groupBy(*KEY).agg(F.max("shares").alias("shares"))
        marked = sizes.join(split.select(*KEY, F.lit(True).alias("inner")), KEY, "left")
        nodes.append(marked.withColumn("inner", F.coalesce("inner", F.lit(False))))
        leaves.append(held.join(split, KEY, "left_anti").select(*names))
        share = F.pmod(F.xxhash64("rep"), F.col("shares")).cast("long")
        own = held.join(split, KEY).select(
            F.xxhash64(*KEY, share).alias("task"), F.lit(1).alias("side"), F.lit(0).alias("idx"), *names
        )
        copies = centres.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        copies = copies.select(
            F.xxhash64(*KEY, "share").alias("task"), F.lit(0).alias("side"), "idx", *KEY, F.lit(0).cast("long").alias("rep"),
            F.lit(0).cast("long").alias("weight"), "unit",
        )
        dealt = copies.union(own).repartition("task").sortWithinPartitions("task", "side", "idx")
        schema = "label string, bytes int, cell string, rep long, weight long, unit binary, idx int, away double"
        child = F.concat_ws(".", F.col("cell"), F.col("idx").cast("string"))
        placed = cut(mapped(dealt, _place, schema).withColumn("parent", F.col("cell")).withColumn("cell", child), "placed")
        sizes = placed.groupBy(*KEY, "parent").agg(F.count("*").alias("size"), F.max("away").alias("reach"))
        named = centres.select("label", "bytes", child.alias("cell"), F.col("unit").alias("centre"))
        sizes = cut(sizes.join(named, KEY).select(*KEY, "size", "reach", "parent", "centre"), "cells")
        held = placed.select(*names)
    out, tree = leaves[0], nodes[0]
    for more, others in zip(leaves[1:], nodes[1:]):
        out, tree = out.union(more), tree.union(others)
    return out, cut(tree, "tree")


def near_cells(tree: DataFrame, limit: float) -> DataFrame:
    """Pairs of cells without cells below them that are in reach of each other, each once: label, bytes, a, b.

    The pairs go down the tree of cells together, one level at a time, as ``dual`` does below
    them: a pair whose centres are farther apart than the limit and both reaches is dropped.
    """
    key = ["label", "bytes"]
    told = ["centre", "reach", "inner"]
    kids = tree.filter("parent is not null").select(*key, F.col("parent").alias("up"), "cell", *told)
    down = cut(kids.union(tree.filter("not inner").select(*key, F.col("cell").alias("up"), "cell", *told)), "down")

    def side(up: str, cell: str, centre: str, reach: str, inner: str) -> DataFrame:
        return down.toDF(*key, up, cell, centre, reach, inner)

    roots = tree.filter("parent is null")
    names = ["label", "bytes", "a", "b", "ia", "ib"]
    pairs = roots.select(*key, F.col("cell").alias("a"), F.col("cell").alias("b"), F.col("inner").alias("ia"), F.col("inner").alias("ib"))
    done = pairs.filter("not ia and not ib")
    for _ in range(LEVELS):
        pairs = pairs.filter("ia or ib")
        if pairs.isEmpty():
            break
        pairs = pairs.select(*key, F.col("a").alias("ua"), F.col("b").alias("ub"))
        pairs = pairs.join(side("ua", "a", "ca", "ra", "ia"), [*key, "ua"]).join(side("ub", "b", "cb", "rb", "ib"), [*key, "ub"])
        pairs = pairs.filter("ua <> ub or a <= b")
        schema = "label string, bytes int, a string, b string, ia boolean, ib boolean"
        pairs = cut(mapped(pairs, _pruner(limit), schema), "cell-pairs")
        done = done.union(pairs.filter("not ia and not ib").select(*names))
    return done.select(*key, "a", "b")


def _meeter(cosine: float):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(group: list[np.ndarray]) -> pa.RecordBatch:
            rep, weight, side, unit = group
            x = np.frombuffer(b"".join(unit.tolist())).reshape(len(rep), -1)
            links = linked(x, weight, side, cosine)
            some = np.flatnonzero(links.count)
            arrays = [pa.array(rep[some]), pa.array(rep[links.root[some]]), pa.array(links.count[some])]
            return pa.record_batch(arrays, ["a", "b", "n"])

        tail = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if tail is None else [np.concatenate(x) for x in zip(tail, rows)]
            ends = runs(rows[0]).tolist()
            for i, j in zip(ends[:-2], ends[1:-1]):
                yield told([x[i:j] for x in rows[1:]])
            tail = [x[ends[-2] :] for x in rows] if len(ends) > 1 else rows
        if tail is not None and len(tail[0]):
            yield told(tail[1:])

    return meet


def vector_links(
    vectors: DataFrame, cosine: float = 0.93, ident: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept``: links of vectors with one label, exactly.

    Two vectors of the same label and length link if their cosine, in double precision, is
    at least ``cosine``. ``n_links`` counts a vector's links, ``component_id`` is the smallest id
    reachable by links. Vectors that are NULL, zero or hold a NULL or non-finite component and
    vectors without a label link with nothing. One row per input row; repeated rows link with each
    other. NULL ids rank after all others; their own component_id is NULL.

    Equal unit vectors are one point with a weight. Labels beyond BLOCK points are parted into
    cells around centres of their own, and cells again, until they hold BLOCK points or fewer (every point
    is placed; centres, cells and their pairs stay in Spark). Pairs of cells go down that tree together, and those out of reach
    of each other are dropped. Each remaining pair is a group: a task builds both cover trees and
    walks them together. Groups return, per point, the weight of its links and one link to its
    component in the group, never the pairs.
    """
    units = mapped(vectors.select(
        F.coalesce(F.col(ident).cast("long"), F.lit(NO_ID)).alias("vec"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("embedding"),
    ), _unit, "vec long, label string, unit binary")
    units = cut(units, "units")
    valid = units.filter("label is not null and unit is not null")
    bytes_ = F.octet_length("unit").alias("bytes")
    points = valid.groupBy("label", "unit").agg(F.min("vec").alias("rep"), F.count("*").alias("weight"))
    points = cut(points.select("label", bytes_, "rep", "weight", "unit"), "points")
    placed, tree = cells_of(points)
    placed = cut(placed, "leaves")
    key = ["label", "bytes"]
    blocks = tree.filter("not inner").select(*KEY, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    pairs = near_cells(tree, math.sqrt(2 - 2 * cosine))
    pairs = pairs.join(blocks.toDF(*key, "a", "bi"), [*key, "a"]).join(blocks.toDF(*key, "b", "bj"), [*key, "b"])
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("bi") - 1)))
    pairs = pairs.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("bj") - 1))).filter("a <> b or i <= j")
    pairs = pairs.select(*key, "a", "i", "b", "j", F.xxhash64(*key, "a", "i", "b", "j").alias("task"))
    pairs = cut(pairs, "block-pairs")
    first = pairs.select(*key, F.col("a").alias("cell"), F.col("i").alias("block"), "task", F.lit(0).alias("side"))
    second = pairs.filter("a <> b or i <> j").select(
        *key, F.col("b").alias("cell"), F.col("j").alias("block"), "task", F.lit(1).alias("side")
    )
    placed = placed.join(blocks, KEY)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.join(first.union(second), [*KEY, "block"]).select("task", "rep", "weight", "side", "unit")
    met = mapped(dealt.repartition("task").sortWithinPartitions("task"), _meeter(cosine), "a long, b long, n long")
    met = cut(met, "met")
    counts = met.groupBy("a").agg(F.sum("n").alias("n"))
    labels = components(met.select("a", "b"))
    classes = points.join(counts, points.rep == counts.a, "left").join(labels, points.rep == labels.node, "left")
    classes = classes.select(
        "label", "unit", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    told = units.join(classes, ["label", "unit"], "left")
    component = F.coalesce("component", "vec")
    shown = lambda c: F.when(c != NO_ID, c)
    return told.select(
        shown(F.col("vec")).alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        shown(component).alias("component_id"), (F.col("vec") == component).alias("kept"),
    )
