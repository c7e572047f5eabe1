"""How far the words of sources differ: counts by packed words, exact divergences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise.llm.common import U64, Words, blobs, column, cut, mapped, runs, slices, text_buffer
TERMS_AT_ONCE = 4 << 20  # bytes of text whose terms are sorted together
LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
SOURCES = 256  # sources of a language in one block of pairs
SHARD = 100_000  # counts of a language in one shard of its terms, about
SHARDS = 8  # of a language at least
CELLS = 1 << 20  # pairs times terms that are held at once
_OTHER = np.ones(256, bool)  # bytes that no term holds
_OTHER[65:91] = _OTHER[97:123] = _OTHER[128:] = False


def radix_order(*words: np.ndarray) -> np.ndarray:
    """A stable order by the given uint64 words, the first one weighs most; digits of 16 bits from the last on."""
    n = len(words[0])
    order = np.arange(n)
    for word in reversed(words):
        differ = np.bitwise_or.reduce(word ^ word[0]) if n else U64(0)
        for shift in range(0, 64, 16):
            if int(differ) >> shift & 0xFFFF:
                digit = (word >> U64(shift)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed(data: np.ndarray, start: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    """Bytes ``at`` to ``at`` + 8 of each term as a number that sorts like them; zeros behind its end."""
    every = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    have = np.clip(size - at, 0, 8)
    word = every[start + at].astype(U64)
    gone = (U64(8) * (8 - have).astype(U64)) % U64(64)
    return np.where(have > 0, (word >> gone) << gone, U64(0))


def _spelled(words: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of packed terms, and their sizes."""
    wide = np.stack([w.astype(">u8").view(np.uint8).reshape(-1, 8) for w in words], 1).reshape(len(size), -1)
    return wide[np.arange(wide.shape[1]) < size[:, None]], size


def _counted(same: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sorted occurrences (by term, then document): where each term and group begins, occurrences, documents."""
    ends = runs(same, group)
    fresh = np.ones(len(doc), np.int64)
    fresh[1:] = (same[1:] != same[:-1]) | (doc[1:] != doc[:-1])
    begin = ends[:-1]
    return begin, np.diff(ends), np.add.reduceat(fresh, begin) if len(begin) else begin


def _numbers(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """Of each row of sorted keys the number of its distinct key."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def term_counts(words: Words, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By buckets of length: bytes and sizes of terms, their group, occurrences and documents in it.

    ``group`` is by text, in ascending order, so that a stable sort by term leaves each term's
    occurrences by group and text. Terms to 8 bytes are one word and to 16 bytes two, radix-sorted and
    counted by runs; longer ones are sorted as bytes, in buckets of doubling width.
    """
    owner = words.owner()
    size = words.end - words.start
    data = np.concatenate([words.data, np.zeros(16, np.uint8)])
    for low, parts in ((0, 1), (8, 2)):
        some = np.flatnonzero((size > low) & (size <= 8 * parts))
        keys = [_packed(data, words.start[some], size[some], 8 * i) for i in range(parts)]
        if len(some):
            order = radix_order(*keys)
            keys, doc = [k[order] for k in keys], owner[some[order]]
            begin, n, docs = _counted(_numbers(keys), group[doc], doc)
            yield (*_spelled([k[begin] for k in keys], size[some[order[begin]]]), group[doc[begin]], n, docs)
    width = 16
    while width < int(size.max(initial=0)):
        some = np.flatnonzero((size > width) & (size <= 2 * width))
        width *= 2
        if not len(some):
            continue
        wide = np.zeros((len(some), width), np.uint8)
        for i, (a, b) in enumerate(zip(words.start[some].tolist(), words.end[some].tolist())):
            wide[i, : b - a] = words.data[a:b]
        key = wide.view(f"S{width}").ravel()
        order = np.argsort(key, kind="stable")
        doc = owner[some[order]]
        begin, n, docs = _counted(_numbers([key[order]]), group[doc], doc)
        first = order[begin]
        yield wide[first][np.arange(width) < size[some[first]][:, None]], size[some[first]], group[doc[begin]], n, docs


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", TERMS_AT_ONCE):
        pairs = list(zip(column(part, "lang").to_pylist(), column(part, "source").to_pylist()))
        groups = sorted(set(pairs))
        number = {g: i for i, g in enumerate(groups)}
        group = np.array([number[p] for p in pairs], np.int64)
        order = np.argsort(group, kind="stable")
        data, offsets = text_buffer(column(part, "text").take(pa.array(order)))
        langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
        words = Words(data, offsets, lower=True, separator=_OTHER)
        for spelled, size, which, n, docs in term_counts(words, group[order]):
            at = pa.array(which)
            term = blobs(np.ascontiguousarray(spelled), size).cast(pa.string())
            made = [langs.take(at), sources.take(at), term, pa.array(n), pa.array(docs.astype(np.int64))]
            yield pa.record_batch(made, ["lang", "source", "term", "n", "docs"])


def scaled_share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * n / total), exactly: long division by steps of a thousand, so nothing overflows
    below 9e15 occurrences."""
    left, out = n, F.lit(0).cast("long")
    for _ in range(3):
        part = left * 1000
        out = out * 1000 + F.call_function("div", part, total)
        left = part % total
    return out + 1


def _share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As ``scaled_share``."""
    left, out = n, np.zeros_like(n)
    for _ in range(3):
        part = left * 1000
        out = out * 1000 + part // total
        left = part % total
    return out + 1


def _divergences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms of one shard for all pairs of two blocks of sources, and how many terms they were.

    Rows of a language, shard and pair of blocks: first the sources of both blocks with their
    totals (``lead``), then the terms, by number.
    """
    keys = ["lang", "shard", "i", "j"]

    def told(key, head, total, seen) -> pa.RecordBatch:
        a, b = head[0]["number"], head[1]["number"]
        shape = len(a), len(b)
        arrays = [
            pa.array([key[0]] * total.size, pa.string()),
            pa.array(np.broadcast_to(a[:, None], shape).ravel()), pa.array(np.broadcast_to(b[None, :], shape).ravel()),
            pa.array(total.ravel()), pa.array(np.full(total.size, seen)),
        ]
        return pa.record_batch(arrays, ["lang", "a", "b", "value", "seen"])

    def add(head, total, terms) -> int:
        term, side, number, n = (np.concatenate(x) for x in zip(*terms))
        ends = runs(term)
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        step = max(1, CELLS // max(1, total.size))
        for at in range(0, len(ends) - 1, step):
            to = min(at + step, len(ends) - 1)
            some = slice(int(ends[at]), int(ends[to]))
            share = []
            for s in (0, 1):
                mine = side[some] == s
                place = np.searchsorted(head[s]["number"], number[some][mine])
                count = np.ones((to - at, len(head[s]["number"])), np.int64)
                count[row[some][mine] - at, place] += n[some][mine]
                share.append(_share(count, np.broadcast_to(head[s]["total"], count.shape)))
            p, q = share[0][:, :, None], share[1][:, None, :]
            total += ((p - q) * (p - q) // q).sum(0)
        return len(ends) - 1

    key, head, total, seen, tail = None, None, None, 0, None
    for batch in batches:
        rows = {n: column(batch, n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        lead = rows["lead"]
        ends = runs(*(rows[k] for k in keys)).tolist()
        for i, j in zip(ends[:-1], ends[1:]):
            here = tuple(rows[k][i] for k in keys)
            if key != here:
                if tail is not None:
                    seen += add(head, total, tail)
                    tail = None
                if key is not None and total is not None:
                    yield told(key, head, total, seen)
                key, head, total, seen = here, ({"number": [], "total": []}, {"number": [], "total": []}), None, 0
            span = np.arange(i, j)
            for r in span[lead[i:j]].tolist():
                head[rows["side"][r]]["number"].append(rows["number"][r])
                head[rows["side"][r]]["total"].append(rows["total"][r])
            span = span[~lead[i:j]]
            if not len(span):
                continue
            if total is None:
                total = _ready(head)
            # the last term of a batch may go on in the next one
            part = [rows[n][span] for n in ("id", "side", "number", "n")]
            whole = [part] if tail is None else [*tail, part]
            joined = [np.concatenate(x) for x in zip(*whole)]
            cut_at = int(runs(joined[0])[-2])
            if cut_at:
                seen += add(head, total, [[x[:cut_at] for x in joined]])
            tail = [[x[cut_at:] for x in joined]]
    if tail is not None:
        seen += add(head, total, tail)
    if key is not None and total is not None:
        yield told(key, head, total, seen)


def _ready(head) -> np.ndarray:
    for side in head:
        order = np.argsort(np.array(side["number"], np.int64))
        side["number"] = np.array(side["number"], np.int64)[order]
        side["total"] = np.array(side["total"], np.int64)[order]
    return np.zeros((len(head[0]["number"]), len(head[1]["number"])), np.int64)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(
    docs: DataFrame, terms: int = 200, least: int = LEAST_DOCUMENTS, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: what sets each source of a language apart.

    Terms are runs of A-Z, a-z and characters beyond ASCII, A-Z in lower case. A language keeps the
    V terms that stand in at least ``least`` of its documents. With N the occurrences of kept terms in a
    group (a source of a language, or the language), a kept term with c of them has the share
    p = 1 + floor(10^9 * (c + 1) / (N + V)), also if c is 0, and diverges from a share q by
    f = floor((p - q)^2 / q). All of it is whole numbers, exact to 9e15 occurrences.

    Part ``pair``: each other source of the language and the sum of f over all kept terms. Part
    ``term``: kept terms of the source more frequent there than in its language, the ``terms`` first
    ones. Ranks from 1 by value, highest first, then by the bytes of the item.

    Tasks count what they read in packed, radix-sorted words, so a hot source sends one row for a
    term and slice, combined before the shuffle by (language, term). Pairs are summed in tasks by
    language, shard of its terms, and two blocks of SOURCES sources; terms that no source of the blocks
    holds have one divergence for all and are never listed. Only sums leave a task.

    NULL text, language or source: ''. Each row is a document, repeated rows too. Groups without terms have
    pairs with value 0 if the language keeps no term. An empty table gives an empty one.
    """
    base = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    group = ["lang", "source"]
    found = mapped(base, _counter, "lang string, source string, term string, n long, docs long")
    counts = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = cut(counts, "term-counts")
    total = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    total = cut(total.withColumn("id", F.monotonically_increasing_id()), "terms")
    kept = cut(counts.drop("docs").join(total.drop("docs"), ["lang", "term"]), "kept-terms")
    # every occurring group with its N, its language's N and V
    own = kept.groupBy(*group).agg(F.sum("n").alias("total"))
    groups = base.select(*group).distinct().join(own, group, "left").withColumn("total", F.coalesce("total", F.lit(0)))
    sizes = total.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total"))
    groups = groups.join(sizes, "lang", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("v", "lang_total")})
    ordered = Window.partitionBy("lang").orderBy("source")
    groups = cut(groups.withColumn("number", F.row_number().over(ordered).cast("long") - 1), "groups")

    p = scaled_share(F.col("n") + 1, F.col("total") + F.col("v"))
    q = scaled_share(F.col("all") + 1, F.col("lang_total") + F.col("v"))
    told = kept.join(groups, group).withColumns({"p": p, "q": q}).filter("p > q")
    told = told.select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    told = told.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= terms)

    block = F.floor(F.col("number") / SOURCES)
    most = kept.groupBy("lang").agg(F.greatest(F.ceil(F.count("*") / SHARD), F.lit(SHARDS)).alias("shards"))
    lasts = groups.groupBy("lang").agg(F.max(block).alias("last")).join(most, "lang")
    placed = kept.join(groups, group).join(lasts, "lang").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))
    placed = placed.select("lang", "number", "last", "shard", "id", "n", F.lit(0).cast("long").alias("total"), F.lit(False).alias("lead"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    heads = groups.filter("v > 0").join(lasts, "lang").withColumn("shard", every)
    heads = heads.select(
        "lang", "number", "last", "shard", F.lit(-1).cast("long").alias("id"), F.lit(0).cast("long").alias("n"), (F.col("total") + F.col("v")).alias("total"), F.lit(True).alias("lead")
    )
    rows = placed.union(heads)
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    one = rows.withColumn("other", others).select("*", F.lit(0).alias("side"), block.alias("i"), F.col("other").alias("j"))
    two = rows.withColumn("other", others).select("*", F.lit(1).alias("side"), F.col("other").alias("i"), block.alias("j"))
    key = ["lang", "shard", "i", "j"]
    dealt = one.union(two).select(*key, "side", "number", "n", "total", "id", "lead")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, F.desc("lead"), "id")
    sums = mapped(dealt, _divergences, "lang string, a long, b long, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    side = lambda n: groups.select("lang", F.col("number").alias(n), F.col("source").alias(f"source_{n}"), F.col("total").alias(f"total_{n}"), "v")
    pairs = side("a").join(side("b").drop("v"), "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
    none = divergence(
        scaled_share(F.lit(1).cast("long"), F.greatest(F.col("total_a") + F.col("v"), F.lit(1))),
        scaled_share(F.lit(1).cast("long"), F.greatest(F.col("total_b") + F.col("v"), F.lit(1))),
    )
    value = F.coalesce("value", F.lit(0)) + (F.col("v") - F.coalesce("seen", F.lit(0))) * none
    pairs = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.union(told)
