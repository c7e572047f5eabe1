"""Benchmark decontamination by the q-gram lemma over diagonal bands."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stallwise.functions.skew import hot_keys, salted_join
from stallwise.llm.common import U64, Words, column, cut, longs, mapped, mix, plainly_named, runs, signed, slices, text_buffer

Q = 12
BITMAP = 22  # log2 of the entries that sort out q-grams of no item
BLOCK_BYTES = 2_000_000  # of items that one task holds; a smaller benchmark goes to every task
SIEVE = 28  # log2 of the bits that sort out hashes of no anchor: 32 MB at most, 15 at least
LEAK = "array<struct<item_id:bigint,start:int,after:int,edits:int>>"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case, each run of white space one space: bytes, offsets, and old places of the bytes."""
    low = _FOLD[data]
    space = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(low)]] = True
    places = np.flatnonzero(keep)
    return low[places], np.searchsorted(places, offsets), places


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from each place on."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, U64)
    held = np.ascontiguousarray(data)
    a = np.ndarray((n,), "<u8", held, 0, (1,))
    b = np.ndarray((n,), "<u8", held, Q - 8, (1,))
    return a * _A + b * _B


@dataclass
class Items:
    """A block of the benchmark, ready for search."""

    ids: np.ndarray
    texts: list[bytes]
    budget: np.ndarray  # edits allowed
    least: np.ndarray  # q-grams that a copy within the budget shares at least
    keys: np.ndarray  # distinct gram hashes, sorted
    ends: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    shift: np.uint64  # from a hash to its entry of the bitmap
    short: list[tuple[int, bytes]]


def plain(text: str) -> bytes:
    """An item as it is searched for: lower case, one space for white space, none at the ends."""
    return re.sub(rb"[ \t-\r]+", b" ", text.encode()).strip().lower()


def budgets(size: np.ndarray, rate: float) -> np.ndarray:
    """Edits allowed in items of these sizes."""
    return np.minimum((size * rate).astype(np.int64), size // Q - 1)


def prepared(rows: list[tuple[int, str]], rate: float, bits: int = BITMAP) -> Items:
    plains = [(i, plain(t)) for i, t in rows]
    texts = [(i, t) for i, t in plains if len(t) >= Q]
    size = np.array([len(t) for _, t in texts], np.int64)
    budget = budgets(size, rate)
    own = [grams(np.frombuffer(t, np.uint8)) for _, t in texts]
    every = np.concatenate([*own, np.zeros(0, U64)])
    item = np.repeat(np.arange(len(texts)), [len(g) for g in own])
    place = np.concatenate([*(np.arange(len(g)) for g in own), np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    keys, first = np.unique(every[order], return_index=True)
    shift = U64(64 - bits)
    bitmap = np.zeros(1 << bits, bool)
    bitmap[(keys >> shift).astype(np.int64)] = True
    return Items(
        np.array([i for i, _ in texts], np.int64), [t for _, t in texts], budget, size + 1 - Q * (budget + 1),
        keys, np.append(first, len(every)), item[order], place[order], bitmap, shift,
        [(i, t) for i, t in plains if 0 < len(t) < Q],
    )


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int]:
    """Fewest edits that turn ``item`` into a part of ``text``, on diagonals low to high; where it ends.

    Cells outside the text cost more than the budget. The first row is free, so the part may
    begin on any of the diagonals.
    """
    width = high - low + 1
    padded = np.full(len(item) + width, 256, np.int16)
    a, b = max(low, 0), min(low + len(padded), len(text))
    if a < b:
        padded[a - low : b - low] = text[a:b]
    cells = np.zeros(width, np.int32)
    step = np.arange(width, dtype=np.int32)
    for i, letter in enumerate(item.tolist()):
        found = padded[i : i + width]
        fresh = cells + (found != letter)
        fresh[:-1] = np.minimum(fresh[:-1], cells[1:] + 1)
        cells = np.minimum.accumulate(fresh - step) + step
        if cells.min() > budget:
            return budget + 1, 0
    best = int(cells.argmin())
    return int(cells[best]), low + best + len(item)


def leaks_in(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, after, edits) for texts already folded; places are in the joined bytes."""
    out = []
    if len(items.keys):
        hashes = grams(data)
        hit = np.flatnonzero(items.bitmap[(hashes >> items.shift).astype(np.int64)])
        at = np.searchsorted(items.keys, hashes[hit])
        at = np.minimum(at, len(items.keys) - 1)
        real = items.keys[at] == hashes[hit]
        hit, at = hit[real], at[real]
        owner = np.searchsorted(offsets, hit, side="right") - 1
        inside = hit + Q <= offsets[owner + 1]
        hit, at, owner = hit[inside], at[inside], owner[inside]
        count = items.ends[at + 1] - items.ends[at]
        ends = np.cumsum(count)
        post = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(items.ends[at], count)
        item, owner = items.item[post], np.repeat(owner, count)
        diagonal = np.repeat(hit, count) - items.place[post] + (1 << 32)
        stride = items.budget[item] + 1
        band = diagonal // stride
        # each band is two strides wide and shares one with the next: a copy's diagonals lie in one
        key = np.stack([np.tile(owner, 2), np.tile(item, 2), np.concatenate([band, band - 1])])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        new = np.ones(key.shape[1], bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        begin = np.flatnonzero(new)
        total = np.diff(np.append(begin, key.shape[1]))
        enough = total >= items.least[key[1, begin]]
        best: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        for doc, number, band in key[:, begin[enough]].T.tolist():
            budget = int(items.budget[number])
            low = band * (budget + 1) - (1 << 32) - int(offsets[doc]) - budget
            high = low + 2 * (budget + 1) + 2 * budget
            item = np.frombuffer(items.texts[number], np.uint8)
            text = data[offsets[doc] : offsets[doc + 1]]
            a = max(low, 0)
            found = text[a : high + len(item) + 1].tobytes().find(items.texts[number])
            if found >= 0:
                edits, after = 0, a + found + len(item)
            else:
                edits, after = banded(item, text, low, high, budget)
            if edits <= budget:
                start = max(after - len(item), 0)
                place = (doc, number, after)
                if place not in best or edits < best[place][2]:
                    best[place] = (start, after, edits)
        out = [(d, int(items.ids[n]), s + int(offsets[d]), e + int(offsets[d]), x) for (d, n, _), (s, e, x) in best.items()]
    if items.short:
        # a line feed, which no folded text holds, keeps neighbouring texts apart
        joined = b"\n".join(data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:]))
        begins = offsets[:-1] + np.arange(len(offsets) - 1)
    for ident, text in items.short:
        for m in re.finditer(rb"(?<!\S)" + re.escape(text) + rb"(?!\S)", joined):
            doc = int(np.searchsorted(begins, m.start(), side="right")) - 1
            out.append((doc, ident, m.start() - doc, m.end() - doc, 0))
    return out


def placed(items: Items, raw: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, after, edits) for texts as they are; places are in each text's own bytes."""
    data, offsets, places = folded(raw, begins)
    places = np.append(places, len(raw))
    for doc, ident, start, after, edits in leaks_in(items, data, offsets):
        yield doc, ident, int(places[start] - begins[doc]), int(places[after - 1] + 1 - begins[doc]), edits


def _finder(items: Items, text: str, names: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("after", pa.int32()), ("edits", pa.int32())]))
        for part in slices(batches, text):
            found: list[list[dict[str, int]]] = [[] for _ in range(part.num_rows)]
            for doc, ident, start, after, edits in placed(items, *text_buffer(column(part, text))):
                found[doc].append({"item_id": ident, "start": start, "after": after, "edits": edits})
            for one in found:
                one.sort(key=lambda x: (x["start"], x["item_id"], x["after"], x["edits"]))
            arrays = [pa.array(found, kind) if n == "leaks" else column(part, n) for n in names]
            yield pa.record_batch(arrays, names)

    return find


def short_hashes(data: np.ndarray, start: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of each run of less than Q bytes."""
    held = np.zeros((len(start), 16), np.uint8)
    for i in range(Q - 1):
        some = np.flatnonzero(start + i < after)
        held[some, i] = data[start[some] + i]
    two = held.view("<u8")
    return mix(two[:, 0] * _A + two[:, 1] * _B + U64(1))


def anchors_of(item: bytes, rate: float) -> np.ndarray:
    """Hashes of which every text that holds the item has one.

    k edits touch at most k of k + 1 q-grams that share no byte, so one of them stays whole. An item
    shorter than Q bytes must occur whole.
    """
    data = np.frombuffer(item, np.uint8)
    if len(data) < Q:
        return short_hashes(data, np.zeros(1, np.int64), np.full(1, len(data)))
    pieces = int(budgets(np.array([len(data)]), rate)[0]) + 1
    return grams(data)[np.arange(pieces) * (len(data) // pieces)]


def _anchorer(rate: float):
    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 1 << 18):
            plains = [plain(t) for t in column(part, "t").to_pylist()]
            own = [anchors_of(t, rate) if t else np.zeros(0, U64) for t in plains]
            count = [len(x) for x in own]
            item, short = np.repeat(longs(part, "item"), count), np.repeat([len(t) < Q for t in plains], count)
            gram = np.concatenate([*own, np.zeros(0, U64)])
            yield pa.record_batch([pa.array(signed(gram)), pa.array(item), pa.array(short.astype(bool))], ["gram", "item", "short"])

    return anchor


def _sieve(anchors: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the upper ``bits`` bits of an anchor, 8 to a byte; Spark sets them, 32768 to a row."""
    bit = F.shiftrightunsigned("gram", 64 - bits)
    rows = anchors.groupBy(F.shiftright(bit, 15).cast("int").alias("at"))
    rows = rows.agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("held"))
    sieve = np.zeros((1 << bits) // 8, np.uint8)
    for at, held in rows.toLocalIterator():
        sieve[at * 4096 : (at + 1) * 4096] = np.frombuffer(bytes(held), np.uint8)
    return sieve


def _sifter(sieve: np.ndarray, bits: int, short: bool):
    def sifted(hashes: np.ndarray) -> np.ndarray:
        bit = (hashes >> U64(64 - bits)).astype(np.int64)
        return np.flatnonzero(sieve[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets, _ = folded(*text_buffer(column(part, "text")))
            hashes = grams(data)
            hit = sifted(hashes)
            owner = np.searchsorted(offsets, hit, side="right") - 1
            inside = hit + Q <= offsets[owner + 1]
            found = [(hashes[hit[inside]], owner[inside])]
            words = Words(data, offsets) if short else None
            own = words.owner() if short else None
            for more in range(Q // 2 if short else 0):  # words of one byte and a space each
                i = np.arange(max(words.n - more, 0))
                i = i[(own[i] == own[i + more]) & (words.end[i + more] - words.start[i] < Q)]
                for at in range(0, len(i), 1 << 18):
                    some = i[at : at + (1 << 18)]
                    keys = short_hashes(data, words.start[some], words.end[some + more])
                    kept = sifted(keys)
                    found.append((keys[kept], own[some[kept]]))
            gram, doc = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((gram, doc))
            gram, doc = gram[order], doc[order]
            once = runs(doc, gram)[:-1]
            yield pa.record_batch([pa.array(signed(gram[once])), pa.array(longs(part, "__row")[doc[once]])], ["gram", "__row"])

    return sift


def _verifier(rate: float):
    def told(row: int, text: str | None, items: list[tuple[int, str]]) -> pa.RecordBatch:
        # a bitmap with some eight entries for a q-gram
        held = prepared(sorted(items), rate, min(BITMAP, 3 + sum(len(t) for _, t in items).bit_length()))
        found = sorted((s, i, e, x) for _, i, s, e, x in placed(held, *text_buffer(pa.array([text], pa.string()))))
        start, ident, after, edits = (np.array(found, np.int64).reshape(-1, 4).T)
        arrays = [pa.array([row] * len(found), pa.int64()), pa.array(start, pa.int32()), pa.array(ident)]
        return pa.record_batch([*arrays, pa.array(after, pa.int32()), pa.array(edits, pa.int32())], ["__row", "start", "item_id", "after", "edits"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text, items = None, None, []
        for part in slices(batches, "text"):
            for row, share, ident, own in zip(*(c.to_pylist() for c in part.columns)):
                if (row, share) != key:
                    if items:
                        yield told(key[0], text, items)
                    key, text, items = (row, share), own, []  # the document stands before its items
                else:
                    items.append((ident, own))
        if items:
            yield told(key[0], text, items)

    return verify


def _dealt(docs: DataFrame, items: DataFrame, rate: float, text: str) -> DataFrame:
    """``leaks`` by shuffles, for a benchmark of any size: anchors meet, then each document its items."""
    items = cut(items.withColumn("item", F.monotonically_increasing_id()), "items")
    docs = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "texts")
    anchors = cut(mapped(items.select("t", "item"), _anchorer(rate), "gram long, item long, short boolean"), "anchors")
    count, short = anchors.agg(F.count("*"), F.coalesce(F.max("short"), F.lit(False))).first()
    bits = min(SIEVE, max(18, (16 * count).bit_length()))
    texts = docs.select("__row", F.col(text).alias("text"))
    sift = _sifter(_sieve(anchors, bits), bits, short)
    hits = cut(mapped(texts, sift, "gram long, __row long"), "hits")
    met = salted_join(hits, anchors.select("gram", "item"), "gram", "__row", hot=hot_keys(hits, "gram", "__row"))
    pairs = cut(met.select("__row", "item").distinct().join(items, "item").select("__row", "item", "i", "t"), "pairs")
    shares = pairs.groupBy("__row").agg(F.sum(F.octet_length("t")).alias("bytes"))
    shares = shares.select("__row", (1 + F.floor(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("shares"))
    wanted = texts.join(shares, "__row").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    wanted = wanted.select("__row", "share", F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("i"), "text")
    share = F.pmod(F.xxhash64("item"), F.col("shares")).cast("int").alias("share")
    held = pairs.join(shares, "__row").select("__row", share, "item", "i", F.col("t").alias("text"))
    group = wanted.union(held).repartition("__row", "share").sortWithinPartitions("__row", "share", F.col("item").asc_nulls_first())
    fields = "__row long, start int, item_id long, after int, edits int"
    found = mapped(group.select("__row", "share", "i", "text"), _verifier(rate), fields)
    leaks = F.array_sort(F.collect_list(F.struct("start", "item_id", "after", "edits")))
    leaks = F.transform(leaks, lambda x: F.struct(x.item_id.alias("item_id"), x.start.alias("start"), x.after.alias("after"), x.edits.alias("edits")))
    found = cut(found.groupBy("__row").agg(leaks.alias("leaks")), "leaks")
    names = [c for c in docs.columns if c != "__row"]
    return docs.join(found, "__row", "left").select(*names, F.coalesce("leaks", F.expr(f"cast(array() as {LEAK})")).alias("leaks"))


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` and a column ``leaks``: the benchmark items found in each whole text.

    An item of m bytes leaks into a document where some part of it is within k edits of the item,
    k = rate * m, at most m // Q - 1; both in lower case (A-Z) with each run of white space as one
    space. By the q-gram lemma such a part shares m + 1 - Q * (k + 1) q-grams or more with the item, on
    k + 1 neighbouring diagonals. Shared q-grams are counted by document, item and band of
    diagonals, bands overlapping so that one holds them all; bands that reach the bound are
    verified by alignment within the band. ``start`` and ``after`` are byte offsets of the
    text (``start`` within ``edits`` when there are any). Items shorter than Q bytes must
    occur as whole words.

    A benchmark of up to BLOCK_BYTES goes to every task, and the documents are read in one pass
    without a shuffle. A larger one stays in Spark: of each item k + 1 q-grams that share no byte
    are anchors, one of which every leak holds whole. Hashes of the documents that pass a bitmap of
    the anchors (2 ** SIEVE bits at most; where a benchmark fills it, more hashes are shuffled) are joined with them, hot
    ones salted, and each document meets the items that it shares an anchor with, at most
    some BLOCK_BYTES of them in one group, to be counted and verified as above. Both ways give the same leaks.

    NULL or blank items match nothing, NULL texts have no leaks (an empty list). Repeated items are
    found each under its id, a NULL id as -1. An input column ``leaks`` is replaced.
    """
    names = [c for c in plainly_named(docs).columns if c != "leaks"]
    items = benchmark.select(F.coalesce(F.col(item).cast("long"), F.lit(-1)).alias("i"), F.col(item_text).alias("t"))
    items = items.filter(F.trim("t") != "").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    if size > BLOCK_BYTES:
        return _dealt(docs.select(*names), items, rate, text)
    rows = sorted((r[0], r[1]) for r in items.toLocalIterator())
    out = docs.select(*names).withColumn("leaks", F.expr(f"cast(array() as {LEAK})"))
    if not rows:
        return out
    fields = [docs.schema[n] for n in names] + [out.schema["leaks"]]
    return mapped(out, _finder(prepared(rows, rate), text, [*names, "leaks"]), T.StructType(fields))


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06) -> DataFrame:
    """The documents in which no benchmark item is found, columns as they are."""
    return with_leaks(docs, benchmark, rate).filter(F.size("leaks") == 0).select(*docs.columns)
