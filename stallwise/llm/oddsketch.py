"""Near-duplicate documents by MinHash bands whose candidates odd sketches check."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise.llm.common import (
    NO_ID, Prefix, U64, column, cut, document_columns, lists, mapped, mix, plainly_named, runs, signed, slices, squeezed, unsqueezed, words_of,
)
from stallwise.llm.graph import components

BANDS, ROWS = 32, 6  # at similarity 0.85 a pair meets in no band with probability 3e-7, at 0.8 with 6e-5
BITS = 512
BLOCK = 150  # members of one bucket that are compared with each other in one task, about
BLOCK_BYTES = 24_000_000  # of their differences, about
HOT = 2000  # rows of one key that a join leaves in one task, about
_random = np.random.default_rng(20_240_601)
_ODD = _random.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_SALT = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(part: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct k-word shingles (all words if fewer)."""
    words = words_of(part, lower=True)
    prefix = Prefix(words.hashes())
    place = np.arange(max(words.n - k + 1, 0))
    every = prefix.run(place, place + k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(prefix.run(np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, U64))
    return out


def minhashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(len(_ODD), 2**32 - 1, np.uint32)
    short = (shingles >> U64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(least, ((short[None, at : at + 2048] ^ _XOR[:, None]) * _ODD[:, None]).min(1), out=least)
    return least


def _signer(k: int):
    numbers = np.arange(len(_ODD)).astype(U64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part, k)
            count = np.array([len(s) for s in sets], np.int64)
            least = np.array([minhashes(s) for s in sets if len(s)], np.uint32).reshape(-1, len(_ODD)).astype(U64)
            full = count > 0
            band = mix((least * _SALT).reshape(-1, BANDS, ROWS).sum(2, dtype=U64) + np.arange(BANDS).astype(U64))
            bit = (mix(least + (numbers << U64(32))) % U64(BITS)).astype(np.int64)
            row = np.arange(len(least))[:, None] * BITS
            odd = np.bincount((row + bit).ravel(), minlength=len(least) * BITS) & 1
            sketch = np.packbits(odd.astype(np.uint8)).view(np.int64)
            yield pa.record_batch(
                [
                    column(part, "__doc"),
                    column(part, "__crc"),
                    pa.array(count),
                    pa.array(signed(np.array([mix(s).sum(dtype=U64) for s in sets], U64))),
                    pa.array(signed(np.array([mix(s + U64(0xABCDEF)).sum(dtype=U64) for s in sets], U64))),
                    lists(sketch, full * (BITS // 64), pa.int64()),
                    lists(signed(band.ravel()), full * BANDS, pa.int64()),
                ],
                ["__doc", "__crc", "n", "c1", "c2", "sketch", "bands"],
            )

    return sign


def most_odd_bits(similarity: float) -> int:
    """Odd bits that a pair at least so similar practically never exceeds.

    The samples that differ are binomial: six standard deviations above their mean, and three
    more for bits where toggles meet.
    """
    k = BANDS * ROWS
    differ = k * (1 - similarity) + 6 * math.sqrt(k * similarity * (1 - similarity))
    toggles = min(2 * differ, 2 * k)
    mean = BITS * (1 - (1 - 2 / BITS) ** toggles) / 2
    return math.ceil(mean + 3 * math.sqrt(mean / 2))


def common_counts(deltas: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many elements the sets of each pair share, by bit rows over the elements that two sets hold."""
    size = np.array([len(d) for d in deltas], np.int64)
    values, column, count = np.unique(np.concatenate(deltas), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(deltas)), size)
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    row, column = row[shared], number[column[shared]]
    total = np.zeros(len(p), np.int64)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 1 << 16):
        some = (column >= low) & (column < low + (1 << 16))
        at = column[some] - low
        bits = np.zeros((len(deltas), (int(at.max()) >> 6) + 1 if len(at) else 1), U64)
        np.bitwise_or.at(bits, (row[some], at >> 6), U64(1) << (at & 63).astype(U64))
        for i in range(0, len(p), 4096):
            both = bits[p[i : i + 4096]] & bits[q[i : i + 4096]]
            total[i : i + 4096] += np.bitwise_count(both).sum(1, dtype=np.int64)
    return total


def near_pairs(component: np.ndarray, side: np.ndarray, sketch: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of different components with near sketches: within side 0, or between sides -1 and 1."""
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    for at in range(0, len(left), 256):
        x = left[at : at + 256]
        bits = np.bitwise_count(sketch[x][:, None, :] ^ sketch[right][None, :, :]).sum(2, dtype=np.int64)
        near = (bits <= most) & (component[x][:, None] != component[right][None, :])
        near &= (side[x] != 0)[:, None] | (x[:, None] < right[None, :])
        i, j = np.nonzero(near)
        yield x[i], right[j]


def _grouped(told):
    """``told`` of each run of rows with one lead, kind and pair of blocks; the last column is the sketch."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
            keys.append(batch.columns[-1].flatten().to_numpy().view(U64).reshape(-1, BITS // 64))
            rows = keys if tail is None else [np.concatenate(x) for x in zip(tail, keys)]
            ends = runs(*rows[:4])
            for i, j in zip(ends[:-2], ends[1:-1]):
                yield told(*(x[i:j] for x in (rows[0], *rows[4:])))
            tail = [x[ends[-2] :] for x in rows] if len(ends) > 1 else rows
        if tail is not None and len(tail[0]):
            yield told(tail[0], *tail[4:])

    return grouped


def _flag(most: int):
    """Members that a member of another component is near to by sketch."""

    def flag(lead: np.ndarray, rep: np.ndarray, component: np.ndarray, side: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        some = np.zeros(len(rep), bool)
        for p, q in near_pairs(component, side, sketch, most):
            some[p] = some[q] = True
        return pa.record_batch([pa.array(lead[some]), pa.array(rep[some])], ["a", "rep"])

    return _grouped(flag)


def _compare(most: int, percent: int):
    """Links between members of different components of one lead's group, or of two blocks of it.

    Pairs with near sketches are confirmed on the full sets: two sets differ where exactly one
    of them differs from the lead's, so their differences from it tell the intersection. One link
    for two components is enough, so pairs that links have joined meanwhile are passed over.
    """

    def pairs(_, rep, component, side, size, delta, sketch) -> pa.RecordBatch:
        found = list(near_pairs(component, side, sketch, most))
        p, q = (np.concatenate(x) for x in zip(*found)) if found else np.zeros((2, 0), np.int64)
        _, label = np.unique(component, return_inverse=True)
        deltas = [np.frombuffer(d, U64) for d in delta.tolist()]
        length = np.array([len(d) for d in deltas], np.int64)
        links: list[np.ndarray] = []
        for at in range(0, len(p), 200_000):
            i, j = p[at : at + 200_000], q[at : at + 200_000]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            differ = length[i] + length[j] - 2 * common_counts(deltas, i, j)
            same = (size[i] + size[j] - differ) // 2
            linked = 100 * same >= percent * (size[i] + size[j] - same)
            i, j = i[linked], j[linked]
            _, first = np.unique(label[i] * len(label) + label[j], return_index=True)
            for x, y in zip(i[first].tolist(), j[first].tolist()):
                if label[x] != label[y]:
                    label[label == label[x]] = label[y]
                    links.append(np.array([rep[x], rep[y]]))
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _grouped(pairs)


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = [s.tobytes() for s in shingle_sets(part, k)]
            yield pa.record_batch([column(part, "__doc"), pa.array(made, pa.binary())], ["rep", "items"])

    return sets


def _verifier(percent: int):
    """Whether the full sets of a pair link, their sizes, and what only one of them holds."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                linked, size, lead_size, delta = [], [], [], []
                for x, y in zip(column(batch, "x"), column(batch, "y")):
                    x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                    one = np.setxor1d(x, y, assume_unique=True)
                    same = (len(x) + len(y) - len(one)) // 2
                    linked.append(100 * same >= percent * (len(x) + len(y) - same))
                    lead_size.append(len(x))
                    size.append(len(y))
                    delta.append(one.tobytes())
                made = [pa.array(linked, pa.bool_()), pa.array(lead_size, pa.int64()), pa.array(size, pa.int64()), pa.array(delta, pa.binary())]
                yield pa.record_batch([column(batch, "a"), column(batch, "b"), *made], ["a", "b", "linked", "lead_size", "size", "delta"])

    return verify


def spread_join(facts: DataFrame, one: DataFrame, on: str, spread_by: str) -> DataFrame:
    """Inner join with a table of one row per key, in which a key of more than HOT rows is dealt to several tasks.

    Only the rows of ``one`` for those keys are copied. ``facts`` is read twice, so it should be a stored table.
    """
    many = facts.groupBy(on).agg(F.count("*").alias("__n")).filter(F.col("__n") > HOT)
    many = cut(many.select(on, F.ceil(F.col("__n") / HOT).cast("int").alias("__salts")), "hot-keys")
    salts = F.coalesce("__salts", F.lit(1))
    left = facts.join(many, on, "left").withColumn("__salt", F.pmod(F.xxhash64(spread_by), salts).cast("int")).drop("__salts")
    right = one.join(many, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [on, "__salt"]).drop("__salt")


def odd_bits(x: str, y: str) -> Column:
    """Bits in which two sketches differ."""
    words = F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(words, F.lit(0), lambda total, n: total + n)


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id"
) -> DataFrame:
    """``__doc``, ``__crc``, ``n_shingles``, ``component``: groups of near-duplicate documents.

    A document's set is its distinct ``k``-word shingles, A-Z in lower case; with fewer
    words the whole sequence is its one shingle. Two documents link if 100 * intersection >=
    ``percent`` * union, confirmed on the full sets. ``component`` is the smallest id reachable
    by links. One row per id and text.

    Documents with equal sets form a class at once and only its smallest id goes on. MinHash
    samples make band keys, and their parity bitmap is the odd sketch, from which the popcount
    of an XOR tells high similarities apart. First each bucket's members are checked by sketch against
    its smallest member, its lead, and the near ones confirmed on the full sets, which are made
    anew. Then, only for leads whose members, near or not, still lie in several components, members of
    different components are compared by sketch, in blocks, inside tasks; those with a near one are
    compared once more and confirmed exactly by their differences from the lead's set. No pair leaves a
    task but one link for two components; a huge group of near copies is one component by then.

    NULL or wordless text: an empty set, linked with nothing. NULL ids: an id after all others.
    Rows of the same id and text are one document; other texts under that id share its
    component if their sets agree, else what links them is judged on the text of the smallest
    checksum. Texts are used whole.
    """
    base = plainly_named(docs).withColumns(document_columns(text, ident)).select("__doc", "__crc", F.col(text).alias("text"))
    signed_docs = cut(
        mapped(base, _signer(k), "__doc long, __crc long, n long, c1 long, c2 long, sketch array<long>, bands array<long>"
        ),
        "signatures",
    )
    same = ["n", "c1", "c2"]
    classes = signed_docs.filter("n > 0").groupBy(*same).agg(
        F.min(F.struct("__doc", "__crc")).alias("who"), F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands")
    )
    classes = cut(classes.select(*same, F.col("who.__doc").alias("rep"), F.col("who.__crc").alias("crc"), "sketch", "bands"), "classes")
    # of several texts under one id, which share a name, the smallest checksum stands for it
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("end")).filter("lead <> end")
    met = cut(members.join(shared.select("bucket", "lead"), "bucket"), "buckets")
    most = most_odd_bits(percent / 100)
    pairs = cut(met.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    sketches = classes.select("rep", "sketch")
    judged = spread_join(pairs, sketches.toDF("a", "x"), "a", "b").join(sketches.toDF("b", "y"), "b")
    judged = cut(judged.select("a", "b", (odd_bits("x", "y") <= most).alias("near")), "judged")

    def confirmed(chosen: DataFrame, name: str) -> DataFrame:
        """Chosen pairs of a lead and a member on their full sets."""
        involved = chosen.select(F.col("a").alias("rep")).union(chosen.select("b")).distinct()
        who = classes.join(involved, "rep", "left_semi").groupBy("rep").agg(F.min("crc").alias("crc"))
        copies = F.row_number().over(Window.partitionBy("__doc", "__crc").orderBy("text"))
        texts = base.join(who.toDF("__doc", "__crc"), ["__doc", "__crc"]).withColumn("copy", copies).filter("copy = 1")
        sets = cut(mapped(texts, _sets(k), "rep long, items binary"), "sets")
        both = spread_join(chosen, sets.toDF("a", "x"), "a", "b").join(sets.toDF("b", "y"), "b")
        told = "a long, b long, linked boolean, lead_size long, size long, delta binary"
        return cut(mapped(both.select("a", "b", "x", "y"), _verifier(percent), told), name)

    stars = confirmed(cut(judged.filter("near").select("a", "b"), "near"), "stars")
    links = stars.filter("linked").select("a", "b")
    labels = cut(components(links), "labels")

    def labelled(df: DataFrame, of: DataFrame, key: str = "rep") -> DataFrame:
        named = of.select(F.col("node").alias(key), "component")
        return df.join(named, key, "left").withColumn("component", F.coalesce("component", key))

    leads = judged.select("a").distinct()
    members = leads.select("a", F.col("a").alias("rep")).union(judged.select("a", F.col("b").alias("rep")))
    members = cut(labelled(members, labels).select("a", "rep", "component"), "members")
    # counted by lead and component before anything is dealt by lead alone; the lead's own row tells its component
    counted = members.groupBy("a", "component").agg(F.count("*").alias("n"), F.max(F.col("rep") == F.col("a")).alias("own"))
    counted = counted.groupBy("a").agg(
        F.max(F.when(F.col("own"), F.col("component"))).alias("home"),
        F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("inside"),
        F.sum(F.when(F.col("own"), 0).otherwise(F.col("n"))).alias("outside"),
    )
    blocks = lambda c, size: F.ceil(F.greatest(F.col(c) / BLOCK, size / BLOCK_BYTES)).cast("int")
    open_leads = counted.filter("outside > 1 or outside = 1 and inside > 1")
    open_leads = cut(open_leads.select("a", "home", blocks("inside", F.lit(0)).alias("ins"), blocks("outside", F.lit(0)).alias("outs")), "open")

    def met_in_blocks(of: DataFrame, leads: DataFrame, rest: list[str]) -> DataFrame:
        """Members of open leads dealt so that those of different components meet, two blocks at a time."""
        out, other = F.col("component") != F.col("home"), F.col("other")
        mine = F.pmod(F.xxhash64("rep"), F.when(out, F.col("outs")).otherwise(F.col("ins"))).cast("int")
        open_ = of.join(leads, "a").join(sketches, "rep").withColumn("block", mine)
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
        block = F.col("block")
        among = open_.filter(out).select("*", each("outs")).select(
            "a", F.lit(0).alias("kind"), F.least(block, other).alias("i"), F.greatest(block, other).alias("j"), "rep", "component",
            F.when(block == other, 0).when(block < other, -1).otherwise(1).alias("side"), *rest,
        )
        outer = open_.filter(out & (F.col("ins") > 0)).select("*", each("ins")).select(
            "a", F.lit(1).alias("kind"), block.alias("i"), other.alias("j"), "rep", "component", F.lit(-1).alias("side"), *rest
        )
        inner = open_.filter(~out & (F.col("outs") > 0)).select("*", each("outs")).select(
            "a", F.lit(1).alias("kind"), other.alias("i"), block.alias("j"), "rep", "component", F.lit(1).alias("side"), *rest
        )
        key = ["a", "kind", "i", "j"]
        return among.union(outer).union(inner).repartition(*key).sortWithinPartitions(*key)

    dealt = met_in_blocks(members, open_leads, ["sketch"])
    flagged = cut(mapped(dealt, _flag(most), "a long, rep long").distinct(), "flagged")
    if not flagged.isEmpty():
        known = stars.select("a", F.col("b").alias("rep"), "size", "delta", "lead_size")
        asked = flagged.filter("a <> rep").join(known.select("a", "rep"), ["a", "rep"], "left_anti")
        more = confirmed(cut(asked.select("a", F.col("rep").alias("b")), "asked"), "more-stars")
        links = links.union(more.filter("linked").select("a", "b"))
        known = known.union(more.select("a", F.col("b").alias("rep"), "size", "delta", "lead_size"))
        own = known.groupBy("a").agg(F.any_value("lead_size").alias("size"))
        own = own.select("a", F.col("a").alias("rep"), "size", F.lit(b"").alias("delta"))
        known = own.union(known.drop("lead_size")).join(flagged, ["a", "rep"])
        known = cut(known.join(members, ["a", "rep"]), "differences")
        size = lambda c: F.sum(F.when(c, F.octet_length("delta")).otherwise(0))
        inside = F.col("component") == F.col("home")
        again = known.join(open_leads.select("a", "home"), "a").groupBy("a", "home").agg(
            F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"), size(inside).alias("b_in"), size(~inside).alias("b_out")
        )
        again = again.select("a", "home", blocks("inside", F.col("b_in")).alias("ins"), blocks("outside", F.col("b_out")).alias("outs"))
        dealt = met_in_blocks(known, again, ["size", "delta", "sketch"])
        further = cut(mapped(dealt, _compare(most, percent), "a long, b long").distinct(), "further")
        labels = cut(components(links.union(further)), "labels")
    grouped = labelled(classes.select("rep", *same), labels).select(*same, F.col("component").alias("group"))
    told = signed_docs.select("__doc", "__crc", *same).join(grouped, same, "left")
    return told.select("__doc", "__crc", F.col("n").alias("n_shingles"), F.coalesce("group", "__doc").alias("component"))


def dedup_report(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document, NULL ids as NULL."""
    told = near_duplicates(docs, k, percent)
    ident = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return told.select(
        ident("__doc").alias("doc_id"), "n_shingles", ident("component").alias("component_id"),
        (F.col("__doc") == F.col("component")).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id"
) -> DataFrame:
    """One document of each group, that of the smallest id; columns as they are.

    Documents without words belong to no group and stay. Rows of the same id and text are one
    document: they stay or go together.
    """
    gone = near_duplicates(docs, k, percent, text, ident).filter(F.col("__doc") != F.col("component")).select("__doc", "__crc")
    named = squeezed(docs.withColumns(document_columns(text, ident)), text)
    kept = named.join(gone.distinct(), ["__doc", "__crc"], "left_anti").select(*docs.columns)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return unsqueezed(batches, text)

    return mapped(kept, plain, docs.schema)
