"""Mixture-controlled packing by deficit round-robin over source queues."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stallwise.llm.common import blobs, column, cut, mapped, slices
GRAIN = 32  # tokens that a queue's deficit must reach before the queue is served; divides the sequence length
WEIGHTS = 1 << 20  # the sum of the queues' weights, about; with 2**40 grains products stay below 2**63
MOST_QUEUES = 1024  # sources with a queue of their own; the smaller ones share one more
BROADCAST_ROWS = 200_000  # of the table of queue positions, some 60 bytes each
CACHE = 300_000  # words whose ids one task remembers


class Encoder:
    """Ids of texts by a byte-level BPE file, ``add_special_tokens=False``.

    The file's own vocabulary is used through the faster of two public libraries; a text
    that holds one of the file's added tokens goes through ``tokenizers`` itself. Between
    two non-space characters a single space always begins a new word for this kind of file,
    so ids are remembered by word; texts with other spacing are encoded whole.
    """

    def __init__(self, name: str) -> None:
        import tiktoken

        if not os.path.exists(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.name, self.slow = name, None
        with open(name, encoding="utf-8") as file:
            spec = json.load(file)
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in letters}
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        byte = {c: b for b, c in shown.items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = [t for t in added if t]
        self.code = "H" if max([*ranks.values(), *added.values(), 0]) < 65536 else "I"
        core, code = self.fast._core_bpe, self.code

        class Words(dict):
            """Ids of a word after a single space; None where it has white space at an end or is empty."""

            def __missing__(self, word: str) -> bytes | None:
                if not word or word[0].isspace() or word[-1].isspace():
                    ids = None
                elif word.isalpha():  # one piece of the pattern
                    ids = array(code, core.encode_single_piece(b" " + word.encode())).tobytes()
                elif word[-1] in ".,!?:;" and word[:-1].isalpha():  # two pieces
                    ids = self[word[:-1]] + array(code, core.encode_single_piece(word[-1].encode())).tobytes()
                else:
                    ids = array(code, core.encode_ordinary(" " + word)).tobytes()
                if len(self) >= CACHE:
                    self.clear()
                self[word] = ids
                return ids

        self.words = Words()

    def ids(self, text: str) -> bytes:
        """Little-endian ids, two bytes each where the vocabulary allows."""
        if any(t in text for t in self.added):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.name)
            return array(self.code, self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        if rest and first and not first[-1].isspace():
            get = self.words
            known = [get[w] for w in rest]
            if None not in known:
                return array(self.code, self.fast.encode_ordinary(first)).tobytes() + b"".join(known)
        return array(self.code, self.fast.encode_ordinary(text)).tobytes()


def _tokenise(name: str, end_id: int):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        part_id, served = TaskContext.get().partitionId(), {}
        for part in slices(batches):
            encoder = encoder or Encoder(name)
            width = array(encoder.code).itemsize
            end = array(encoder.code, [end_id]).tobytes()
            texts = column(part, "text").to_pylist()
            ids = [encoder.ids(t) + end if t else end for t in texts]
            count = [len(x) // width for x in ids]
            begin = []
            for queue, n in zip(column(part, "queue").to_pylist(), count):
                begin.append(served.get(queue, 0))
                served[queue] = begin[-1] + n
            yield pa.record_batch(
                [
                    column(part, "doc_id"),
                    column(part, "queue"),
                    pa.array([part_id] * len(ids), pa.int32()),
                    pa.array(begin, pa.int64()),
                    pa.array(count, pa.int64()),
                    pa.array([width] * len(ids), pa.int8()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "queue", "part", "begin", "doc_tokens", "width", "ids"],
            )

    return tokenise


@dataclass
class Phase:
    """A stretch of the output, in grains, during which the same queues are served.

    The grains of all queues stand in the order of their virtual times: the j-th grain of a queue
    of weight w has (2j + 1) / 2w, queues in order on ties. ``grains`` 0 marks a tail: the
    last tokens of one queue, less than a grain.
    """

    at: int  # tokens of all queues before it
    grains: int
    size: int  # tokens in it
    queues: list[str]
    weight: np.ndarray
    base: np.ndarray  # tokens of each of its queues before it

    def counts(self, upto: np.ndarray) -> np.ndarray:
        """Of each queue the grains among the first ``upto`` ones, exactly.

        At virtual time upto / sum(w) the queues together have had that number but for half
        their own number; the grains next in time make up the difference. Remainders are
        whole numbers below 2**28, whose quotients doubles tell apart.
        """
        w, total = self.weight[:, None], int(self.weight.sum())
        share = 2 * w * upto[None, :] + total
        n = share // (2 * total)
        rest = share - 2 * total * n
        missing = upto - n.sum(0)
        while (some := np.flatnonzero(missing > 0)).size:
            q = ((2 * total - rest[:, some]) / w).argmin(0)
            n[q, some] += 1
            rest[q, some] -= 2 * total
            missing[some] -= 1
        while (some := np.flatnonzero(missing < 0)).size:
            late = np.where(n[:, some] > 0, -rest[:, some] / w, -np.inf)
            q = len(w) - 1 - late[::-1].argmax(0)
            n[q, some] -= 1
            rest[q, some] += 2 * total
            missing[some] += 1
        return n


def position(j: int, q: int, weight: list[int]) -> int:
    """How many grains come before the j-th one of queue q."""
    before = 0
    for other, w in enumerate(weight):
        time = (2 * j + 1) * w
        most = time // weight[q] if other < q else (time - 1) // weight[q]  # ties: queues in order
        before += (most + 1) // 2
    return before


def phases(totals: dict[str, int], weights: dict[str, int], grain: int = GRAIN) -> list[Phase]:
    """When which queues are served.

    While a phase lasts, each queue has had its weight's share of all grains at every point, but
    for a deficit of a few grains that it carries on, over windows and partitions alike. A
    phase ends where its first queue has no whole grain left, and the others go on in their own
    proportions. Queues without weight are served when the others are dry. The tails, less
    than a grain each, come last.
    """
    left = {q: totals[q] // grain for q in sorted(totals) if totals[q] >= grain}
    had = dict.fromkeys(totals, 0)
    out: list[Phase] = []
    at = 0
    while left:
        active = [q for q in left if weights[q] > 0] or list(left)
        weight = [max(1, weights[q]) for q in active]
        grains = min(position(left[q], i, weight) for i, q in enumerate(active))
        base = np.array([had[q] for q in active], np.int64)
        phase = Phase(at, grains, grains * grain, active, np.array(weight, np.int64), base)
        out.append(phase)
        for q, n in zip(active, phase.counts(np.array([grains]))[:, 0].tolist()):
            had[q] += n * grain
            left[q] -= n
            if not left[q]:
                left.pop(q)
        at += grains * grain
    for q in sorted(totals):
        if size := totals[q] % grain:
            out.append(Phase(at, 0, size, [q], np.ones(1, np.int64), np.array([had[q]])))
            at += size
    return out


def pieces_of(queue: list[str], begin: np.ndarray, n: np.ndarray, plan: list[Phase], length: int, grain: int = GRAIN):
    """(row, start, length, sequence, offset) of the pieces of documents that stand in queues."""
    names = np.array(queue, object)
    parts: list[np.ndarray] = []
    for phase in plan:
        number = {q: i for i, q in enumerate(phase.queues)}
        q = np.array([number.get(name, -1) for name in names.tolist()], np.int64)
        rows = np.flatnonzero(q >= 0)
        q = q[rows]
        served = phase.counts(np.array([phase.grains]))[:, 0] * grain if phase.grains else np.array([phase.size])
        u = np.maximum(begin[rows] - phase.base[q], 0)
        v = np.minimum(begin[rows] + n[rows] - phase.base[q], served[q])
        met = u < v
        rows, q, u, v = rows[met], q[met], u[met], v[met]
        if not len(rows):
            continue
        skew = phase.at % length
        if not phase.grains:
            low, high = (skew + u) // length, (skew + v - 1) // length
        else:
            total = int(phase.weight.sum())
            per = total / phase.weight[q]
            slack = len(phase.queues) / 2 + 2 * per  # in grains of all queues
            low = np.maximum(0, (u / grain * per - slack) * grain + skew) // length
            high = np.minimum(phase.size, (v / grain * per + slack) * grain) + skew
            low, high = low.astype(np.int64), (high // length).astype(np.int64)
        count = high - low + 1
        one = np.repeat(np.arange(len(rows)), count)
        window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        if phase.grains:
            every, at = np.unique(np.concatenate([window, window + 1]), return_inverse=True)
            cut_at = np.clip(every * length - skew, 0, phase.size)
            counts = phase.counts(cut_at // grain) * grain
            under = np.concatenate([np.zeros((1, len(every)), np.int64), np.cumsum(counts, 0)])
            here, there = at[: len(window)], at[len(window) :]
            mine, then = counts[q[one], here], counts[q[one], there]
            ahead = under[q[one], there] - under[q[one], here]  # of queues before this one in the window
            where = cut_at[here] + phase.at
        else:
            mine = np.clip(window * length - skew, 0, phase.size)
            then = np.clip((window + 1) * length - skew, 0, phase.size)
            ahead, where = np.zeros(len(window), np.int64), mine + phase.at
        first, after = np.maximum(mine, u[one]), np.minimum(then, v[one])
        real = first < after
        one, first, after = one[real], first[real], after[real]
        offset = (where[real] % length) + ahead[real] + first - mine[real]
        start = first + phase.base[q[one]] - begin[rows[one]]
        parts.append(np.stack([rows[one], start, after - first, where[real] // length, offset]))
    found = np.concatenate(parts, 1) if parts else np.zeros((5, 0), np.int64)
    return found[:, np.lexsort((found[1], found[0]))]


def _cutter(plan: list[Phase], length: int):
    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sums = np.concatenate([[0], np.cumsum(column(batch, "doc_tokens").to_numpy())])
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sums, sums[at] + (1 << 20), side="right")) - 1)
                part = batch.slice(at, to - at)
                begin, n = column(part, "begin").to_numpy(), column(part, "doc_tokens").to_numpy()
                found = pieces_of(column(part, "queue").to_pylist(), begin, n, plan, length)
                row, start, size, sequence, offset = found
                ids = [
                    np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4")
                    for x, w in zip(column(part, "ids"), column(part, "width").to_pylist())
                ]
                source = pa.array(row)
                yield pa.record_batch(
                    [
                        column(part, "doc_id").take(source),
                        column(part, "queue").take(source),
                        pa.array(start),
                        pa.array(size),
                        column(part, "doc_tokens").take(source),
                        pa.array(sequence),
                        pa.array(offset),
                        blobs(np.concatenate(ids), size * 4),
                    ],
                    ["doc_id", "queue", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
                at = to

    return cutter


def _interleaved(sums: DataFrame) -> DataFrame:
    """``before``: where each part of each source begins in a queue that many sources share.

    Parts stand in the order of their virtual time, how far into its source a part's middle is, so every source
    has about the same share of itself in any stretch of the queue. Ranges of that order are summed
    apart; only one sum for each range is on the driver.
    """
    own = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = sums.groupBy("queue").agg(F.sum("n").alias("whole"))
    timed = sums.withColumn("so_far", F.coalesce(F.sum("n").over(own), F.lit(0))).join(whole, "queue")
    timed = timed.withColumn("time", (F.col("so_far") + F.col("n") / 2) / F.col("whole"))
    order = ["time", "queue", "part"]
    ranged = cut(timed.select(*order, "n").repartitionByRange(*order).withColumn("stretch", F.spark_partition_id()), "stretches")
    base, begins = 0, []
    for r in ranged.groupBy("stretch").agg(F.sum("n").alias("n")).orderBy("stretch").collect():
        begins.append((r["stretch"], base))
        base += r["n"]
    begin = sums.sparkSession.createDataFrame(begins, "stretch int, base long")
    inside = Window.partitionBy("stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(begin), "stretch")  # a row for each range
    return told.select("queue", "part", (F.col("base") + F.col("inside")).alias("before"))


def pack(
    docs: DataFrame,
    length: int = 2048,
    targets: dict[str, float] | None = None,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 1,
    text: str = "text",
    ident: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens, each a mix of the sources.

    Returns ``doc_id``, ``queue``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``,
    ``offset`` and ``ids`` (binary, little-endian unsigned 32-bit) per piece. Every id of
    every document, ``end_id`` at its end included, lies in one piece; all sequences are full
    but the last, which alone is padded.

    A queue holds the documents of one source, in the order of the input's partitions.
    ``targets`` gives each source's share of tokens (any scale, at most MOST_QUEUES names;
    sources without one share a queue that is served when the others are dry); without
    targets each source's share is its share of the corpus. Sources beyond the largest
    MOST_QUEUES share a queue in which their parts are interleaved, each source spread over all of it. In each window a queue may send what its share and its deficit
    allow, in whole grains of GRAIN tokens; the rest is carried on. Since a queue's account
    after any number of windows has a closed form, each task finds its documents' windows by
    itself: only the tokens per source and partition are summed, and only the queues' totals
    (at most MOST_QUEUES + 1) reach the driver.

    NULL text: empty, so ``end_id`` alone. NULL ids stay NULL; repeated rows are packed each.
    NULL sources share the queue of the empty name. An empty table gives no rows.
    """
    if targets is not None and not 0 < len(targets) <= MOST_QUEUES:
        raise ValueError(f"name 1 to {MOST_QUEUES} sources")
    if length % GRAIN:
        raise ValueError(f"the length must be a multiple of {GRAIN}")
    base = docs.select(
        F.col(ident).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("queue"), F.col(text).alias("text")
    )
    kind = base.schema["doc_id"].dataType.simpleString()
    tokens = cut(
        mapped(base, _tokenise(tokenizer, end_id),
            f"doc_id {kind}, queue string, part int, begin long, doc_tokens long, width byte, ids binary",
        ),
        "tokens",
    )
    sums = cut(tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n")), "sums")
    totals = sums.groupBy("queue").agg(F.sum("n").alias("n"))
    named = list(targets) if targets is not None else None
    if named is None:
        named = [r[0] for r in totals.orderBy(F.desc("n"), "queue").limit(MOST_QUEUES).collect()]
    rest = max(named, default="") + "+"
    queue_of = F.when(F.col("queue").isin(named), F.col("queue")).otherwise(rest)
    held = {r[0]: r[1] for r in totals.groupBy(queue_of.alias("q")).agg(F.sum("n")).collect()}
    if targets is None:
        total = sum(held.values())
        scale = max(1, -(-total // WEIGHTS))
        weights = {q: max(1, n // scale) for q, n in held.items()}
    else:
        scale = sum(targets.values())
        weights = {q: round(targets.get(q, 0) / scale * WEIGHTS) for q in held}
    plan = phases(held, weights)
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    alone = sums.filter(queue_of == F.col("queue")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    before = alone.select("queue", "part", F.col("queue").alias("q"), "before")
    if rest in held:
        shared = _interleaved(sums.filter(queue_of != F.col("queue")))
        before = before.union(shared.select("queue", "part", F.lit(rest).alias("q"), "before"))
    before = cut(before, "queues")
    if before.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    placed = tokens.join(before, ["queue", "part"]).select(
        "doc_id", F.col("q").alias("queue"), (F.col("begin") + F.col("before")).alias("begin"), "doc_tokens", "width", "ids"
    )
    return mapped(placed, _cutter(plan, length),
        f"doc_id {kind}, queue string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )
