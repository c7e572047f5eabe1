"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stallwise.llm.common import U64, Words, blobs, column, mapped, mix, slices, text_buffer
SLOTS = 1 << 20  # hashed features
SAMPLE = 12_000  # labelled documents to learn from, at most
KEPT = 20_000  # features that enter the regression, at most
THRESHOLD = 0.3  # chance from which a document counts as toxic: one that is missed costs more than a clean one
GRADES = 4  # 0 clean, 1 to 3 toxic by rising evidence
_OTHER = np.ones(256, bool)
_OTHER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    """Shared weights and rising thresholds: P(grade <= j) = sigmoid(cut[j] - score)."""

    weight: np.ndarray  # by slot; 0 where a feature has no part
    cut: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of each letter word and of its beginnings of four and five bytes."""
    words = Words(data, offsets, lower=True, separator=_OTHER)
    owner = words.owner()
    slots = [mix(words.hashes(most) + U64(i)) % U64(SLOTS) for i, most in enumerate((None, 4, 5))]
    long = words.end - words.start > 5
    owners = [owner, owner[long], owner[long]]
    return np.concatenate(owners), np.concatenate([slots[0], slots[1][long], slots[2][long]]).astype(np.int64)


def counted(owner: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, slot) with log2(1 + count)."""
    key, count = np.unique(owner * SLOTS + slot, return_counts=True)
    return key // SLOTS, key % SLOTS, np.log2(1 + count)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fit(row: np.ndarray, slot: np.ndarray, value: np.ndarray, toxic: np.ndarray, rounds: int = 400) -> Model | None:
    """Fit to sparse rows with labels 0 and 1; None if one of the labels is missing.

    Features with a clear difference between the labels (five standard errors, three toxic
    documents) enter. Toxic documents are graded by their summed log odds, in three equal parts.
    """
    many = np.array([np.count_nonzero(toxic == 0), np.count_nonzero(toxic == 1)], float)
    if not many.all():
        return None
    df = np.zeros((2, SLOTS))
    for at in range(0, len(row), 1 << 20):
        some, bad = slot[at : at + (1 << 20)], toxic[row[at : at + (1 << 20)]] == 1
        df[1] += np.bincount(some[bad], minlength=SLOTS)
        df[0] += np.bincount(some[~bad], minlength=SLOTS)
    share = (df + 0.05) / (many[:, None] + 0.1)
    pooled = df.sum(0) / many.sum()
    error = np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / many).sum(), 1e-12))
    clear = np.abs(df[1] / many[1] - df[0] / many[0]) / error
    clear[(clear < 5) | (df[1] < 3)] = 0
    chosen = np.argsort(-clear, kind="stable")[:KEPT]
    chosen = np.sort(chosen[clear[chosen] > 0])
    odds = np.log(share[1] / share[0])
    used = np.flatnonzero((clear > 0)[slot])
    row, slot, value = row[used].astype(np.int64), slot[used].astype(np.int64), value[used].astype(float)
    evidence = np.bincount(row, weights=odds[slot] * value, minlength=len(toxic))
    grade = np.zeros(len(toxic), np.int64)
    bad = np.flatnonzero(toxic == 1)
    grade[bad] = 1 + np.searchsorted(np.quantile(evidence[bad], [1 / 3, 2 / 3]), evidence[bad])
    place = np.full(SLOTS, -1)
    place[chosen] = np.arange(len(chosen))
    used = place[slot] >= 0
    row, at, value = row[used], place[slot[used]], value[used]
    params = [np.zeros(len(chosen)), np.array([2.0, 0.0, 0.0])]  # weights; first threshold and log gaps
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        weight, free = params
        cut = np.concatenate([[-np.inf], np.cumsum([free[0], *np.exp(free[1:])]), [np.inf]])
        score = np.bincount(row, weights=weight[at] * value, minlength=len(toxic))
        upper, lower = sigmoid(cut[grade + 1] - score), sigmoid(cut[grade] - score)
        p = np.maximum(upper - lower, 1e-9)
        n = len(toxic)
        pull = (1 - upper - lower) / n  # d loss / d score
        d_weight = np.bincount(at, weights=pull[row] * value, minlength=len(chosen)) + 1e-5 * weight
        up, down = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n
        d_cut = np.array([down[grade == j + 1].sum() - up[grade == j].sum() for j in range(GRADES - 1)])
        later = np.cumsum(d_cut[::-1])[::-1]
        d_free = np.concatenate([later[:1], later[1:] * np.exp(free[1:])])
        for x, g, m, v in zip(params, (d_weight, d_free), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    weight = np.zeros(SLOTS, np.float32)
    weight[chosen] = params[0]
    return Model(weight, np.cumsum([params[1][0], *np.exp(params[1][1:])]))


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        owner, slot, value = counted(*features(*text_buffer(column(part, "text"))))
        n = np.bincount(owner, minlength=part.num_rows)
        raw = blobs(slot.astype("<u4"), n * 4), blobs(np.round(value * 16).clip(0, 255).astype(np.uint8), n)
        yield pa.record_batch([column(part, "toxic"), *raw], ["toxic", "slots", "values"])


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "toxic"
) -> Model | None:
    """Fit on at most SAMPLE labelled documents, chosen by a hash of their ids.

    Labels other than 0 and 1 and NULL ids do not count; of several labels of one id the largest
    does, and of several texts the last in order. The sample's features (hashed words and counts, no texts) come to the driver.
    """
    clean = labels.select(F.col(ident).cast("long").alias("__id"), F.col(label).cast("int").alias("toxic"))
    clean = clean.filter("__id is not null and toxic in (0, 1)").groupBy("__id").agg(F.max("toxic").alias("toxic"))
    chosen = clean.orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)
    known = docs.select(F.col(ident).cast("long").alias("__id"), F.col(text).alias("text")).filter("text is not null")
    # at most SAMPLE ids and labels, 12 bytes each
    known = known.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    known = known.select("text", "toxic")
    found = mapped(known, _sampler, "toxic int, slots binary, values binary").toLocalIterator()
    rows = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in found)
    if not rows:
        return None
    toxic = np.array([r[0] for r in rows], np.int8)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) for r in rows])
    slot = np.frombuffer(b"".join(r[1] for r in rows), "<u4")
    value = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).astype(np.float32) / 16
    del rows
    return fit(row, slot, value, toxic)


def _scorer(model: Model | None, names: list[str], text: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            n = part.num_rows
            chance, severity = np.zeros(n), np.zeros(n)
            if model is not None:
                owner, slot = features(*text_buffer(column(part, text)))
                used = model.weight[slot] != 0
                row, slot, value = counted(owner[used], slot[used])
                total = np.bincount(row, weights=model.weight[slot] * value, minlength=n)
                above = 1 - sigmoid(model.cut[None, :] - total[:, None])
                chance, severity = above[:, 0], above.sum(1)
            arrays = [column(part, c) for c in names]
            yield pa.record_batch([*arrays, pa.array(chance), pa.array(severity)], [*names, "p_toxic", "severity"])

    return score


def with_severity(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``p_toxic`` (grade 1 or more) and ``severity``, the expected grade from 0 to 3.

    Whole texts are scored, NULL ones as empty. Without a model, for want of labels of either kind,
    both are 0. Input columns of these names are replaced; rows are scored each for itself.
    """
    names = [c for c in docs.columns if c not in ("p_toxic", "severity")]
    base = docs.select(*names)
    schema = base.withColumn("p_toxic", F.lit(0.0)).withColumn("severity", F.lit(0.0)).schema
    return mapped(base, _scorer(model, names, text), schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose chance to be toxic is below THRESHOLD, columns as they are."""
    return with_severity(docs, learn(docs, labels)).filter(F.col("p_toxic") < THRESHOLD).select(*docs.columns)
