"""Language of documents by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise.llm.common import column, mapped, slices, text_buffer
HIDDEN = 8  # units each way for 16 languages; more languages get more
SPAN = 96  # bytes that the network reads in one go; a text is read span by span, to its end
WIDTH = 2048  # spans side by side
SAMPLE = 250  # labelled documents a language at most
PART = 8000  # bytes of each at most; for more than 64 languages less, in proportion
SCORES = 1 << 21  # texts times languages whose means are held at once
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Network:
    """Weights of both directions; gates in the order update, reset, new."""

    languages: list[str]
    byte: list[np.ndarray]  # (256, 3H): what each byte adds to the gates, biases included
    turn: list[np.ndarray]  # (3H, H): what the state adds
    out: np.ndarray  # (K, 2H)
    bias: np.ndarray  # (K,)

    def arrays(self) -> list[np.ndarray]:
        return [*self.byte, *self.turn, self.out, self.bias]


def units(languages: int) -> int:
    """Hidden units each way that tell this many languages apart."""
    return HIDDEN * max(1, int(np.ceil((languages / 16) ** 0.5)))


def fresh(languages: list[str], seed: int = 7) -> Network:
    draw = np.random.default_rng(seed)
    size = units(len(languages))
    byte = [draw.normal(0, 0.5, (256, 3 * size)).astype(np.float32) for _ in range(2)]
    turn = [draw.normal(0, size**-0.5, (3 * size, size)).astype(np.float32) for _ in range(2)]
    out = draw.normal(0, 0.3, (len(languages), 2 * size)).astype(np.float32)
    return Network(languages, byte, turn, out, np.zeros(len(languages), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _states(letters: np.ndarray, byte: np.ndarray, turn: np.ndarray, real: np.ndarray | None, order: range, keep: bool):
    """States (T, H, N) of one direction; with ``keep`` also what backpropagation needs."""
    size = turn.shape[1]
    table = np.ascontiguousarray(byte.T)
    h = np.zeros((size, letters.shape[1]), np.float32)
    out = np.empty((len(letters), size, letters.shape[1]), np.float32)
    tape = []
    for t in order:
        x = table.take(letters[t], axis=1)
        a = turn @ h
        gates = _sigmoid(x[: 2 * size] + a[: 2 * size])
        z, r = gates[:size], gates[size:]
        new = np.tanh(x[2 * size :] + r * a[2 * size :])
        if keep:
            tape.append((t, h, z, r, new, a[2 * size :]))
        h = new + z * (h - new)
        if real is not None:
            h = h * real[t]
        out[t] = h
    return out, tape


def position_probabilities(net: Network, letters: np.ndarray, real: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each position t of the spans (T, N): the probabilities (K, N) of its language."""
    steps, size = range(len(letters)), net.turn[0].shape[1]
    ahead, _ = _states(letters, net.byte[0], net.turn[0], real, steps, False)
    back, _ = _states(letters, net.byte[1], net.turn[1], real, steps[::-1], False)
    for t in steps:
        score = net.out[:, :size] @ ahead[t] + net.out[:, size:] @ back[t] + net.bias[:, None]
        score -= score.max(0)
        np.exp(score, out=score)
        score /= score.sum(0)
        yield t, score


def gradients(net: Network, letters: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions that are letters, and its gradient by backpropagation through time."""
    size, n = net.turn[0].shape[1], letters.shape[1]
    steps = range(len(letters))
    runs = [
        _states(letters, net.byte[0], net.turn[0], None, steps, True),
        _states(letters, net.byte[1], net.turn[1], None, steps[::-1], True),
    ]
    weight = _LETTER[letters].astype(np.float32)
    weight /= max(weight.sum(), 1)
    d_out, d_bias = np.zeros_like(net.out), np.zeros_like(net.bias)
    d_state = [np.empty_like(runs[0][0]), np.empty_like(runs[1][0])]
    loss = 0.0
    for t in steps:
        both = np.concatenate([runs[0][0][t], runs[1][0][t]])
        score = net.out @ both + net.bias[:, None]
        score -= score.max(0)
        p = np.exp(score)
        p /= p.sum(0)
        loss -= float((np.log(p[label, np.arange(n)] + 1e-12) * weight[t]).sum())
        p[label, np.arange(n)] -= 1
        p *= weight[t]
        d_out += p @ both.T
        d_bias += p.sum(1)
        d = net.out.T @ p
        d_state[0][t], d_state[1][t] = d[:size], d[size:]
    d_byte, d_turn = [], []
    for way in range(2):
        byte, turn = np.zeros((3 * size, 256), np.float32), np.zeros_like(net.turn[way])
        later = np.zeros((size, n), np.float32)
        for t, h, z, r, new, a in reversed(runs[way][1]):
            d = d_state[way][t] + later
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (h - new) * z * (1 - z)
            d_r = d_new * a * r * (1 - r)
            gates = np.concatenate([d_z, d_r, d_new])
            for g in range(3 * size):
                byte[g] += np.bincount(letters[t], weights=gates[g], minlength=256)
            gates[2 * size :] *= r
            turn += gates @ h.T
            later = d * z + net.turn[way].T @ gates
        d_byte.append(byte.T)
        d_turn.append(turn)
    return loss, [*d_byte, *d_turn, d_out, d_bias]


def train(texts: list[tuple[bytes, str]], rounds: int = 320, batch: int = 192, span: int = 48, seed: int = 11) -> Network | None:
    """A network from (text, language) pairs: random spans, languages in equal parts, Adam.

    Many languages get more rounds, so that each is seen ``batch * rounds / 64`` times at least.
    """
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    draw = np.random.default_rng(seed)
    net = fresh(languages)
    by = [[np.frombuffer(t, np.uint8) for t, lang in texts if lang == name and t] for name in languages]
    by = [[x if len(x) >= span else np.resize(np.append(x, np.uint8(32)), span) for x in some] for some in by]
    usable = [k for k, some in enumerate(by) if some]
    if not usable:
        return None
    rounds = max(rounds, -(-rounds * len(usable) // 64))
    params = net.arrays()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        label = np.take(usable, np.arange((step - 1) * batch, step * batch), mode="wrap")
        letters = np.empty((span, batch), np.uint8)
        for i, k in enumerate(label):
            x = by[k][draw.integers(len(by[k]))]
            at = draw.integers(len(x) - span + 1)
            letters[:, i] = x[at : at + span]
        _, grads = gradients(net, letters, label)
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        rate = 0.02 * min(1.0, 2 * (1 - step / (rounds + 1)))
        for p, g, m, v in zip(params, grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, K): the mean probabilities over all letters of each whole text (zeros without any)."""
    size = np.diff(offsets)
    count = -(-size // SPAN)
    owner = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[owner] + number * SPAN
    length = np.minimum(SPAN, offsets[owner + 1] - start)
    total = np.zeros((len(size), len(net.languages)))
    letters_in = np.zeros(len(size))
    padded = np.concatenate([data, np.zeros(SPAN, np.uint8)])
    order = np.argsort(-length, kind="stable")  # spans of one length side by side
    for at in range(0, len(order), WIDTH):
        some = order[at : at + WIDTH]
        longest = int(length[some[0]])
        place = start[some][None, :] + np.arange(longest)[:, None]
        letters = padded[place]
        real = None
        if length[some[-1]] < longest:
            real = np.arange(longest)[:, None] < length[some][None, :]
        counts = _LETTER[letters] if real is None else _LETTER[letters] & real
        mask = counts.astype(np.float32)
        held = np.zeros((len(net.languages), len(some)), np.float32)
        for t, p in position_probabilities(net, letters, None if real is None else real.astype(np.float32)):
            p *= mask[t]
            held += p
        np.add.at(total, owner[some], held.T)
        np.add.at(letters_in, owner[some], mask.sum(0))
    return total / np.maximum(letters_in, 1)[:, None]


def learn(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", ident: str = "doc_id") -> Network | None:
    """Train on at most SAMPLE documents, chosen by hash, of each language.

    Only rows with ``may_learn``, a text and a language count; of several texts under one id one does. The sample alone comes to the driver, PART
    characters from a random place of each text at most, fewer for more than 64 languages. None if there is nothing to learn from.
    """
    known = docs.filter(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    languages = known.select(lang).distinct().count()
    most = max(PART * 64 // max(languages, 64), 2 * SPAN)
    size, order = F.length(text), F.xxhash64(F.col(ident).cast("string"), F.lit(5))
    part = F.substring(F.col(text), (F.pmod(order, F.greatest(size - most, F.lit(1))) + 1).cast("int"), F.lit(most))
    rows = known.select(F.col(lang).alias("lang"), part.alias("part"), order.alias("h"))
    # Ranks are taken of hashes alone, so that no text is sorted or moved but the chosen ones.
    ranked = rows.select("lang", "h").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = ranked.filter(F.col("n") <= SAMPLE).select("lang", "h").distinct()  # SAMPLE rows a language at most
    picked = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.max("part").alias("part"))
    return train(sorted((r[0].encode(), r[1]) for r in picked.select("part", "lang").toLocalIterator()))


def identify(docs: DataFrame, net: Network | None, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row.

    The network labels every byte of the whole text; the probabilities of all letters are
    averaged and the best mean is the score. ``und`` with score 0 for NULL texts, texts without a
    letter, or without a network (nothing to learn from). Repeated rows are predicted each.
    """
    kind = docs.schema[ident].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 21):
            if net is None:
                names, score = [None] * part.num_rows, np.zeros(part.num_rows)
            else:
                names, scores = [], [np.zeros(0)]
                step = max(1, SCORES // len(net.languages))
                for at in range(0, part.num_rows, step):
                    p = pooled(net, *text_buffer(column(part.slice(at, step), "text")))
                    names += [net.languages[i] for i in p.argmax(1)]
                    scores.append(p.max(1))
                score = np.concatenate(scores)
            yield pa.record_batch([column(part, "doc_id"), column(part, "letter"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "letter", "lang", "p"])

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letter")
    base = docs.select(F.col(ident).alias("doc_id"), letter, F.when(letter, F.col(text)).alias("text"))
    told = mapped(base, predict, f"doc_id {kind}, letter boolean, lang string, p double")
    sure = F.col("letter") & F.col("lang").isNotNull()
    return told.select(
        "doc_id", F.when(sure, F.col("lang")).otherwise("und").alias("lang_pred"),
        F.when(sure, F.least("p", F.lit(1.0))).otherwise(0.0).alias("score"),
    )
