"""Packing: exact round trips, full sequences, and the mixture."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stallwise.llm import packing
from stallwise.llm.queries import QUERIES

SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FAST = packing.Encoder("byte_bpe_50k.json")


def _ids(text: str | None) -> list[int]:
    return SLOW.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  c.,!?'\n\tsé²½ª1२ʰ漢😀́_-\x1c\x85 <|>"), max_size=60))
def test_ids_are_those_of_the_tokenizers_library(text):
    for t in (text, f"{text} don't stop. {text}", f"{text}<|endoftext|>{text}"):
        assert np.frombuffer(FAST.ids(t), "<u2").tolist() == _ids(t)


def _check(pieces, rows: list[tuple], length: int) -> dict[int, list]:
    """Every id in one piece, sequences gapless and full but the last; pieces by sequence."""
    texts, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        texts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for ident, text, *_ in rows:
        ids = [*_ids(text), 1]
        at = 0
        for r in sorted(texts.pop(ident), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    assert not texts
    assert sorted(sequences) == list(range(len(sequences)))
    for number, held in sequences.items():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:i]) for i in range(len(held))]
        size = sum(r.length for r in held)
        assert size == length or number == len(sequences) - 1 and 0 < size < length
    return sequences


def _rows(n: int = 80) -> list[tuple]:
    draw = random.Random(3)
    names = ["big", "big", "big", "mid", "small", None]
    rows = [(i, " ".join("word" for _ in range(draw.randrange(0, 400))), draw.choice(names)) for i in range(n)]
    return rows + [(n, None, "big"), (n + 1, "", "mid"), (n + 2, "x " * 5000, "small")]


DOCS = "doc_id long, text string, source string"


def test_all_ids_are_packed_once_in_corpus_proportions(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"start": F.lit(7), "queue": F.lit("clash")}).repartition(5)
    sequences = _check(packing.pack(docs, 512).collect(), rows, 512)
    total = Counter()
    for _, text, source in rows:
        total[source or ""] += len(_ids(text)) + 1
    every = sum(total.values())
    for number, held in sequences.items():
        if number < len(sequences) * 0.8:  # small queues run dry near the end
            share = Counter()
            for r in held:
                share[r.queue] += r.length
            for source, n in total.items():
                assert abs(share[source] - 512 * n / every) <= 2 * packing.GRAIN + 1


def test_targets_hold_until_a_queue_is_dry(spark):
    rows = _rows(200)
    pieces = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), 512, {"mid": 1, "small": 3}).collect()
    sequences = _check(pieces, rows, 512)
    for number in range(8):
        share = Counter()
        for r in sequences[number]:
            share[r.queue] += r.length
        assert abs(share["small"] - 384) <= 2 * packing.GRAIN + 1 and abs(share["mid"] - 128) <= 2 * packing.GRAIN + 1
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame(rows, DOCS), targets={})


def test_sources_beyond_the_limit_share_a_queue(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 2)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    rows = _rows(40)
    _check(packing.pack(spark.createDataFrame(rows, DOCS), 256).collect(), rows, 256)


def test_sources_of_a_shared_queue_are_interleaved(spark, monkeypatch):
    """Any stretch of the queue that small sources share holds about the same part of each of them."""
    monkeypatch.setattr(packing, "MOST_QUEUES", 1)
    rows = [(i, "word " * 50, "big" if i % 3 == 0 else f"small{i % 7}") for i in range(1680)]
    docs = spark.createDataFrame(rows, DOCS).repartition(16, "doc_id")
    pieces = packing.pack(docs, 512).collect()
    _check(pieces, rows, 512)
    source = {i: s for i, _, s in rows}
    placed = sorted((r.sequence_id, r.offset, source[r.doc_id], r.length) for r in pieces if source[r.doc_id] != "big")
    total = Counter()
    for _, _, s, n in placed:
        total[s] += n
    half, seen = sum(total.values()) / 2, Counter()
    for _, _, s, n in placed:
        if sum(seen.values()) < half:
            seen[s] += n
    assert all(0.35 < seen[s] / total[s] < 0.65 for s in total)


@settings(max_examples=250, deadline=None)
@given(
    st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 5000), min_size=1),
    st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 50)),
)
def test_any_plan_covers_every_token_once(totals, weights):
    plan = packing.phases(totals, {q: weights.get(q, 0) for q in totals})
    assert sum(p.size for p in plan) == sum(totals.values())
    cells = []
    for queue, n in totals.items():
        n = np.array([n // 3, n - n // 3])
        found = packing.pieces_of([queue] * 2, np.array([0, n[0]]), n, plan, 64)
        assert [found[2][found[0] == i].sum() for i in (0, 1)] == n.tolist()
        cells += zip(*found[[3, 4, 2]].tolist())
    at = 0
    for sequence, offset, size in sorted(cells):
        assert sequence * 64 + offset == at and offset + size <= 64
        at += size
    assert at == sum(totals.values())


def test_empty_table_and_repeated_rows(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).isEmpty()
    rows = [(1, "same text", "s"), (1, "same text", "s"), (None, "no id", "s")]
    pieces = packing.pack(spark.createDataFrame(rows, DOCS), 32).collect()
    assert sum(r.length for r in pieces) == sum(len(_ids(t)) + 1 for _, t, _ in rows)


def test_the_query_packs_the_whole_table(spark):
    folder = f"{DATA}/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    pieces = QUERIES["op1_packing"](spark, folder).collect()
    assert sum(r.length for r in pieces) == sum(len(_ids(t)) + 1 for _, t in rows)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(pieces[0].asDict())
