"""Near duplicates, repeated substrings and passages against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from conftest import DATA
from llm import brute
from pyspark.sql import functions as F

from stallwise.llm import covertree, oddsketch, sampling, suffixes
from stallwise.llm.common import document_columns
from stallwise.llm.debruijn import dedup_substrings
from stallwise.llm.graph import components
from stallwise.llm.oddsketch import dedup_report, without_near_duplicates
from stallwise.llm.queries import QUERIES
from stallwise.llm.suffixes import dedup_passages

DOCS = "doc_id long, text string, source string, n_words string"


def _copies(seed: int, length: int) -> list[tuple]:
    """Documents that share passages, some with a word changed, and odd rows."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(10**6)}"
    passages = [[word() for _ in range(draw.randrange(length - 2, 4 * length))] for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(draw.randrange(1, 5)):
            text += [word() for _ in range(draw.randrange(0, 15))]
            passage = list(draw.choice(passages))
            if draw.random() < 0.4:
                passage[draw.randrange(len(passage))] = word()
            text += passage
        rows.append((i, draw.choice([" ", "  ", "\n"]).join(text), "s", "x"))
    rows += [(100, " ".join(["on", "and"] * 3 * length), "s", "x"), (101, None, None, None), (102, "", "s", None)]
    rows += [(103, " \t\n ", "s", None), (104, rows[3][1], "s", None), (105, " ".join(f"é{i}" for i in range(length)), "s", None)]
    return rows


@pytest.mark.parametrize("length,k", [(20, 6), (8, 3)])
def test_substrings_match_brute_force(spark, length, k):
    rows = _copies(length, length)
    done = dedup_substrings(spark.createDataFrame(rows, DOCS).repartition(5), length, k)
    assert done.columns == ["doc_id", "text", "source", "n_words", "n_removed"]
    gone = brute.repeated([r[:2] for r in rows], length)
    for r in done.collect():
        kept = [w for w, g in zip(brute.words(dict(r_[:2] for r_ in rows)[r.doc_id]), gone[r.doc_id]) if not g]
        assert (r.n_words, r.n_removed) == (len(gone[r.doc_id]), sum(gone[r.doc_id]))
        assert r.text.encode() == b" ".join(kept)


@pytest.mark.parametrize("length,k", [(50, 16), (9, 4)])
def test_passages_match_brute_force(spark, length, k):
    rows = _copies(length + 1, length)
    done = dedup_passages(spark.createDataFrame(rows, DOCS).repartition(5), length, k)
    gone = brute.repeated([r[:2] for r in rows], length)
    text = dict(r[:2] for r in rows)
    for r in done.collect():
        kept = [w for w, g in zip(brute.words(text[r.doc_id]), gone[r.doc_id]) if not g]
        assert (r.n_words, r.n_removed) == (len(gone[r.doc_id]), sum(gone[r.doc_id]))
        assert brute.words(r.text) == kept
        if not r.n_removed:
            assert r.text == (text[r.doc_id] or "")


def test_a_head_may_span_batches(spark, monkeypatch):
    """A passage that all documents share, in slices of few suffixes."""
    monkeypatch.setattr(suffixes, "HELD", 5)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([f"a{i}", *passage[i % 4 :], f"b{i}"])) for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        done = {r.doc_id: r for r in dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), 12, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    gone = brute.repeated(rows, 12)
    assert {d: r.n_removed for d, r in done.items()} == {d: sum(g) for d, g in gone.items()}


@pytest.mark.parametrize("rows_a_batch", ["10000", "3"])
def test_a_common_head_is_shared_out(spark, monkeypatch, rows_a_batch):
    """Lines and ends of passages that many documents share, in surroundings of their own."""
    monkeypatch.setattr(suffixes, "MANY", 3)
    monkeypatch.setattr(suffixes, "PARTED", 7)
    length, k, n = 12, 4, 60
    line, passage = [f"l{i}" for i in range(6)], [f"p{i}" for i in range(20)]
    around = lambda i, x: [f"{x}{i}w{j}" for j in range(15)]
    rows = [(i, " ".join([*around(i % 50, "a"), *line, *around(i, "b"), *passage[i % 3 :], *around(i, "c")])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        base = docs.withColumns(document_columns()).withColumn("text", F.col("text"))
        parts = suffixes.parted_suffixes(base, length, k).filter("kind <> 1")
        most = parts.groupBy("route").count().agg(F.max("count")).first()[0]
        done = {r.doc_id: r for r in dedup_passages(docs, length, k).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows_a_batch == "3" or most <= 32
    gone = brute.repeated(rows, length)
    assert {d: r.n_removed for d, r in done.items()} == {d: sum(g) for d, g in gone.items()}
    for d, text in rows:
        assert brute.words(done[d].text) == [w for w, g in zip(brute.words(text), gone[d]) if not g]


@pytest.mark.parametrize("length,k", [(50, 16), (9, 4)])
def test_passages_match_brute_force_in_parts(spark, monkeypatch, length, k):
    monkeypatch.setattr(suffixes, "MANY", 2)
    test_passages_match_brute_force(spark, length, k)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (7, text + " tail"), (None, text), (None, text)]
    for dedup in (dedup_substrings, dedup_passages):
        done = dedup(spark.createDataFrame(rows, "doc_id long, text string"), 10, 4).collect()
        found = Counter((r.doc_id, r.n_words, r.n_removed) for r in done)
        assert found == Counter({(5, 30, 0): 2, (7, 31, 30): 1, (None, 30, 30): 2})


def test_many_null_ids(spark):
    """Half of the documents have no id: each is looked at by its own positions, all after the others."""
    rows = _copies(3, 12)
    rows = [(None if i % 2 else d, t) for i, (d, t, *_) in enumerate(rows)]
    rows.append((200, " ".join(f"v{i % 5000}" for i in range(40_000))))  # very long, repeats itself
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    base = docs.withColumns(document_columns()).filter("text is not null")
    marks = sampling.positions_of(sampling.known_positions(base, 4, 12)).collect()
    assert len(marks) > sum(d is None and t is not None for d, t in rows) // 2
    own = {d: brute.words(t) for d, t in rows if d is not None}
    first = {}
    for d in sorted(own):
        for i in range(len(own[d]) - 11):
            first.setdefault(tuple(own[d][i : i + 12]), (d, i))
    for dedup in (dedup_substrings, dedup_passages):
        for r in dedup(docs, 12, 4).filter("doc_id is not null").collect():
            gone = set()
            for i in range(len(own[r.doc_id]) - 11):
                if first[tuple(own[r.doc_id][i : i + 12])] != (r.doc_id, i):
                    gone.update(range(i, i + 12))
            assert r.n_removed == len(gone)


def test_reserved_names_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, __doc string")
    for run in (dedup_passages, dedup_substrings, without_near_duplicates):
        with pytest.raises(ValueError, match="reserved"):
            run(docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(docs).isEmpty() and dedup_passages(docs).isEmpty()
    assert dedup_report(docs, 3, 85).isEmpty() and without_near_duplicates(docs).isEmpty()
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert covertree.vector_links(empty).isEmpty()


def _near(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for _ in range(4):
        base = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        for _ in range(25):
            text = list(base)
            for _ in range(draw.randrange(1, 12)):
                text[draw.randrange(len(text))] = f"x{draw.randrange(10**6)}"
            rows.append(" ".join(text))
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    return rows + [(None, "a b c"), (1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A b"), (1004, "A b"), (1005, "a b c")]


@pytest.mark.parametrize("k,percent,block", [(3, 85, 1500), (5, 80, 6)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(oddsketch, "BLOCK", block)
    monkeypatch.setattr(oddsketch, "HOT", block)
    rows = _near(k) + [(2000, " ".join(f"long{i}" for i in range(60_000)))]
    sets = [brute.shingles(t, k) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    group = brute.groups(len(rows), links)
    ident = [2**63 if d is None else d for d, _ in rows]
    least = {}
    for i, g in enumerate(group):
        least[g] = min(least.get(g, 2**63), ident[i])
    expected = Counter(
        (d, len(sets[i]), None if least[group[i]] == 2**63 else least[group[i]], ident[i] == least[group[i]])
        for i, (d, _) in enumerate(rows)
    )
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(4)
    assert Counter(tuple(r) for r in dedup_report(docs, k, percent).collect()) == expected
    kept = without_near_duplicates(docs, k, percent)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(e[0] for e in expected.elements() if e[3])


def test_common_counts():
    import numpy as np

    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 300, 60)).astype(np.uint64) for _ in range(12)]
    p, q = np.triu_indices(12, 1)
    found = oddsketch.common_counts(sets, p, q)
    assert found.tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(p, q)]


def test_sketches_spare_similar_pairs():
    """Of pairs at the threshold none may exceed the odd bits that are allowed."""
    import numpy as np

    draw = np.random.default_rng(2)
    worst = 0
    for _ in range(60):
        common = draw.integers(0, 2**63, 850, dtype=np.uint64)
        pair = [np.unique(np.concatenate([common, draw.integers(0, 2**63, 75, dtype=np.uint64)])) for _ in range(2)]
        least = [oddsketch.minhashes(s) for s in pair]
        worst = max(worst, 2 * int((least[0] != least[1]).sum()))
    assert worst <= oddsketch.most_odd_bits(0.85) * 1.2


def test_components_of_chains_hubs_and_cycles(spark):
    links = [(i, i + 1) for i in range(50)] + [(100 + i, 500) for i in range(80)] + [(300, 301), (301, 302), (302, 300), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    found = {r.node: r.component for r in components(df).collect()}
    assert all(found[i] == 0 for i in range(1, 51))
    assert all(found[i] == 100 for i in range(101, 180)) and found[500] == 100
    assert found[301] == found[302] == 300


@pytest.mark.parametrize("name,length", [("op7_substring_dedup", 20), ("op5_suffix_array_dedup", 50)])
def test_whole_table_queries(spark, name, length):
    folder = f"{DATA}/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    gone = brute.repeated(rows, length)
    found = {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}
    assert len(found) == len(rows)
    for d, text in rows:
        assert (found[d].n_words, found[d].n_removed) == (len(gone[d]), sum(gone[d]))
        if name.startswith("op7"):
            kept = b" ".join(w for w, g in zip(brute.words(text), gone[d]) if not g)
            assert found[d].kept_sha256 == hashlib.sha256(kept).hexdigest()
