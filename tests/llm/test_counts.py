"""Periodic runs, divergences of sources and top-k search against plain Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from llm import brute

from stallwise.llm import divergence, periods, voronoi


# --- periodic runs --------------------------------------------------------------------


def _runs(words: list, least: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, repeats * q):
                found.setdefault((i, length), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def _doubled(ident: int | None, words: list) -> list:
    h = zlib.crc32(str(ident).encode())
    n = len(words)
    if ident is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def _told(ident: int | None, text: str | None) -> tuple:
    words = _doubled(ident, brute.words(text))
    found = _runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(found), *head, sha256(lines.encode()).hexdigest(), sha256(left).hexdigest())


def _texts(seed: int, n: int) -> list[str]:
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(draw.integers(1, 6)):
            unit = draw.integers(0, draw.choice([2, 3, 50]), draw.integers(1, 14)).tolist()
            parts += unit * int(draw.integers(1, 9)) + unit[: draw.integers(0, len(unit) + 1)]
        out.append(" ".join(f"w{x}" for x in parts))
    return out


@pytest.mark.parametrize("least, repeats", [(6, 4), (2, 3), (20, 5), (7, 3)])
def test_runs_of_small_alphabets(least, repeats):
    texts = [t.split() for t in _texts(3, 150)]
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    ids = np.array([number[w] for t in texts for w in t])
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = defaultdict(list)
    for d, *run in zip(*(x.tolist() for x in periods.periodic_runs(ids, first, least, repeats))):
        got[d].append(tuple(run))
    for d, words in enumerate(texts):
        assert got[d] == sorted(_runs(words, least, repeats), key=lambda r: (r[0], r[2]))


def test_seeds_stay_few_in_one_word():
    place, lag = periods.seeds(np.full(5000, 7, np.uint64), np.array([0, 5000]))
    assert len(place) < 5000 and set(lag.tolist()) == {1}


def test_runs_of_a_table(spark):
    texts = [*_texts(5, 60), None, "", " \n\t", "a " * 7, "a b " * 3 + "a", "x y " * 9, "lo " * 40_000, "z" * 300_000]
    rows = [(i, t, "old") for i, t in enumerate(texts)]
    rows += [(None, "q r " * 30, "old"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs string").repartition(3)
    got = Counter(tuple(r) for r in periods.with_runs(df, double_by="doc_id", digests=True).drop("text").collect())
    assert got == Counter((i, *_told(i, t)) for i, t, _ in rows)
    plain = {r.doc_id: r for r in periods.with_runs(df.filter("doc_id >= 60")).collect()}
    assert plain[63].runs == [[0, 7, 1]] and plain[63].collapsed == "a"
    assert plain[60].runs == [] and plain[60].collapsed == "" and plain[60].start is None
    assert periods.with_runs(df.limit(0)).collect() == []


def test_runs_need_their_columns(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, runs string")
    with pytest.raises(ValueError):
        periods.with_runs(df, text="runs")


# --- divergence -----------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def _audit(rows: list[tuple], terms: int, least: int) -> Counter:
    out = Counter()
    rows = [tuple(x or "" for x in r) for r in rows]
    for lang in {r[0] for r in rows}:
        mine = [(s, _terms(t)) for g, s, t in rows if g == lang]
        docs = Counter(x for _, t in mine for x in set(t))
        kept = sorted(x for x in docs if docs[x] >= least)
        counts = {s: Counter() for s, _ in mine}
        for s, t in mine:
            counts[s].update(x for x in t if docs[x] >= least)
        every = sum(counts.values(), Counter())

        def share(c: Counter) -> dict[str, int]:
            total = sum(c.values())
            return {x: 1 + 10**9 * (c[x] + 1) // (total + len(kept)) for x in kept}

        shares, whole = {s: share(c) for s, c in counts.items()}, share(every)
        f = lambda p, q: (p - q) ** 2 // q
        for s, p in shares.items():
            pairs = [(sum(f(p[x], q[x]) for x in kept), o) for o, q in shares.items() if o != s]
            own = [(f(p[x], whole[x]), x) for x in kept if counts[s][x] and p[x] > whole[x]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", own, terms)):
                found.sort(key=lambda r: (-r[0], r[1].encode()))
                out.update((lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most]))
    return out


def _documents(seed: int, n: int) -> list[tuple]:
    draw = np.random.default_rng(seed)
    stock = ["a", "of", "The", "house", "été", "中文", "internationally", "notwithstanding", "notwithstandinh",
             "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "x" * 40, "X" * 33, "y" * 33, "Zz", "\U0001f600"]
    out = []
    for _ in range(n):
        source = f"s{min(int(draw.geometric(0.2)), 12)}"
        words = draw.choice(stock, draw.integers(0, 30), p=(w := draw.random(len(stock)) ** 3) / w.sum())
        out.append((["en", "de"][int(draw.random() < 0.3)], source, " 1,".join(words.tolist())))
    return out


@pytest.mark.parametrize("sources, at_once", [(256, 4 << 20), (3, 200)])
def test_audit(spark, monkeypatch, sources, at_once):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "TERMS_AT_ONCE", at_once)
    monkeypatch.setattr(divergence, "SHARD", at_once)
    rows = _documents(1, 150)
    rows += [(None, None, None), (None, "a", "one"), ("en", None, "house house"), ("fr", "s1", ""), ("fr", "s2", "once"), rows[0], rows[0]]
    rows += [("en", "long", "w" * 100_000 + " a b " * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, n int").repartition(4)
    got = Counter(tuple(r) for r in divergence.audit(df, terms=5, least=3).collect())
    assert got == _audit(rows, 5, 3)


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(df).collect() == []


def test_radix_order_is_stable():
    draw = np.random.default_rng(2)
    a, b = draw.integers(0, 5, 3000).astype(np.uint64) << np.uint64(50), draw.integers(0, 70_000, 3000).astype(np.uint64)
    assert (divergence.radix_order(a, b) == np.lexsort((b, a))).all()
    assert len(divergence.radix_order(a[:0])) == 0


# --- top-k search ---------------------------------------------------------------------


def _search(rows: list[tuple], k: int, every: int) -> Counter:
    whole = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = Counter()
    for i, q in {(i, tuple(v)) for i, v in whole if i is not None and i % every == 0}:
        found = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for j, v in whole if j != i and len(v) == len(q)]
        out.update((i, rank + 1, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(found)[:k]))
    return out


@pytest.mark.parametrize("queries, shard, pivots", [(16_384, 65_536, 256), (8, 40, 12), (3, 1000, 1)])
def test_top_products(spark, monkeypatch, queries, shard, pivots):
    monkeypatch.setattr(voronoi, "QUERIES", queries)
    monkeypatch.setattr(voronoi, "SHARD", shard)
    monkeypatch.setattr(voronoi, "PIVOTS", pivots)
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(6, 8))
    x = (centres[draw.integers(0, 6, 400)] + draw.normal(scale=0.1, size=(400, 8))) * draw.choice([1.0, 1.0, 3.0], (400, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, [0.25] * 8) for i in range(60)]  # ties
    rows += [(2000, None), (2005, [0.1] * 7 + [None]), (2010, [float("nan")] * 8), (2015, [float("inf")] * 8), (2020, []), (2025, [])]
    rows += [(3000, [1.0, 2.0]), (3001, [4.0, 2.0]), (None, x[0].tolist()), (None, [9.0] * 8), rows[5], rows[5], rows[6], (5, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    got = Counter(tuple(r) for r in voronoi.top_products(df, k=5, every=5).collect())
    assert got == _search(rows, 5, 5)


def test_large_components_stay_exact():
    a, b = np.full((1, 3), 2.0**23 + 1), np.full((1, 3), 2.0**24 - 1)
    assert voronoi.products(a, b)[0, 0] == 3 * (2**23 + 1) * (2**24 - 1)


def test_only_needed_rows_go_to_a_cell():
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(300, 5, (50, 16)), draw.normal(-300, 5, (200, 16))])
    pivot = x[:50].mean(0)
    reach = np.sqrt(((x[:50] - pivot) ** 2).sum(1)).max()
    least = np.sort(x[:50] @ x[:50].T, 1)[:, -6].min()
    needed = voronoi._needed(x, np.sqrt((x * x).sum(1)), voronoi.Cell(pivot, reach, least, 0, 1))
    assert not needed[50:].any()
    best = (x[:50] @ x.T).argsort(1)[:, -5:]
    assert needed[best].all()


def test_search_in_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert voronoi.top_products(df).collect() == []
