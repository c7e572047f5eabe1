"""Decontamination, extraction, licences, languages, toxicity, and the pipeline."""

from __future__ import annotations

import ctypes
import random
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings, strategies as st
from llm import brute
from pyspark.sql import functions as F

import corpus_pipeline
from stallwise.llm import common, decontaminate, language, licences, toxicity
from stallwise.llm.common import cut
from stallwise.llm.extraction import extract_text, main_text
from stallwise.llm.queries import QUERIES

SMALL, MIDDLE = f"{DATA}/sf0.001", f"{DATA}/sf0.01"


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- memory of the workers --------------------------------------------------------------


def _resident() -> int:
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * 4096


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc alone keeps what is freed")
def test_a_worker_gives_back_what_a_task_has_freed():
    """200 MB in small blocks, a few of which stay in use: the rest is the system's again."""
    stays = []

    def wasteful(batches):
        for batch in batches:
            blocks = [bytearray(2000) for _ in range(100_000)]
            stays.extend(blocks[::1000])
            yield batch

    before = _resident()
    assert list(common.given_back(wasteful)(iter([1]))) == [1]
    assert _resident() - before < 50 << 20 and len(stays) == 100


# --- decontamination ------------------------------------------------------------------


def _plain(text: str) -> bytes:
    return re.sub(rb"[ \t-\r]+", b" ", text.encode()).strip().lower()


def _leaky(seed: int):
    draw = random.Random(seed)
    letters = "abcdefghij  "
    text = lambda n: "".join(draw.choice(letters) for _ in range(n)).strip() or "a"
    items = [(i, text(draw.randrange(40, 160))) for i in range(12)] + [(20, "Tiny One"), (21, None), (22, "  ")]
    docs = []
    for i in range(60):
        held = list(draw.choice(items[:12])[1])
        for _ in range(draw.randrange(0, 14)):
            at = draw.randrange(len(held))
            held[at : at + draw.randrange(2)] = draw.choice(letters) * draw.randrange(2)
        docs.append((i, text(100) + " " + "".join(held).upper() + "\n" + text(80)))
    return docs + [(100, None), (101, ""), (102, "a tiny\none b"), (103, "tiny ones")], items


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_leaks_match_edit_distance(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items = _leaky(4)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("leaks", F.lit("clash")).repartition(3)
    found = decontaminate.with_leaks(df, spark.createDataFrame(items, "item_id long, text string"), 0.06)
    assert sorted(found.columns) == ["doc_id", "leaks", "text"]
    held = {r.doc_id: {x.item_id: x for x in r.leaks} for r in found.collect()}
    for doc, text in docs:
        expected = set()
        for ident, item in items:
            if item and item.strip() and text:
                own = _plain(item)
                if len(own) < decontaminate.Q:
                    hit = re.search(rb"(?<!\S)" + own + rb"(?!\S)", _plain(text)) is not None
                else:
                    budget = min(int(len(own) * 0.06), len(own) // decontaminate.Q - 1)
                    hit = brute.distance_within(own, _plain(text)) <= budget
                if hit:
                    expected.add(ident)
        assert set(held[doc]) == expected, doc
        for ident, leak in held[doc].items():
            part = text.encode()[leak.start : leak.after].decode()
            assert leak.edits or _plain(part) == _plain(dict(items)[ident])


@pytest.mark.parametrize(("parts", "block"), [(1, 2_000_000), (3, 2_000_000), (3, 20)])
def test_leaks_at_the_ends_of_texts(spark, monkeypatch, parts, block):
    """What stands before or behind a text in its batch has no say, nor has the number of partitions."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows = [(1, "the answer is forty two"), (2, "forty two is it"), (3, "forty two"), (4, "tyforty two"), (5, "so forty"), (6, "two"), (7, None), (8, "")]
    rows += [(1, "the answer is forty two"), (9, "word " * 40_000 + "forty two")]
    long = "a longer question with an answer at its end"
    rows += [(10, long), (11, "x" + long[:-1]), (12, long + " yes"), (13, "no " + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartitionByRange(parts, "doc_id")
    items = spark.createDataFrame([(1, "Forty  two"), (2, long)], "item_id long, text string")
    found = sorted((r.doc_id, [(x.item_id, x.edits) for x in r.leaks]) for r in decontaminate.with_leaks(docs, items).collect())
    short, whole = [(1, 0)], [(2, 0)]
    told = {1: short, 2: short, 3: short, 9: short, 10: whole, 11: [(2, 1)], 12: whole, 13: whole}
    assert found == sorted((d, told.get(d, [])) for d, _ in rows)


def test_every_planted_item_is_found(spark):
    docs = [tuple(r) for r in _table(spark, MIDDLE, "documents").select("doc_id", "text").collect()]
    items = [(r[0], _plain(r[1])) for r in _table(spark, MIDDLE, "benchmark").collect()]
    found = {r.doc_id: r for r in QUERIES["op2_decontamination"](spark, MIDDLE).collect()}
    for doc, text in docs:
        own = _plain(text or "")
        exact = {i for i, t in items if t in own}
        assert exact <= set(found[doc].item_ids) and found[doc].kept == (not found[doc].item_ids)


def test_a_large_benchmark_gives_the_same_leaks(spark, monkeypatch):
    docs = _table(spark, MIDDLE, "documents").select("doc_id", "text")
    more = [(-1, "of the"), (-2, "The"), (-2, "The"), (-3, None), (-4, " \t "), (None, "the  OF")]
    items = _table(spark, MIDDLE, "benchmark").select("item_id", "text").union(spark.createDataFrame(more, "item_id long, text string"))
    odd = [(None, None), (None, ""), (7, "a the of the"), (7, "a the of the")]
    docs = docs.union(docs.limit(5)).union(spark.createDataFrame(odd, "doc_id long, text string"))
    told = lambda df: sorted(map(repr, df.collect()))
    whole = told(decontaminate.with_leaks(docs, items))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)  # documents with several groups of items
    dealt = decontaminate.with_leaks(docs, items)
    assert told(dealt) == whole and any("item_id=-2" in x for x in whole)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan  # searched and stored already, however many items there are
    monkeypatch.setattr(decontaminate, "SIEVE", 15)  # a small bitmap lets more hashes pass, which the join drops
    assert told(decontaminate.with_leaks(docs, items)) == whole
    assert decontaminate.with_leaks(docs.limit(0), items).isEmpty()


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=12, max_size=200), st.lists(st.tuples(st.integers(0, 199), st.sampled_from(["", "x", "xy"])), max_size=12))
def test_an_anchor_outlives_the_edits(text, changes):
    """However an item is edited within its budget, one of its anchors stays."""
    item = decontaminate.plain(text)
    if len(item) >= decontaminate.Q:
        budget = int(decontaminate.budgets(np.array([len(item)]), 0.06)[0])
        held = item.decode()
        for at, put in changes[:budget]:
            at %= len(held) + 1
            held = held[:at] + put[:1] + held[at + (put != "xy") :]  # one letter goes, changes or is put in
        grams = decontaminate.grams(np.frombuffer(held.encode(), np.uint8))
        assert np.isin(decontaminate.anchors_of(item, 0.06), grams).any()


def test_no_benchmark_no_leaks(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(docs, none).count() == 1
    assert decontaminate.with_leaks(docs.limit(0), none).isEmpty()


# --- extraction -----------------------------------------------------------------------


def test_the_article_is_found():
    page = """<html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use, well, cookies</div>
    <main><article><h1>The title</h1><p>First, a <b>bol</b>d &amp;amp; long paragraph,\n with commas, and more.<br>Next line
    <p>Unclosed one &lt;b&gt; &eacute;&#33;<ul><li>Item</ul><form><p>Your name, please</p></form>
    <aside>Aside, aside, aside</aside><div id="comments"><p>Great, great, great, great, great</p></div></article></main>
    <div class="ad">Buy, buy, buy now</div><footer>&copy; 2020, all, rights</footer></body></html>"""
    assert main_text(page) == "The title First, a bold &amp; long paragraph, with commas, and more. Next line Unclosed one <b> é! Item"


def test_odd_pages():
    assert main_text("") == "" and main_text("<p") == "" and main_text("<!-- x") == ""
    assert main_text("just text") == "just text"
    assert main_text("<p>a < b &lt; c") == "a < b < c"
    assert main_text("<article><p>cut of") == "cut of" and main_text("<article><p>cut of</p") == "cut of"
    assert main_text("<div><p>" * 2000 + "deep, very deep") == "deep, very deep"
    assert main_text("<p>" + "long, " * 200_000).count("long,") == 200_000
    assert main_text("<nav>only a menu</nav>") == ""


def test_a_name_among_others_is_only_a_hint():
    lead = "A lead that says, in one sentence, what the whole article is about."
    body = "<p>A paragraph of the article, with commas, and with words enough to score.</p>" * 3
    text = "A section about social history, which is a part of the article, and stays."
    page = f"""<article><div class="article-header"><h1>Title</h1><p>{lead}</p></div>{body}<div class="social-history"><p>{text}</p></div>
      <div class="related-reading"><a href="x">One more story that is worth the time, and another</a></div>
      <div class="newsletter-teaser"><p>Subscribe, and get the news, all of it, every day of the week, for ever.</p></div>
      <div id="comment-list"><p>I disagree, strongly, with all of this, from the first word to the last.</p></div></article>"""
    assert main_text(page) == " ".join(["Title", lead, *["A paragraph of the article, with commas, and with words enough to score."] * 3, text])


def test_all_pages_match_their_articles(spark):
    pages = {r.page_id: r for r in _table(spark, MIDDLE, "pages").collect()}
    done = QUERIES["op6_html_extraction"](spark, MIDDLE)
    assert done.columns == ["page_id", "url", "text", "n_chars"]
    for r in done.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id].html, re.S)[1]
        plain = re.sub(r"</?b>", "", inner)
        plain = re.sub(r"<[a-z/!][^>]*(>|\Z)", " ", plain)
        assert r.text == " ".join(unescape(plain).split()) and r.n_chars == len(r.text)


def test_null_pages_and_clashing_columns(spark):
    rows = [(1, None, "t"), (2, "", "t"), (3, "<p>Some, text</p>", "t"), (3, "<p>Some, text</p>", "t")]
    done = extract_text(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert sorted(tuple(r) for r in done.collect()) == [(1, "", 0), (2, "", 0), (3, "Some, text", 10), (3, "Some, text", 10)]
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).isEmpty()


# --- licences -------------------------------------------------------------------------


def test_notices_of_the_corpus(spark):
    known = {
        "gpl": "licensed under the GNU General Public License", "mit": "Released under the MIT License",
        "cc-by-nc": "Licensed under CC BY-NC", "apache": "Licensed under the Apache License",
    }
    text = {r.doc_id: r.text or "" for r in _table(spark, MIDDLE, "documents").collect()}
    found = {r.doc_id: r for r in QUERIES["op8_licence_scan"](spark, MIDDLE).collect()}
    assert len(found) == len(text) and any(r.families for r in found.values())
    for doc, own in text.items():
        held = [f for f, words in sorted(known.items()) if re.search(r"\s+".join(words.split()), own, re.I)]
        assert found[doc].families == held


def test_unknown_licences_and_odd_texts(spark):
    model = licences.train(["the house is on the hill", "a word of the wise and the old"])
    filler = " ".join(f"word{i}" for i in range(130))
    texts = {
        1: "Licensed under the Foo License, version 2.", 2: "the license plate of my car", 3: None, 4: "",
        5: f"{filler} Released under the BSD 3-Clause License. {filler}", 6: "x\nLICENSED UNDER\tCC BY-SA 4.0.\ny", 7: "SPDX-License-Identifier: MPL-2.0",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: [(x.family, x.version) for x in r.licences] for r in licences.with_licences(df, model).collect()}
    assert found == {1: [], 2: [], 3: [], 4: [], 5: [("bsd", "3")], 6: [("cc-by-sa", "4.0")], 7: [("mpl", "2.0")]}
    assert licences.with_licences(df.limit(0), licences.learn(df.limit(0))).isEmpty()


def test_wrapped_and_dual_notices(spark):
    model = licences.train(["the house is on the hill", "a word of the wise and the old"])
    gpl = (
        "This program is free software: you can redistribute it and/or modify\n{0}it under the terms of the GNU General Public License as published by\n"
        "{0}the Free Software Foundation, either version 3 of the License, or\n{0}(at your option) any later version."
    )
    lgpl = (
        "This library is free software; you can redistribute it and/or\n{0}modify it under the terms of the GNU Lesser General Public\n"
        "{0}License as published by the Free Software Foundation; either\n{0}version 2.1 of the License, or (at your option) any later version."
    )
    bsd = (
        "Copyright (c) 2019, Somebody\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met:"
    )
    pointer = "Use of this source code is governed by a\n// BSD-style license that can be\n// found in the LICENSE file."
    texts = {
        1: gpl.format(" * "), 2: lgpl.format("# "), 3: bsd, 4: pointer, 5: gpl.format("dnl "),
        6: "SPDX-License-Identifier: MIT OR Apache-2.0",
        7: "Licensed under the Apache License, Version 2.0 and released under the MIT License.",
        8: "Released under the MIT License.\nReleased under the MIT License.",
        9: "Licensed under the Mozilla Public License, version 2.0.\nnothing else", 10: "Licensed under\nCC BY-SA 4.0.",
        11: "the house\n\nReleased under the\n\nhill and MIT License",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: [(x.family, x.version) for x in r.licences] for r in licences.with_licences(df, model).collect()}
    assert found == {
        1: [("gpl", "3")], 2: [("lgpl", "2.1")], 3: [("bsd", None)], 4: [("bsd", None)], 5: [("gpl", "3")],
        6: [("apache", "2.0"), ("mit", None)], 7: [("apache", "2.0"), ("mit", None)], 8: [("mit", None)] * 2,
        9: [("mpl", "2.0")], 10: [("cc-by-sa", "4.0")], 11: [],
    }


def test_examples_without_a_licence_are_from_all_lines(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(licences, "train", lambda unlicensed, **_: seen.append(unlicensed))
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(i, "\n\n".join(f"{c}{i} line" for c in "abcxyzшя") + (f"\n\n{long}" if i == 0 else "")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    licences.learn(docs, lines=60)
    licences.learn(docs)
    few, whole = seen
    assert len(few) == 60 and {x[0] for x in few} >= set("abcxyzшя")
    assert len(whole) == 8 * 30 + 4 and any(x.endswith("w199") for x in whole)  # four windows of the long line


# --- language -------------------------------------------------------------------------


def test_gradients_match_differences():
    draw = np.random.default_rng(1)
    net = language.fresh(["a", "b", "c"])
    letters = draw.integers(97, 123, (7, 5)).astype(np.uint8)
    label = draw.integers(0, 3, 5)
    loss, grads = language.gradients(net, letters, label)
    for param, grad in zip(net.arrays(), grads):
        for _ in range(4):
            at = tuple(draw.integers(0, n) for n in param.shape)
            if param is net.byte[0] or param is net.byte[1]:
                at = (int(letters.flat[0]), at[1])
            old, step = param[at], 1e-2
            param[at] = old + step
            up = language.gradients(net, letters, label)[0]
            param[at] = old - step
            down = language.gradients(net, letters, label)[0]
            param[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in _table(spark, MIDDLE, "documents").collect()}
    found = {r.doc_id: r for r in QUERIES["op9_language_id"](spark, MIDDLE).collect()}
    assert set(found) == set(docs)
    held = [d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(found[d].held_out == (d in set(held)) for d in docs)
    assert np.mean([found[d].lang_pred == docs[d].lang for d in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_texts_without_letters_and_spans_of_any_length(spark):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "a"), (5, "the and of " * 40_000), (None, "the cat"), (4, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p", F.lit("clash"))
    net = language.train([(b"the and of with this cat " * 9, "en"), (b"der die das und ist mit " * 9, "de")], rounds=30)
    found = language.identify(df, net).collect()
    assert len(found) == 7
    assert {(r.doc_id, r.lang_pred, r.score) for r in found if r.doc_id in (1, 2, 3)} == {(i, "und", 0.0) for i in (1, 2, 3)}
    assert {r.lang_pred for r in found if r.doc_id in (4, 5, None)} <= {"en", "de"}
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}
    empty = df.limit(0).withColumn("lang", F.lit(None).cast("string"))
    assert language.learn(empty, F.lit(True)) is None


def test_every_language_is_learnt(spark, monkeypatch):
    """Seventy languages, each with words and documents of its own; the rarest have fewest documents."""
    monkeypatch.setattr(language, "SCORES", 700)
    draw = random.Random(2)
    names = [f"l{i:02}" for i in range(70)]
    words = {n: ["".join(chr(0x400 + 3 * i + draw.randrange(3)) for _ in range(5)) for _ in range(6)] for i, n in enumerate(names)}
    text = lambda n: " ".join(draw.choice(words[n]) for _ in range(60))
    rows = [(100 * i + j, text(n), n) for i, n in enumerate(names) for j in range(2 if i < 6 else 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.learn(docs, F.lit(True))
    assert net.languages == names
    fresh = spark.createDataFrame([(i, text(n)) for i, n in enumerate(names)], "doc_id long, text string").coalesce(1)
    told = {r.doc_id: r.lang_pred for r in language.identify(fresh, net).collect()}
    assert np.mean([told[i] == n for i, n in enumerate(names)]) >= 0.9
    assert np.mean([told[i] == names[i] for i in range(6)]) >= 0.8
    assert language.units(4) == language.HIDDEN < language.units(70)


def test_no_language_is_left_out_of_the_batches(monkeypatch):
    seen = set()
    monkeypatch.setattr(language, "gradients", lambda net, letters, label: (seen.update(label.tolist()), [np.zeros_like(p) for p in net.arrays()]))
    language.train([(b"some text", f"l{i}") for i in range(300)], rounds=2)
    assert seen == set(range(300))


def test_a_long_text_is_the_mean_of_its_spans():
    net = language.train([(b"the and of with this cat " * 9, "en"), (b"der die das und ist mit " * 9, "de")], rounds=20)
    first, second = b"the and of" * 30, b"der die das und" * 50
    first, second = first[: 96 * 3], second[: 96 * 5]
    apart = language.pooled(net, np.frombuffer(first + second, np.uint8), np.array([0, len(first), len(first + second)]))
    whole = language.pooled(net, np.frombuffer(first + second, np.uint8), np.array([0, len(first + second)]))
    weight = np.array([language._LETTER[np.frombuffer(x, np.uint8)].sum() for x in (first, second)])
    assert np.allclose(whole[0], (apart * weight[:, None]).sum(0) / weight.sum(), atol=1e-5)


# --- toxicity -------------------------------------------------------------------------


def test_severity_rises_with_insults(spark):
    draw = random.Random(6)
    good = [f"word{i}" for i in range(200)]
    bad = ["idiot", "scum", "moron", "trash"]
    rows, labels = [], []
    for i in range(600):
        text = [draw.choice(good) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(draw.randrange(1, 9)):
                text.insert(draw.randrange(len(text)), draw.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000, "IDIOT! word1"), (1001, "idiot scum moron trash idiot scum moron trash"), (1002, None), (1003, ""), (1004, "word1 word2")]
    labels += [(None, 1), (3, None), (7, 5), (2000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("severity", F.lit("clash")).repartition(3)
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (np.diff(model.cut) > 0).all()
    told = {r.doc_id: r for r in toxicity.with_severity(docs, model).collect()}
    assert told[1000].p_toxic > 0.5 and told[1001].severity > told[1000].severity > told[1004].severity
    assert all(told[i].p_toxic < 0.5 for i in (1002, 1003, 1004))
    assert all((told[i].p_toxic >= 0.5) == (i % 5 == 0) for i in range(600))


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "idiot"), (1, "idiot"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels) is None
    assert toxicity.without_toxic(docs, labels).count() == 3
    assert toxicity.without_toxic(docs.limit(0), labels.limit(0)).isEmpty()


def test_gradient_of_the_cumulative_links():
    """The fit must beat the grades' own frequencies."""
    draw = np.random.default_rng(8)
    toxic = (draw.random(400) < 0.3).astype(int)
    row = np.repeat(np.arange(400), 3)
    slot = draw.integers(100, 160, 1200)
    slot[::3] = np.where(toxic == 1, 7, 9)
    model = toxicity.fit(row, slot, np.ones(1200), toxic)
    score = np.bincount(row, weights=model.weight[slot], minlength=400)
    assert ((score > model.cut[0]) == (toxic == 1)).all()


# --- the pipeline ---------------------------------------------------------------------


def test_stages_against_brute_force(spark):
    docs = _table(spark, MIDDLE, "documents").filter("doc_id < 400")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in _table(spark, MIDDLE, "labels").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]

    kept = cut(stages["toxicity"](spark, docs, MIDDLE))
    left = {r.doc_id for r in kept.collect()}
    known = [d for d in (r.doc_id for r in docs.select("doc_id").collect()) if d in labels]
    assert kept.columns == columns
    assert np.mean([(d in left) == (labels[d] == 0) for d in known]) >= 0.9
    rude = re.compile(r"\b(idiot|moron|scum|worthless|pathetic)\b", re.I)
    assert not any(rude.search(r.text or "") for r in kept.collect())

    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    sets = [brute.shingles(t, 5) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    group = brute.groups(len(rows), links)
    single = cut(stages["minhash_near_dedup"](spark, kept, MIDDLE))
    assert {r.doc_id for r in single.collect()} == {rows[i][0] for i in range(len(rows)) if group[i] == i}

    before = [(r.doc_id, r.text) for r in single.collect()]
    gone = brute.repeated(before, 50)
    trimmed = cut(stages["suffix_array_dedup"](spark, single, MIDDLE))
    for r in trimmed.collect():
        own = [w for w, g in zip(brute.words(dict(before)[r.doc_id]), gone[r.doc_id]) if not g]
        assert brute.words(r.text) == own and r.n_chars == len(r.text)

    items = [_plain(r.text) for r in _table(spark, MIDDLE, "benchmark").collect()]
    clean = cut(stages["benchmark_decontamination"](spark, trimmed, MIDDLE))
    expected = {r.doc_id for r in trimmed.collect() if not any(i in _plain(r.text) for i in items)}
    assert {r.doc_id for r in clean.collect()} == expected
    assert single.columns == trimmed.columns == clean.columns == columns
    packed = stages["packing"](spark, clean, MIDDLE).collect()
    assert {r.doc_id for r in packed} == expected


def test_the_pipeline_runs_whole(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    pieces = corpus_pipeline.run(spark, SMALL)
    assert pieces.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(pieces.columns)


def test_odd_rows_through_the_pipeline(spark, tmp_path):
    """NULL and repeated ids, NULL, empty and very long texts; and tables without any row."""
    draw = random.Random(6)
    words = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    long, copy = words(30_000), words(80)
    texts = [long, copy, copy, words(200), "", None, " ", "one", words(60) + " " + copy, words(5)]
    rows = [(None if i % 3 == 0 else i, t, None if i % 4 else "en", "s" if i % 2 else None, None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[4]]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    labels = [(i, 1, 0) for i in range(10)]  # nothing toxic to learn from
    for name, docs in (("odd", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "nothing holds this item, it is not in any text")] if docs else [], "item_id long, text string").write.parquet(
            f"{folder}/benchmark.parquet"
        )
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            kept = cut(function(spark, kept, folder), stage)
            assert kept.columns == [f.split()[0] for f in schema.split(", ")]
        texts_left = Counter(r.text for r in kept.collect())
        if docs:
            # one of the copies is left, its passage is cut elsewhere, and nothing else goes
            assert texts_left[long] == 1 and texts_left[copy] == 1 and sum(t is not None and copy in t for t in texts_left) == 1
            assert sum(texts_left.values()) >= len(rows) - 3
        pieces = corpus_pipeline.run(spark, folder).collect()
        assert bool(pieces) == bool(docs)
        assert len({r.doc_id for r in pieces}) == len({r.doc_id for r in kept.collect()})
