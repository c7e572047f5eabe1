"""Licence notices by a trained paragraph classifier with template confirmation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stallwise.llm.common import Prefix, U64, Words, column, mapped, mix, slices, text_buffer
# How well-known licences name themselves in notices.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."],
}
# How a family is named, in words as ``plain`` gives them; a window may tell several families only by these.
NAMES = {
    "apache": ["apache"],
    "mit": ["mit", "permission is hereby granted free of charge"],
    "gpl": ["gnu general", "gpl"],
    "lgpl": ["lesser general", "library general", "lgpl"],
    "agpl": ["affero general", "agpl"],
    "bsd": ["bsd", "redistribution and use in source"],
    "mpl": ["mozilla public", "mpl"],
    "cc-by": ["cc by 0", "attribution 0"],
    "cc-by-sa": ["cc by sa", "attribution sharealike"],
    "cc-by-nc": ["cc by nc", "attribution noncommercial"],
    "cc0": ["cc0", "waived all copyright"],
    "unlicense": ["free and unencumbered"],
    "proprietary": ["all rights reserved"],
}
SLOTS = 1 << 18
STEP = 40  # words; a window is two steps, and each step but the first begins one
SAMPLE = 400  # documents that give paragraphs without a licence, at most
LINES = 4000  # windows of those documents that are learnt from, at most
FILLER = 50_000  # words of them to put around notices, at most
CONFIRMED = 0.6  # share of a template's word pairs that a window must hold
_OTHER = np.ones(256, bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def plain(text: str) -> list[bytes]:
    """Words as the classifier sees them: lower case, every number one ``0``."""
    return [b"0" if w.isdigit() else w for w in _TOKEN.findall(text.encode().lower())]


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word and of each pair of a word and the next."""
    one = words.hashes()
    digit = np.concatenate([[0], np.cumsum((words.data < 48) | (words.data > 57))])
    number = digit[words.end] == digit[words.start]
    one[number] = U64(0x0123456789ABCDEF)
    place = np.arange(max(len(one) - 1, 0))
    two = Prefix(one).run(place, place + 2)
    return (mix(one) % U64(SLOTS)).astype(np.int64), (mix(two) % U64(SLOTS)).astype(np.int64)


def windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and after-last words of the windows, and which are of joined lines.

    A window is a line or a paragraph of lines up to one without a word; long ones come in overlapping
    parts. Lines stand before paragraphs; a paragraph of one line is that line alone. Signs that
    begin a line of comment (``#``, ``//``, ``*``) are no words, so a line of them alone ends a paragraph.
    """
    if not words.n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    lines = np.concatenate([[0], np.cumsum(words.data == 10)])[words.start]
    owner = words.owner()
    parts = []
    for most in (0, 1):
        new = np.ones(words.n, bool)
        new[1:] = (owner[1:] != owner[:-1]) | (lines[1:] - lines[:-1] > most)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], words.n)
        if most:
            several = lines[begin] != lines[end - 1]
            begin, end = begin[several], end[several]
        count = np.maximum(1, -(-(end - begin) // STEP) - 1)
        number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first = np.repeat(begin, count) + number * STEP
        parts.append((first, np.minimum(first + 2 * STEP, np.repeat(end, count)), np.full(len(first), bool(most))))
    return tuple(np.concatenate(x) for x in zip(*parts))


@dataclass
class Model:
    families: list[str]  # the last class, beyond them, is unknown
    known: np.ndarray  # slots that have weights
    weight: np.ndarray  # (len(known) + 2, classes): then the log of other words, and the bias
    pairs: dict[str, list[frozenset]]

    def __post_init__(self) -> None:
        self.place = np.full(SLOTS, -1, np.int32)
        self.place[self.known] = np.arange(len(self.known))


def rows_of(words: Words, first: np.ndarray, after: np.ndarray, place: np.ndarray):
    """(window, feature) of the distinct known grams of windows, and the log of their other words."""
    one, two = _grams(words)
    size = after - first
    inner = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    window = np.repeat(np.arange(len(first)), size)
    a = place[one[inner]]
    paired = inner + 1 < np.repeat(after, size)
    b = np.where(paired, place[two[np.minimum(inner, max(len(two) - 1, 0))]] if len(two) else -1, -1)
    other = np.bincount(window[a < 0], minlength=len(first))
    keys = np.concatenate([window[a >= 0] * (SLOTS + 1) + a[a >= 0], window[b >= 0] * (SLOTS + 1) + b[b >= 0]])
    keys = np.unique(keys)
    pairs = np.bincount(window[b >= 0], minlength=len(first))
    return keys // (SLOTS + 1), keys % (SLOTS + 1), np.log1p(other), pairs


def probabilities(weight: np.ndarray, row: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    score = np.zeros((len(other), weight.shape[1]))
    np.add.at(score, row, weight[at])
    score += other[:, None] * weight[-2] + weight[-1]
    score -= score.max(1, keepdims=True)
    np.exp(score, out=score)
    return score / score.sum(1, keepdims=True)


def _words(texts: list[str]) -> Words:
    data = [t.replace("\n", " ").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(data), np.uint8), offsets, lower=True, separator=_OTHER)


def train(unlicensed: list[str], seed: int = 3, rounds: int = 250, filler_words: int = FILLER) -> Model:
    """Fit on varied templates against paragraphs of the corpus and notices of licences that do not exist.

    A fifth of the examples is held out to calibrate: one temperature divides the scores so that the
    held-out likelihood is best, unknown class included. Notices get words around them from the first
    ``filler_words`` words of ``unlicensed``.
    """
    draw = np.random.default_rng(seed)
    families = list(TEMPLATES)
    filler = [w for t in unlicensed for w in t.split()][:filler_words] or ["text"]
    texts, label = [], []
    for k, name in enumerate(families):
        for template in TEMPLATES[name]:
            words = template.split()
            for copy in range(24):
                kept = [w for w in words if copy < 4 or draw.random() > 0.06] or words
                before, after = (draw.integers(0, 40, 2) if copy % 3 == 2 else (0, 0))
                at = int(draw.integers(0, len(filler)))
                around = filler[at : at + before], filler[at + before : at + before + after]
                texts.append(" ".join([*around[0], *kept, *around[1]]))
                label.append(k)
                if copy < 8:  # the same phrase without the words that name the family
                    blank = [w for w in words if w.lower() in _GENERAL]
                    noise = [filler[int(draw.integers(len(filler)))] for _ in range(int(draw.integers(1, 12)))]
                    mixed = [*blank, *noise]
                    draw.shuffle(mixed)
                    texts.append(" ".join(mixed))
                    label.append(len(families))
    texts += unlicensed
    label = np.array(label + [len(families)] * len(unlicensed))
    words = _words(texts)
    first, after = words.first[:-1], words.first[1:]
    templates = _words([t for some in TEMPLATES.values() for t in some])
    one, two = _grams(templates)
    inside = np.ones(len(two), bool)
    inside[templates.first[1:-1] - 1] = False
    known = np.unique(np.concatenate([one, two[inside]]))
    model = Model(families, known, np.zeros((len(known) + 2, len(families) + 1)), {})
    row, at, other, _ = rows_of(words, first, after, model.place)
    held = draw.random(len(texts)) < 0.2
    classes = np.eye(len(families) + 1)[label]
    share = np.bincount(label[~held], minlength=len(families) + 1)
    balance = np.where(held, 0, (1 / np.maximum(share, 1))[label] / len(share))
    m, v = np.zeros_like(model.weight), np.zeros_like(model.weight)
    for step in range(1, rounds + 1):
        error = (probabilities(model.weight, row, at, other) - classes) * balance[:, None]
        grad = np.zeros_like(model.weight)
        np.add.at(grad, at, error[row])
        grad[-2], grad[-1] = (error * other[:, None]).sum(0), error.sum(0)
        grad += 1e-5 * model.weight
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        model.weight -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    losses = []
    heats = np.geomspace(0.25, 4, 33)
    for heat in heats:
        p = probabilities(model.weight / heat, row, at, other)[held, label[held]]
        losses.append(-np.log(p + 1e-12).mean())
    model.weight /= heats[int(np.argmin(losses))]
    for name in families:
        model.pairs[name] = [frozenset(zip(w, w[1:])) for w in map(plain, TEMPLATES[name])]
    return model


_GENERAL = frozenset(
    "licensed under the license released work is this of terms distributed version 2.0. 3. to and or a may not use file in "
    "source code permission".split()
)


def sampled(examples: set[str], most: int) -> list[str]:
    """At most ``most`` of the examples, those of smallest hash, in the order of their hashes."""
    return sorted(examples, key=lambda x: hashlib.md5(x.encode()).digest())[:most]


def learn(docs: DataFrame, text: str = "text", documents: int = SAMPLE, lines: int = LINES) -> Model:
    """Train with windows of at most ``documents`` documents as examples without a licence.

    The documents are chosen by hash and come to the driver, 20 kB of a text at most. Their lines and
    paragraphs are cut into the windows of the scanner, of which ``lines`` at most are learnt from,
    chosen by hash too. A sampled paragraph that holds a template's pairs is no such example. Without
    documents the made-up notices stand alone.
    """
    size = F.length(text)
    order = F.xxhash64(F.col(text), F.lit(8))
    part = F.substring(F.col(text), (F.pmod(order, F.greatest(size - 20_000, F.lit(1))) + 1).cast("int"), F.lit(20_000))
    filled = docs.filter(size > 0)
    # The hashes alone are sorted: of the texts only the chosen ones move.
    chosen = filled.select(order.alias("h")).distinct().orderBy("h").limit(documents)
    picked = filled.select(part.alias("part"), order.alias("h")).join(F.broadcast(chosen), "h")
    rows = picked.groupBy("h").agg(F.max("part").alias("part")).select("part")
    pairs = [frozenset(zip(w, w[1:])) for some in TEMPLATES.values() for w in map(plain, some)]
    examples: set[str] = set()
    for r in rows.toLocalIterator():
        for paragraph in re.split(r"\n[\W_]*\n", r[0]):
            own = plain(_LEADER.sub(b"\n", paragraph.encode().lower()).decode())
            parts = [own[at : at + 2 * STEP] for at in range(0, max(len(own) - STEP, 1), STEP)]
            if any(len(p.intersection(zip(x, x[1:]))) >= CONFIRMED * len(p) for x in parts for p in pairs):
                continue  # its lines may hold a part of the notice each
            for words in map(str.split, {paragraph, *paragraph.split("\n")}):
                examples.update(" ".join(words[at : at + 2 * STEP]) for at in range(0, max(len(words) - STEP, 1), STEP) if words)
    return train(sampled(examples, lines))


LICENCE = "array<struct<family:string,p:double,share:double,version:string,word:int>>"
_VERSION = re.compile(rb"(?<![\w.])v?(\d+(?:\.\d+)*)(?![\w])")
_REACH = 16  # words after a family's name in which its version stands
_AFTER_NAME = re.compile(rb"(?:[^0-9a-z\x80-\xff]*[0-9a-z.\x80-\xff]+){0,%d}" % _REACH)
_LEADER = re.compile(rb"\n[^\S\n]*(?:dnl|rem|c)(?=\s)")  # comment leaders that look like words
_NAMED = {
    family: re.compile(
        rb"(?<![0-9a-z\x80-\xff])(?:%s)(?![0-9a-z\x80-\xff])"
        % b"|".join(rb"[^0-9a-z\x80-\xff]+".join(rb"[0-9]+" if w == "0" else w.encode() for w in n.split()) for n in names)
    )
    for family, names in NAMES.items()
}


def _version(raw: bytes, family: str, named: dict[str, re.Match], joined: bool) -> str | None:
    """The number that follows the family's name, before the next name; in a line without a name, the first number."""
    if family in named:
        begin = named[family].start()
        others = [m.start() for m in named.values() if m.start() > begin]
        reach = _AFTER_NAME.match(raw, named[family].end()).end()
        # The name may hold the number itself.
        hit = _VERSION.search(raw[begin : min([reach, *others])])
        if hit:
            return hit[1].decode()
    hit = None if joined or len(named) > 1 else _VERSION.search(raw)
    return hit[1].decode() if hit else None


def _without(words: Words, a: int, b: int, lines: list[tuple[int, int]]) -> list[list[bytes]]:
    """The words of a window in the stretches that the lines leave."""
    rest, at = [], a
    for start, end in [*sorted(lines), (b, b)]:
        if start > at:
            raw = _LEADER.sub(b"\n", words.data[words.start[at] : words.end[start - 1]].tobytes())
            rest.append([b"0" if w.isdigit() else w for w in _TOKEN.findall(raw)])
        at = max(at, end)
    return rest


def _scanner(model: Model, names: list[str], text: str):
    unknown = len(model.families)
    kind = pa.list_(pa.struct([("family", pa.string()), ("p", pa.float64()), ("share", pa.float64()), ("version", pa.string()), ("word", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            words = Words(*text_buffer(column(part, text)), lower=True, separator=_OTHER)
            first, after, joined = windows(words)
            row, at, other, pairs = rows_of(words, first, after, model.place)
            p = probabilities(model.weight, row, at, other)
            best = p.argmax(1)
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            last: dict[tuple[int, str, bool], dict] = {}
            told: dict[tuple[int, str], list[tuple[int, int]]] = {}  # words of the lines that tell a family
            owner = words.owner()
            for i in np.flatnonzero((best != unknown) & (pairs > 0)).tolist():
                a, b = int(first[i]), int(after[i])
                doc = int(owner[a])
                raw = _LEADER.sub(b"\n", words.data[words.start[a] : words.end[b - 1]].tobytes())
                named = {f: m for f, m in ((f, r.search(raw)) for f, r in _NAMED.items()) if m}
                own = [b"0" if w.isdigit() else w for w in _TOKEN.findall(raw)]
                whole = set(zip(own, own[1:]))
                shares = {f: max(len(whole & t) / max(len(t), 1) for t in model.pairs[f]) for f in [*named, model.families[best[i]]]}
                passed = [f for f in named if shares[f] >= CONFIRMED] or [model.families[best[i]]]
                for family in passed:
                    k, share = model.families.index(family), shares[family]
                    lines = [x for x in told.get((doc, family), []) if x[0] < b and a < x[1]] if joined[i] else []
                    if lines:  # what a line has told already is no second notice
                        rest = _without(words, a, b, lines)
                        held = {x for some in rest for x in zip(some, some[1:])}
                        share = max(len(held & t) / max(len(t), 1) for t in model.pairs[family])
                    if share < CONFIRMED:
                        continue
                    if not joined[i]:
                        told.setdefault((doc, family), []).append((a, b))
                    version = _version(raw, family, named, bool(joined[i]))
                    one = {"family": family, "p": float(p[i, k]), "share": share, "version": version, "word": a - int(words.first[doc])}
                    key = (doc, family, bool(joined[i]))
                    if key in last and one["word"] - last[key]["word"] == STEP:
                        if (share, one["p"]) > (last[key]["share"], last[key]["p"]):
                            last[key].update(one)  # overlapping windows of one notice
                    else:
                        found[doc].append(one)
                        last[key] = one
            for some in found:
                some.sort(key=lambda x: (x["word"], x["family"]))
            arrays = [pa.array(found, kind) if n == "licences" else column(part, n) for n in names]
            yield pa.record_batch(arrays, names)

    return scan


def with_licences(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` and ``licences``: per notice its family, probability, template share, version and first word.

    Every line and every paragraph of several lines of the whole text is classified, long ones in
    overlapping windows of 80 words. Where a family beats the unknown class, all families are told
    that the window names and of which it holds 60 % of the word pairs of a template; if there is none, the
    best family is if its pairs are held. What a line tells is not told again by its paragraph. NULL and empty texts have none (an empty list). Rows
    are scanned each for itself; an input column ``licences`` is replaced.
    """
    names = [c for c in docs.columns if c != "licences"]
    schema = docs.select(*names).withColumn("licences", F.expr(f"cast(array() as {LICENCE})")).schema
    return mapped(docs.select(*names), _scanner(model, [*names, "licences"], text), schema)
