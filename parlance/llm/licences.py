"""License scans: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, fresh


# Public licence notices, by family. Digits stand for any number.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0": (
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License, version 2.0.",
    ),
}
#: Sentences that use the notices' words and are none; the unknown class learns them beside the corpus's own text.
NOT_NOTICES = (
    "The driver renewed the license at the public office.",
    "The album was released under a new name this year.",
    "A general agreement on free software was published by the foundation.",
    "The work of the author is included in all copies of the book.",
    "Permission was granted by the court without conditions.",
    "The source of the river is in the public park.",
    "This version of the file is without errors.",
    "The terms of the contract are subject to change.",
    "She was licensed to teach in two states.",
    "Any person can use the software free of charge at the library.",
    "The university MIT published a general report under embargo.",
    "All rights and conditions of sale are listed in the document.",
)
#: Notices of licences that share most words with a family's and are none of it; the unknown class learns them too.
RIVALS = (
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Licensed under CC BY-NC-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "Licensed under the EUPL, Version 1.2.",
    "Licensed under the European Union Public License, version 1.2.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Released under the ISC License.",
    "Licensed under the Zlib license.",
)
#: What turns a notice into its opposite, before the verb.
NEGATIONS = ("not", "no longer", "never")


def negated(text: str) -> list[str]:
    """A notice's opposites, if it says that something is licensed or released."""
    verb = re.search("licensed under|released under|dedicated to", text.lower())
    return [f"{text[: verb.start()]}{n} {text[verb.start() :].lower()}" for n in NEGATIONS] if verb else []


FAMILIES = tuple(TEMPLATES)
UNKNOWN = len(FAMILIES)
_DROP = b".,;:!?\"'()[]{}#*$%&|<>=/"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")


@dataclass(frozen=True)
class Scan:
    """Bounds and limits. At most ``sample`` documents (those with the least id hashes) give the unknown class its text."""

    sample: int = 300
    variants: int = 24
    together: int = 150
    window: int = 48
    shared: int = 2
    probability: float = 0.5
    similarity: float = 0.6
    seed: int = 7


def words(text: str | bytes) -> list[bytes]:
    """Lower-cased words without punctuation; a number is 0."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return [b"0" if w.isdigit() else w for w in raw.lower().translate(_DIGITS, _DROP).split()]


def grams(ws: list[bytes], n: int) -> set:
    return set(zip(*[ws[i:] for i in range(n)], strict=False)) if len(ws) >= n else {tuple(ws)}


TEMPLATE_GRAMS = {f: [grams(words(t), 3) for t in ts] for f, ts in TEMPLATES.items()}
PAIRS = set().union(*[grams(words(t), 2) for ts in TEMPLATES.values() for t in ts])


def evidence(ws: list[bytes], family: str, taken: frozenset | set = frozenset()) -> tuple[float, list[int]]:
    """The largest share of a template's word triples that ``ws`` has at places not ``taken``, and the places."""
    own = list(enumerate(zip(ws, ws[1:], ws[2:], strict=False)))
    at = [[i for i, g in own if g in want and i not in taken] for want in TEMPLATE_GRAMS[family]]
    return max(((len({own[i][1] for i in k}) / len(g), k) for k, g in zip(at, TEMPLATE_GRAMS[family], strict=True)), key=lambda e: e[0])


def shared_pairs(ws: list[bytes]) -> int:
    """How many neighbouring words are neighbours in a template too."""
    return sum(map(PAIRS.__contains__, zip(ws, ws[1:], strict=False)))


def features(ws: list[bytes]) -> set:
    return {(w,) for w in ws} | (grams(ws, 2) if len(ws) > 1 else set())


#: A labelled row: words, class, and the template or line that it comes from.
Row = tuple[list[bytes], int, str]


class Classifier:
    """Softmax regression over word uni- and bigrams, with a temperature from templates that it hasn't seen.

    Each template, line and sentence is in one of two halves. A model fitted to
    one half gives scores for the other; the temperature is the best for all of
    these, and ``held_out`` the share of them that it gets right (a family's
    other template has few words in common with the first). The model that is
    kept is then fitted to all rows; of those with one notice at most it gets
    ``fitted`` right. Rows are sparse: places and one value.
    """

    def __init__(self, rows: list[Row], seed: int, halves: dict[str, int]) -> None:
        y = np.array([c for _, c, _ in rows])
        half = np.array([halves[of] for _, _, of in rows])
        scores = np.zeros((len(rows), UNKNOWN + 1), np.float32)
        for h in (0, 1):
            self._fit([r for r, k in zip(rows, half, strict=True) if k != h], y[half != h])
            other = [self.scores(r[0]) for r, k in zip(rows, half, strict=True) if k == h]
            scores[half == h] = np.array(other, np.float32).reshape(-1, UNKNOWN + 1)
        loss = lambda t: -np.log(np.maximum(self._soft(scores / t)[np.arange(len(rows)), y], 1e-9)).mean()
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0), key=loss)
        self.held_out = float((scores.argmax(1) == y).mean())
        self._fit(rows, y)
        self.fitted = float(np.mean([self.scores(ws).argmax() == c for ws, c, of in rows if not of.startswith("together")]))

    def _fit(self, rows: list[Row], y: np.ndarray) -> None:
        seen: dict = {}
        for ws, _, _ in rows:
            for f in features(ws):
                seen[f] = seen.get(f, 0) + 1
        self.place = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
        # the last place is every row's own, the bias
        held = [[*self._places(ws), len(self.place)] for ws, _, _ in rows]
        sizes = np.array([len(h) for h in held])
        at, row = np.concatenate([np.array(h) for h in held]), np.repeat(np.arange(len(rows)), sizes)
        value = np.where(at == len(self.place), 1.0, 1 / np.maximum(np.repeat(sizes - 1, sizes), 1) ** 0.5).astype(np.float32)[:, None]
        starts, by_place = np.cumsum(sizes) - sizes, np.argsort(at, kind="stable")
        places, first = np.unique(at[by_place], return_index=True)
        self.w = np.zeros((len(self.place) + 1, UNKNOWN + 1), np.float32)
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)
        goal = np.eye(UNKNOWN + 1, dtype=np.float32)[y]
        for t in range(1, 121):  # Adam over all rows
            error = (self._soft(np.add.reduceat(self.w[at] * value, starts)) - goal) / len(rows)
            g = 1e-4 * self.w
            g[places] += np.add.reduceat((error[row] * value)[by_place], first)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)

    @staticmethod
    def _soft(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _places(self, ws: list[bytes]) -> list[int]:
        return sorted(self.place[f] for f in features(ws) if f in self.place)

    def scores(self, ws: list[bytes]) -> np.ndarray:
        at = self._places(ws)
        return self.w[-1] + (self.w[at].sum(0) / len(at) ** 0.5 if at else 0)

    def probabilities(self, ws: list[bytes]) -> np.ndarray:
        return self._soft(self.scores(ws)[None, :] / self.temperature)[0]


def training_rows(texts: list[str], scan: Scan = Scan()) -> tuple[list[Row], dict[str, int]]:
    """Variants of the templates by family; the sample's lines, NOT_NOTICES, RIVALS and negated templates as unknown; and each origin's half.

    A family's templates are in the halves in turn, so that each half has some.
    """
    rng = np.random.default_rng(scan.seed)
    lines = [ws for t in texts for x in (t or "").split("\n")[:20] if len(ws := words(x)[: scan.window]) > 3 and shared_pairs(ws) < scan.shared]
    fill = [w for ws in lines for w in ws] or [b"text"]
    rows: list[Row] = [(lines[k], UNKNOWN, f"line {k}") for k in rng.permutation(len(lines))[:1200]]
    halves = {of: k % 2 for k, (_, _, of) in enumerate(rows)}

    def around(ws: list[bytes]) -> list[bytes]:
        pick = lambda n: [fill[k] for k in rng.integers(0, len(fill), n)]
        return pick(rng.integers(0, 8)) + ws + pick(rng.integers(0, 8))

    for k, text in enumerate(NOT_NOTICES):
        halves[text] = k % 2
        rows += [(around([w for w in words(text) if rng.random() > 0.1]), UNKNOWN, text) for _ in range(scan.variants)]
    for k, text in enumerate([*RIVALS, *[x for ts in TEMPLATES.values() for t in ts for x in negated(t)]]):
        ws, halves[text] = words(text), k % 2
        rows += [(ws, UNKNOWN, text)] * 2 + [(around([w for w in ws if rng.random() > 0.03]), UNKNOWN, text) for _ in range(scan.variants // 3)]
    for c, family in enumerate(FAMILIES):
        for k, text in enumerate(TEMPLATES[family]):
            ws, halves[text] = words(text), k % 2
            rows += [(ws, c, text)] * 4 + [(around([w for w in ws if rng.random() > 0.08]), c, text) for _ in range(scan.variants)]
    # two notices in one window are one of each
    every = [(c, t) for c, family in enumerate(FAMILIES) for t in TEMPLATES[family]]
    for k in range(scan.together):
        (a, first), (b, second) = (every[i] for i in rng.choice(len(every), 2, replace=False))
        halves[f"together {k}"] = k % 2
        rows += [(words(first) + words(second), c, f"together {k}") for c in (a, b)]
    return rows, halves


def windows(lo: int, hi: int, size: int) -> list[tuple[int, int]]:
    """The words from lo to hi, cut into windows that overlap by half if they are many."""
    if hi - lo <= size:
        return [(lo, hi)]
    return [(i, min(i + size, hi)) for i in range(lo, hi - size // 2, size // 2)]


def paragraphs(raw: bytes) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Runs of lines with words, as (line's number, words); lines without any part them. A word broken at its hyphen is one."""
    run: list = []
    for number, line in enumerate(raw.split(b"\n")):
        if ws := line.split():
            if run and run[-1][1] and run[-1][1][-1].endswith(b"-") and run[-1][1][-1].strip(b"-"):
                run[-1][1][-1] += ws.pop(0)
            run.append((number, ws))
        elif run:
            yield run
            run = []
    if run:
        yield run


def notices(ws: list[bytes], found: list[tuple], least: float) -> list[tuple]:
    """(similarity, probability, family, first word, window) of each notice in a paragraph, from its (similarity, probability, family, window).

    The best come first; a triple that speaks for one family speaks for no
    other, and overlapping windows of a family are one notice.
    """
    taken: dict = {}
    kept = []
    for _, p, family, lo, hi in sorted(found, key=lambda f: (-f[0], -f[1], *f[2:])):
        others = {i - lo for i in range(lo, hi) if taken.get(i, family) != family}
        share, at = evidence(ws[lo:hi], family, others)
        if share >= least:
            taken |= {lo + i: family for i in at}
            kept.append((share, p, family, lo + at[0], lo, hi))
    out: list = []
    for k in sorted(kept, key=lambda k: (k[2], k[4], k[5])):
        if out and out[-1][2] == k[2] and k[4] < out[-1][5]:
            out[-1] = (*max(out[-1], k, key=lambda h: (h[0], h[1], -h[3]))[:4], out[-1][4], max(out[-1][5], k[5]))
        else:
            out.append(k)
    return out


def scanned(text: str | None, model: Classifier, scan: Scan = Scan()) -> tuple:
    """(n_paragraphs, n_predicted, n_confirmed, families, family, probability, similarity, paragraph) of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(_DIGITS, _DROP)
    count, predicted, hits = 0, 0, []
    for lines in paragraphs(raw):
        count += 1
        ws = [w for _, line in lines for w in line]
        # fewer shared pairs can't be confirmed: a triple of a template has two of them
        if shared_pairs(ws) < scan.shared and not any(w[:1] == b"0" for w in ws):
            continue
        ws = [b"0" if w.isdigit() else w for w in ws]
        near = list(accumulate(map(PAIRS.__contains__, zip(ws, ws[1:], strict=False)), initial=0))
        if near[-1] < scan.shared:
            continue
        ends = list(accumulate(len(line) for _, line in lines))
        parts = windows(0, len(ws), scan.window)
        if len(lines) > 1:  # a short notice is not thinned out by the lines around it
            parts += [part for lo, hi in zip([0, *ends], ends, strict=False) for part in windows(lo, hi, scan.window)]
        found = []
        for lo, hi in dict.fromkeys(parts):
            if near[hi - 1] - near[lo] < scan.shared:
                continue
            p = model.probabilities(ws[lo:hi])
            for c in np.flatnonzero(p[:UNKNOWN] >= scan.probability * (p[:UNKNOWN] + p[UNKNOWN])):
                found.append((evidence(ws[lo:hi], FAMILIES[c])[0], float(p[c]), FAMILIES[c], lo, hi))
        predicted += bool(found)
        for share, p, family, first, _, _ in notices(ws, [f for f in found if f[0] >= scan.similarity], scan.similarity):
            hits.append((share, p, family, lines[bisect(ends, first)][0]))
    top = max(hits, key=lambda h: (h[0], h[1], -h[3]), default=(None, None, None, None))
    families = ",".join(sorted({h[2] for h in hits})) or None
    return count, predicted, len(hits), families, top[2], None if top[1] is None else round(top[1], 3), None if top[0] is None else round(top[0], 6), top[3]


FOUND = "n_paragraphs bigint, n_predicted bigint, n_confirmed bigint, families string, family string, probability double, similarity double, paragraph int"


def fitted(docs: DataFrame, scan: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """A classifier whose unknown class has seen a bounded sample of ``docs``."""
    sample = docs.select(F.col(id_col).cast("string").alias("i"), F.substring(F.col(text_col).cast("string"), 1, 20_000).alias("t"))
    sample = bounded_sample(sample, scan.sample, F.col("i"), F.col("t"))
    rows, halves = training_rows([r.t for r in sample.collect()], scan)
    return Classifier(rows, scan.seed, halves)


def licences(docs: DataFrame, scan: Scan = Scan(), model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text", found: str = "licence") -> DataFrame:
    """``docs`` with a struct column ``licence`` (the fields of FOUND).

    Every paragraph (lines up to one without words) of every whole text is
    looked through, long ones in overlapping windows, and each of its lines too.
    A window with fewer than ``shared`` word pairs of any template isn't shown
    to the classifier, since it can't be confirmed: a triple has two pairs. The
    unknown class is one of the model's; every family is predicted that has
    ``probability`` (at a temperature fitted to templates that the model hadn't
    seen) against it alone. ``n_predicted`` counts the paragraphs for which a
    family was predicted. It stands only if the window has ``similarity`` of the
    word triples of one of its templates, without those of a better family. All
    notices count, overlapping windows of a family as one; the other fields are
    of the first of the best, ``paragraph`` is the number of the line in which
    it begins.

    Equal similarities go by probability, then by the place in the text. A null
    or empty text has no paragraphs; a very long one is read whole, in memory in
    proportion to it. Repeated rows get equal results; an empty table gives an
    empty one (the classifier is then trained on templates alone). Other columns
    pass through; the new one gets a number if there is one of its name.
    """
    (found,) = fresh(docs.columns, found)
    model = model or fitted(docs, scan, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the templates
    fields, at = T.StructType.fromDDL(FOUND), docs.columns.index(text_col)
    kinds = [pa.field(f.name, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()]) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            cols = list(zip(*[scanned(t.as_py(), model, scan) for t in batch.column(at)], strict=True)) or [()] * len(kinds)
            added = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], fields=kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, added], [*batch.schema.names, found])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(found, fields)]))


def op1_licence_scan(spark, sf_dir: str) -> DataFrame:
    """``licences`` over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return licences(docs).select("doc_id", "licence.*")
