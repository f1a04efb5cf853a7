"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

A softmax regression over sparse word 1-, 2- and 3-grams tells licence families and an ``unknown`` class
apart. It is trained here on a bounded set of labelled rows, the templates below cut and varied by rule, against
background paragraphs as unknown. The background is counted, not sampled: over all paragraphs of the corpus that hold one of
the templates' words (the ones a prediction is made for), how often each known n-gram occurs in one that no template resembles.
Examples of the unknown class are drawn from those rates. Whole templates are held out of a first fit; the
temperature at which it fits them and other background draws best calibrates the final one. A prediction counts only if
the family's probability beats unknown and 0.5, and if a template of that family shares enough word 3-grams with the paragraph.

Paragraphs are a document's lines, and its blank-line-separated blocks of several lines; the whole text is
looked at. Only paragraphs that hold an anchor word are: of each 3-gram of a template the longest word that isn't common.
Documents without one are passed over on the JVM.

Edge cases: null and empty texts have no paragraphs; repeated ids are separate rows; a block that is also a
line counts once; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Examples of the unknown class drawn from the background's rates.
BACKGROUND = 600
#: Share of the smaller side's 3-grams that a confirming template has in common with the paragraph.
CONFIRM = 0.6
UNKNOWN = "unknown"

# Notices and opening paragraphs of common licences, by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "SPDX-License-Identifier: Zlib",
    ],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "eupl": ["Licensed under the EUPL, Version 1.2.", "SPDX-License-Identifier: EUPL-1.2"],
    "artistic": ["This is free software, licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide."],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
# Sentences that speak of such things without licensing anything.
OTHERS = [
    "She renewed her driver license at the public office in version of her own.",
    "The permission to use the pool is granted by the club, free of charge, on Sundays.",
    "The software was released last year and the public liked it.",
    "A general notice was published by the foundation.",
    "The apache tribe lived in the south west.",
    "He studied at MIT and works on free software.",
    "All tables are reserved for tonight.",
    "Copies of the book were distributed in the library without fee.",
    "The rights of the author and the terms of the contract are discussed in writing.",
    "Commercial use of the road is prohibited by applicable law.",
]
_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(ws: list[str]) -> set[str]:
    return set(ws) | {f"{a} {b}" for a, b in zip(ws, ws[1:])} | {f"{a} {b} {c}" for a, b, c in zip(ws, ws[1:], ws[2:])}


def triples(ws: list[str]) -> set[tuple[str, ...]]:
    return set(zip(ws, ws[1:], ws[2:])) if len(ws) >= 3 else ({tuple(ws)} if ws else set())


#: Names and identifiers, by family; the wordings are made by rule.
NAMES = {
    "mit": (["MIT License", "MIT license"], ["MIT"]),
    "apache": (["Apache License, Version 2.0", "Apache License 2.0"], ["Apache-2.0"]),
    "gpl": (["GNU General Public License", "GNU GPL"], ["GPL-2.0-only", "GPL-3.0-only", "GPL-3.0-or-later"]),
    "lgpl": (["GNU Lesser General Public License", "GNU LGPL"], ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"]),
    "agpl": (["GNU Affero General Public License", "GNU AGPL"], ["AGPL-3.0-only", "AGPL-3.0-or-later"]),
    "bsd": (["BSD 3-Clause License", "BSD 2-Clause License", "BSD License"], ["BSD-2-Clause", "BSD-3-Clause"]),
    "mpl": (["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"], ["MPL-2.0"]),
    "isc": (["ISC License"], ["ISC"]),
    "unlicense": (["Unlicense"], ["Unlicense"]),
    "zlib": (["zlib License"], ["Zlib"]),
    "boost": (["Boost Software License, Version 1.0"], ["BSL-1.0"]),
    "epl": (["Eclipse Public License 2.0", "Eclipse Public License - v 2.0"], ["EPL-2.0"]),
    "eupl": (["European Union Public Licence"], ["EUPL-1.2"]),
    "artistic": (["Artistic License 2.0"], ["Artistic-2.0"]),
    "ofl": (["SIL Open Font License, Version 1.1"], ["OFL-1.1"]),
    "cc-by": (["Creative Commons Attribution 4.0 International License"], ["CC-BY-4.0"]),
    "cc-by-sa": (["Creative Commons Attribution-ShareAlike 4.0 International License"], ["CC-BY-SA-4.0"]),
    "cc-by-nc": (["Creative Commons Attribution-NonCommercial 4.0 International License"], ["CC-BY-NC-4.0"]),
    "cc0": (["CC0 1.0 Universal"], ["CC0-1.0"]),
}
WORDINGS = ["Licensed under the {}.", "This project is licensed under the terms of the {}.", "Released under the {}.", "Distributed under the {}."]


def _texts(family: str) -> list[str]:
    """The family's templates, and those made of its names."""
    names, ids = NAMES.get(family, ([], []))
    made = [w.format(n) for n in names for w in WORDINGS] + [f"SPDX-License-Identifier: {i}" for i in ids]
    return list(dict.fromkeys(TEMPLATES[family] + made))


TEXTS = {f: _texts(f) for f in TEMPLATES}
_TRIPLES = {f: [triples(words_of(t)) for t in ts] for f, ts in TEXTS.items()}
#: Words too common to tell a licence by.
COMMON = set("a an and any are as at be but by for from have in is it its may no not of on or our that the they this to was will with you your".split())
#: Of each 3-gram of a template the longest word that isn't common. A paragraph without one isn't looked at.
ANCHORS = {max(own, key=lambda w: (len(w), w)) for ts in _TRIPLES.values() for one in ts for t in one if (own := [w for w in t if w not in COMMON])}


#: The templates that hold each 3-gram, and how many each has.
_HOLDERS: dict[tuple[str, ...], list[tuple[str, int]]] = {}
for _family, _sets in _TRIPLES.items():
    for _k, _one in enumerate(_sets):
        for _t in _one:
            _HOLDERS.setdefault(_t, []).append((_family, _k))


def similarities(ws: list[str]) -> dict[str, float]:
    """By family the most that a template of it has in common with the words, of the smaller side's 3-grams; families with none are left out."""
    own, common = triples(ws), {}
    for t in own:
        for holder in _HOLDERS.get(t, ()):
            common[holder] = common.get(holder, 0) + 1
    out: dict[str, float] = {}
    for (family, k), n in common.items():
        out[family] = max(out.get(family, 0.0), n / min(len(own), len(_TRIPLES[family][k])))
    return out


def paragraphs(text: str) -> list[tuple[int, str]]:
    """(number of the first line, text) of each line with a word and of each block of several lines."""
    lines = text.split("\n")
    out, block = [], []
    for i, line in enumerate([*lines, ""]):
        if line.strip():
            block.append((i, line))
            continue
        out += block
        if len(block) > 1:
            out.append((block[0][0], " ".join(x for _, x in block)))
        block = []
    return out


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    temperature: float

    def predict(self, ws: list[str]) -> tuple[str, float]:
        at = [self.vocabulary[g] for g in grams(ws) if g in self.vocabulary]
        g = (self.weights[-1] + self.weights[at].sum(0) / max(1.0, len(at) ** 0.5)) / self.temperature
        p = np.exp(g - g.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.families[k], float(p[k])

    def scan(self, text: str) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, similarity) of each paragraph with a confirmed prediction."""
        found = {}
        for line, p in paragraphs(text):
            ws = words_of(p)
            if ANCHORS.isdisjoint(ws):
                continue
            near = similarities(ws)
            if max(near.values(), default=0.0) < CONFIRM:
                continue  # whatever is predicted, no template confirms it
            family, prob = self.predict(ws)
            if family != UNKNOWN and prob > 0.5 and (sim := near.get(family, 0.0)) >= CONFIRM and found.get((line, family), (0, 0)) < (prob, sim):
                found[line, family] = (prob, sim)
        return sorted((line, f, p, s) for (line, f), (p, s) in found.items())


def varied(t: str) -> list[list[str]]:
    """A template whole, cut, and with words before and after."""
    before = ["Copyright 2020 the authors.", "File header:", "Note."]
    ws = words_of(t)
    out = [ws] * 4 + [words_of(b) + ws for b in before] + [ws + words_of(b) for b in before]
    out += [ws[:k] for k in range(max(3, len(ws) // 2), len(ws), 3)] + [ws[k:] for k in range(1, len(ws) // 2, 3)]
    return [v for v in out if v]


#: All n-grams of the templates' variants.
VOCABULARY = {g: i for i, g in enumerate(sorted({g for ts in TEXTS.values() for t in ts for v in varied(t) for g in grams(v)}))}


def _drawn(rates: np.ndarray, n: int, seed: int) -> list[list[int]]:
    """n sets of n-gram numbers, each n-gram in as often as its rate says."""
    rng = np.random.default_rng(seed)
    return [np.flatnonzero(rng.random(len(rates)) < rates).tolist() for _ in range(n)]


def _matrix(rows: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(rows), len(VOCABULARY) + 1), np.float32)
    for i, at in enumerate(rows):
        x[i, at] = 1 / max(1.0, len(at) ** 0.5)
    x[:, -1] = 1
    return x


def _softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    goal = np.eye(classes, dtype=np.float32)[y]
    w, m, v = (np.zeros((x.shape[1], classes), np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        g = x @ w
        p = np.exp(g - g.max(1, keepdims=True))
        grad = x.T @ (p / p.sum(1, keepdims=True) - goal) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(rates: np.ndarray | None = None, held: frozenset = frozenset()) -> Model:
    """rates: of each n-gram of VOCABULARY in background paragraphs. held: templates to leave out, besides those that calibrate."""
    rates = np.zeros(len(VOCABULARY)) if rates is None else rates
    families = [UNKNOWN, *TEMPLATES]
    known = lambda ws: [VOCABULARY[g] for g in grams(ws) if g in VOCABULARY]
    rows = [(families.index(f), t, known(v)) for f, ts in TEXTS.items() for t in ts if t not in held for v in varied(t)]
    others = [(0, t, known(words_of(t))) for t in OTHERS for _ in range(4)] + [(0, "", []) for _ in range(20)]
    background = [(0, "drawn", r) for r in _drawn(rates, BACKGROUND, 1)]
    # every third template of a family of three or more, and fresh draws, are kept for the temperature
    apart = {t for ts in TEXTS.values() if len(ts) > 2 for t in ts[2::3]}
    first = [r for r in rows if r[1] not in apart] + others + background
    test = [r for r in rows if r[1] in apart] + [(0, "drawn", r) for r in _drawn(rates, BACKGROUND // 3, 2)]
    pack = lambda rs: (_matrix([r[2] for r in rs]), np.array([r[0] for r in rs]))
    w = _softmax(*pack(first), len(families))
    x, y = pack(test)
    g = x @ w

    def loss(temperature: float) -> float:
        z = g / temperature
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), y]).mean())

    temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    return Model(families, VOCABULARY, _softmax(*pack(rows + others + background), len(families)).astype(np.float64), float(temperature))


def _anchored(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows whose text holds an anchor word; no Python sees the rest."""
    words = F.split(F.lower(F.col(text_col).cast("string")), "[^a-z0-9]+")
    return docs.where(F.arrays_overlap(words, F.array(*[F.lit(a) for a in sorted(ANCHORS)])))


def background_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n: paragraphs with an anchor, unlike every template, that hold the n-gram; gram -1 counts those paragraphs."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(len(VOCABULARY) + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                for _, p in paragraphs(t.as_py() or ""):
                    ws = words_of(p)
                    if not ANCHORS.isdisjoint(ws) and max(similarities(ws).values(), default=0.0) < CONFIRM / 2:
                        counts[[VOCABULARY[g] for g in grams(ws) if g in VOCABULARY] + [-1]] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == len(VOCABULARY), -1, at).astype(np.int32)), pa.array(counts[at])], ["gram", "n"])

    rows = _anchored(docs, text_col).select(F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Fit against the background of all of docs; what comes back is a count for each n-gram of VOCABULARY."""
    counts = dict(background_counts(docs, text_col).collect())
    n = counts.pop(-1, 0)
    rates = np.zeros(len(VOCABULARY))
    for g, k in counts.items():
        rates[g] = k / n
    return fit(rates)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line, family, probability, similarity: a row for each confirmed paragraph."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(i, *r) for i, t in zip(b.column(0), b.column(1), strict=True) for r in model.scan(t.as_py() or "")]
            cols = list(zip(*rows)) or [()] * 5
            ids = pa.array([x.as_py() for x in cols[0]], b.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64())], ["doc_id", "line", "family", "probability", "similarity"])

    return _anchored(docs, text_col).select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, line long, family string, probability double, similarity double")
