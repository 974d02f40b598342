"""Licence notices by a trained paragraph classifier, scored in SQL expressions only.

A paragraph is a line, and also each run of adjacent lines with words of
licences, so that a notice that is wrapped is judged as a whole. Its word
n-grams meet the weights of a sparse multinomial logistic
regression over licence families and plain prose. A paragraph that looks like a
licence but whose best family is not probable enough is unknown; the bound is
calibrated on families left out of training. A family must also be confirmed by
the share of the paragraph's word pairs that its templates have.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices and typical sentences of public licences, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license. See the LICENSE file for details.", "This project is licensed under the terms of the MIT License.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.", "This software is distributed under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL version 2 or later.", "Released under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL v3.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL v3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text available under the Creative Commons Attribution license.", "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License", "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under a Creative Commons Attribution-NonCommercial licence.", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0": [
        "Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "ISC": [
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "EPL": [
        "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "proprietary": [
        "Copyright. All rights reserved.", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential. No part of this publication may be reproduced without prior written permission.",
    ],
}
#: Sentences that use words of licences and aren't notices.
PROSE = [
    "The software was released to the public in the spring.", "He lost his driving license after the accident.", "The general asked the public for permission to use the source of the river.", "Free copies of the book are distributed in schools.", "The new version of the program has a modified form.",
    "A fishing license can be obtained at the office for a small fee.", "The apache rode along the river.", "She studied at MIT for a year and sold her company.", "All conditions were met and work on the library began.", "The warranty of this car has expired, as is shown in the notice.",
    "The common source of the attribution was a creative author.", "The eclipse was visible in the whole state.", "Commercial use of the domain is limited.", "The foundation published its terms and conditions.", "We must reproduce the result before we publish it.",
    "The rights of every person are protected by law.", "The binary star is far away.", "The file holds a list of related documents.", "Any means of transport will do for this purpose.", "The liberal party granted a public hearing.",
]
#: Words too common to be evidence; a gram needs one word that isn't among them.
COMMON = frozenset(
    "a about above after all along also an and any are as at be been before by can do either else every for from had has have he her his i if in into is it its kind may more most must no not of off on one or other our out part shall she should so such than that the their them then there these they this to under unless up use used via was we were what when which who will with without you your".split()
)
#: The least share, by weight, of a paragraph's word pairs with a licence word that the family's templates must have.
CONFIRM = 0.53
RIDGE = 5e-5
#: Share of the licence paragraphs of families the model doesn't know that the bound must find unknown.
CALIBRATED = 0.9

_WORD = "[^a-z0-9.+]+"


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(_WORD, text.lower())) if w]


def grams_of(words: list[str]) -> set[str]:
    """Words and word pairs that hold a word that isn't common."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:]) if a not in COMMON or b not in COMMON]
    return {w for w in words if w not in COMMON} | set(pairs)


def _augmented(rng, words: list[str], filler: list[str]) -> list[str]:
    """The words with some lost and some others around them."""
    kept = [w for w in words if rng.random() > 0.1] or words
    a, b = (rng.choice(filler, rng.integers(0, 4)).tolist() for _ in range(2))
    return [*a, *kept, *b]


class Classifier:
    """Vocabulary, weights (gram by class; the last class is prose), intercepts, temperature and bound."""

    def __init__(self, families: list[str]):
        self.families = families
        rng = np.random.Generator(np.random.PCG64(11))
        filler = [w for s in PROSE for w in words_of(s)]
        texts, y = [], []
        for k, name in enumerate(families):
            for t in TEMPLATES[name]:
                w = words_of(t)
                texts += [w, *(_augmented(rng, w, filler) for _ in range(2))]
                y += [k] * 3
        for s in PROSE:
            w = words_of(s)
            texts += [w, *(rng.permutation(_augmented(rng, w, filler)).tolist() for _ in range(5))]
            y += [len(families)] * 6
        grams = [grams_of(w) for w in texts]
        known = set().union(*(grams_of(words_of(t)) for name in families for t in TEMPLATES[name]))
        self.vocabulary = sorted(known)
        index = {g: i for i, g in enumerate(self.vocabulary)}
        x = np.zeros((len(texts), len(index)))
        for i, g in enumerate(grams):
            x[i, [index[j] for j in g if j in index]] = 1
        self.index = index
        self.weights, self.bias = _multinomial(x, np.array(y), len(families) + 1)

    def probabilities(self, text: str) -> np.ndarray:
        hits = [self.index[g] for g in grams_of(words_of(text)) if g in self.index]
        z = self.bias + self.weights[hits].sum(axis=0)
        p = np.exp(z - z.max())
        return p / p.sum()


def _multinomial(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Ridge multinomial logistic regression by accelerated gradient steps."""
    n = len(x)
    target = np.eye(classes)[y] / np.bincount(y, minlength=classes)[y][:, None] * (n / classes)
    size = target.sum(axis=1, keepdims=True)
    xb = np.column_stack([x, np.ones(n)])
    u = np.ones(xb.shape[1])
    for _ in range(30):  # the largest curvature, by power iteration
        u = xb.T @ (size[:, 0] * (xb @ u))
        u /= np.linalg.norm(u)
    rate = 1.0 / (0.5 * np.linalg.norm(xb.T @ (size[:, 0] * (xb @ u))) / n + RIDGE)
    w = v = np.zeros((xb.shape[1], classes))
    for t in range(steps):
        z = xb @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = xb.T @ (p * size - target) / n + RIDGE * v
        new = v - rate * grad
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], w[-1]


@functools.cache
def trained() -> tuple[Classifier, float]:
    """The classifier of all families, and the least probability of a known family.

    The bound is calibrated with models that each lack a fifth of the
    families: it is the CALIBRATED quantile of what they give the templates of
    the lacking ones, but never so high that a template of a known family
    would be rejected by the full model.
    """
    families = list(TEMPLATES)
    strange = []
    for k in range(5):
        part = Classifier([f for i, f in enumerate(families) if i % 5 != k])
        strange += [float(part.probabilities(t)[:-1].max()) for i, f in enumerate(families) if i % 5 == k for t in TEMPLATES[f]]
    whole = Classifier(families)
    sure = [float(whole.probabilities(t)[k]) for k, f in enumerate(families) for t in TEMPLATES[f]]
    return whole, min(float(np.quantile(strange, CALIBRATED)), 0.999 * min(sure))


def _strings(values) -> str:
    return "split('" + "|".join(values).replace("'", "") + "', '[|]')"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and the array ``notices`` of each row of ``docs`` (doc_id, text): paragraph (its first line, from 0), family, probability and similarity.

    A paragraph that is more likely a licence notice than prose is listed: with
    its family if that is probable enough and confirmed, else as ``unknown``.
    Adjacent lines with licence words are one paragraph if, joined, they have a
    confirmed family and no line has another one; else each line is one. Texts
    that are null, empty or without any word of the templates have an empty
    array; a line without such words scores as prose, so skipping it changes
    nothing. Texts of any length are read whole. Rows are judged each by
    itself, repeated ones alike; an empty table gives an empty result.
    """
    model, bound = trained()
    n = len(model.families)
    anchors = sorted({w for g in model.vocabulary for w in g.split(" ") if w not in COMMON})
    vocabulary = _strings(model.vocabulary)
    # one flat array: a constant that is parsed once
    weights = "cast(split('" + ",".join(f"{x:.5f}" for x in model.weights.ravel()) + "', ',') as array<double>)"
    bias = "cast(split('" + ",".join(f"{x:.5f}" for x in model.bias) + "', ',') as array<double>)"
    pairs = [sorted({f"{a} {b}" for t in TEMPLATES[f] for w in [words_of(t)] for a, b in zip(w, w[1:])}) for f in model.families]
    templates = "array(" + ", ".join(_strings(p) for p in pairs) + ")"
    common = _strings(sorted(COMMON))
    spaced = lambda s: f"filter(transform(split(lower({s}), '{_WORD}'), x -> trim(BOTH '.' FROM x)), x -> x <> '')"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    all_pairs = "array_distinct(transform(sequence(1, greatest(size(w) - 1, 1)), i -> concat(w[i - 1], ' ', coalesce(get(w, i), ''))))"
    hits = f"array_intersect(array_union(array_distinct(w), p), {vocabulary})"
    logits = f"aggregate(h, {bias}, (z, g) -> zip_with(z, slice(weights, cast(array_position(vocabulary, g) as int) * {n + 1} - {n}, {n + 1}), (a, b) -> a + b))"
    softmax = let("top", "array_max(z)", let("e", "transform(z, v -> exp(v - top))", "transform(e, v -> v / aggregate(e, 0D, (s, u) -> s + u))"))
    best = f"cast(array_position(slice(q, 1, {n}), array_max(slice(q, 1, {n}))) as int)"
    names = _strings(model.families)
    # pairs that few families have weigh more, and pairs that none has weigh most
    often = {g: sum(g in x for x in pairs) for g in sorted(set().union(*map(set, pairs)))}
    rarity = "cast(split('" + ",".join(f"{np.log(1 + n / c) / np.log(1 + n):.5f}" for c in often.values()) + "', ',') as array<double>)"
    weight = lambda x: f"aggregate({x}, 0D, (s, g) -> s + coalesce(get(rarity, cast(array_position(known, g) as int) - 1), 1D))"
    alike = f"{weight('array_intersect(p, templates[k - 1])')} / greatest({weight('p')}, 1e-9D)"
    named = (
        f"named_struct('paragraph', j, 'family', if(q[k - 1] >= {bound!r} and {alike} >= {CONFIRM}, names[k - 1], 'unknown'), "
        f"'probability', round(q[k - 1], 6), 'similarity', round({alike}, 6), 'prose', q[{n}])"
    )
    judged = let("w", spaced("line"), let("p", f"filter({all_pairs}, g -> arrays_overlap(split(g, ' '), {_strings(anchors)}))", let("h", hits, let("z", logits, let("q", softmax, let("k", best, named))))))
    # cheap first: only lines with a word of the templates can be anything but prose
    marked = docs.select("doc_id", "text").withColumn("words", F.expr(f"if(text is null, array(), {spaced('text')})"))
    gated = marked.withColumn("any", F.expr(f"arrays_overlap(words, {_strings(anchors)})"))
    # lines with such a word keep their number, others become borders: what stands between these is a run
    numbered = f"array_join(transform(split(text, '\\n'), (line, j) -> if(arrays_overlap({spaced('line')}, {_strings(anchors)}), concat(cast(j as string), chr(2), translate(line, concat(chr(1), chr(2)), '  ')), chr(1))), '\\n')"
    runs = f"filter(transform(split({numbered}, chr(1)), r -> filter(split(r, '\\n'), l -> l <> '')), r -> size(r) > 0)"
    line = "named_struct('j', cast(substring_index(x, chr(2), 1) as int), 'line', substring_index(x, chr(2), -1))"
    whole = "if(size(r) > 1, array(named_struct('j', cast(substring_index(r[0], chr(2), 1) as int), 'line', array_join(transform(r, x -> substring_index(x, chr(2), -1)), ' '))), cast(array() as array<struct<j:int,line:string>>))"
    lets = {"vocabulary": vocabulary, "weights": weights, "names": names, "templates": templates, "rarity": rarity, "known": _strings(often)}
    for name, value in lets.items():
        judged = re.sub(rf"(?<![\w'.]){name}(?=[\[,])", value.replace("\\", r"\\"), judged)
    single = re.sub(r'(?<![\w.])(line|j)(?!\w)', r'l.\1', judged)
    # of a run the joined lines, if any, come first
    each = f"transform({runs}, r -> transform(concat({whole}, transform(r, x -> {line})), l -> {single}))"
    families = "array_distinct(transform(filter(slice(c, 2, size(c) - 1), x -> x.prose < 0.5D and x.family <> 'unknown'), x -> x.family))"
    joined = f"size(c) > 1 and c[0].prose < 0.5D and c[0].family <> 'unknown' and size(array_except({families}, array(c[0].family))) = 0"
    chosen = f"if({joined}, slice(c, 1, 1), filter(if(size(c) > 1, slice(c, 2, size(c) - 1), c), x -> x.prose < 0.5D))"
    notices = f"if(any, flatten(transform({each}, c -> {chosen})), cast(array() as array<struct<paragraph:int,family:string,probability:double,similarity:double,prose:double>>))"
    out = gated.select("doc_id", F.expr(notices).alias("found"))
    return out.select("doc_id", F.expr("transform(found, x -> named_struct('paragraph', x.paragraph, 'family', x.family, 'probability', x.probability, 'similarity', x.similarity))").alias("notices"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many notices it has, its families in order, how many notices are unknown, and the surest one's probability and similarity."""
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.expr("array_join(array_sort(array_distinct(filter(notices.family, f -> f <> 'unknown'))), ',')").alias("families"),
        F.expr("cast(size(filter(notices, x -> x.family = 'unknown')) as long)").alias("n_unknown"),
        F.expr("array_max(notices.probability)").alias("probability"),
        F.expr("array_max(notices.similarity)").alias("similarity"),
    )
