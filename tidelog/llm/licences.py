"""License scans by a trained paragraph classifier.

A paragraph is a line, or lines of one notice that is wrapped (lines in a row, none
of them empty, that each have words of a notice, read as one where no line alone
names a family); it is a bag of word 1- to 3-grams; multinomial logistic
regression over sparse explicit n-grams names its licence family, ``unknown`` for
licence talk of no known family, or none.  The model is fitted on the template
notices below, each in variants (words dropped, others put round it), on generic
licence talk, on ordinary sentences with words of notices and on distinct paragraphs of a bounded sample of distinct texts
(``BACKGROUND_DOCS`` in order of a hash of the text) that match no notice, as the
class of no licence; a
temperature fitted on variants kept out of training calibrates the
probabilities.  A family is only reported when its probability is at least
``SURE`` and a template of the family confirms it: ``ALIKE`` of the template's
n-grams that have an informative word are in the paragraph; else it is
``unknown``.

Features have an informative word, any of the notices but function words (``STOP``),
whatever the corpus; a paragraph without any is passed over, which is exact.  Every whole text is scanned, in one
narrow stage.

Edge cases: null and empty texts have no paragraphs; repeated paragraphs count
each; rows that repeat are scanned each; an empty table gives an empty result, and a
corpus without texts no background; very long texts are scanned whole; extra columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

# Notices by which works name their licence and the licences' own headers and grants, by SPDX family.
TEMPLATES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-only"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-only"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "Licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Released under the zlib License.", "SPDX-License-Identifier: Zlib"],
}
# The licences' titles, by family.
TITLES = {
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "CC0-1.0": "CC0 1.0 Universal",
    "EPL-2.0": "Eclipse Public License - v 2.0",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "ISC": "ISC License",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MIT": "MIT License",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "Unlicense": "This is the Unlicense",
    "Zlib": "zlib License",
}
# Ordinary sentences with words of notices.
ORDINARY = [
    "The driving license office is closed on Monday.", "A fishing license costs 20 dollars a year.", "He lost his license after the third accident.", "She is a licensed therapist in the state of Maine.",
    "The bar was sold with its liquor license.", "The film was released to the public in June.", "The general released a statement on public works.", "Entry is free of charge for any person under twelve.",
    "The redistribution of land was the aim of the reform.", "Permission to enter the building was granted on the following conditions.", "The software is sold with a warranty of two years.", "The team may use any source of water without restriction.",
    "The foundation published its report in both forms.", "Everyone is free to use the sports ground for any purpose.", "The commons voted on the attribution of the work.", "Copies of the notice were distributed without charge.",
    "The author has waived the fee for this work.", "The plumber is licensed and insured.", "The library is free for any later visitor.", "The contract was modified and published under the old terms.",
]
# Licence talk of no family.
GENERIC = ["All rights reserved. Use is subject to license terms.", "Licensed under a proprietary license.", "This work is licensed under the terms in the file LICENSE.", "Released under a custom license, see below.", "The license of this work is not known.", "A license is required to use this work.", "Published under the house license, version 7.", "Distributed under the Foo License.", "Published under the Bar license.", "Available under the terms of the Baz Public License.", "This software is made available under the license of its authors."]

UNKNOWN, NONE = "unknown", "none"
BACKGROUND_DOCS = 300
BACKGROUND_PARAGRAPHS = 3000
VARIANTS = 30
SURE, ALIKE = 0.5, 0.6
#: Families that a word which tells them apart may be in.
FEW_FAMILIES = 5
#: Lines that a wrapped notice may have.
WRAPPED = 40
#: Words that only licence talk has.
TALK = frozenset({"license", "licensed", "copyright", "spdx"})
#: Words of notices that tell nothing.
STOP = frozenset("the of to in is and or any may not you with for by on as all it its be are if at an has have this that these there such from but no who which either will shall can been was were into only see so".split())
TOKEN = re.compile(r"[^\W_]+")


def grams(words: list[str], informative: set[str] | frozenset[str] | None = None) -> set[str]:
    """The 1- to 3-grams with an informative word."""
    own = [informative is None or w in informative for w in words]
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1) if any(own[i : i + n])}


def paragraphs(text: str) -> Iterator[tuple[int, int, str]]:
    at = 0
    for line in text.split("\n"):
        if line.strip():
            yield at, at + len(line), line
        at += len(line) + 1


def variants(words: list[str], filler: list[str], rng: np.random.Generator, n: int = VARIANTS, decisive: frozenset[str] = frozenset()) -> Iterator[list[str]]:
    """words, then n times words with some left out, but for decisive ones, and others put round them."""
    yield words
    for _ in range(n):
        kept = [w for w in words if rng.random() > 0.1 or w in decisive] or words
        around = [str(w) for w in rng.choice(filler, int(rng.integers(0, 9)))] if filler else []
        at = int(rng.integers(0, len(around) + 1))
        yield [*around[:at], *kept, *around[at:]]


class LicenceModel:
    def __init__(self, background: list[str]):
        rng = np.random.default_rng(3)
        lines = [TOKEN.findall(p.lower()) for t in background for _, _, p in paragraphs(t)]
        every = {f: [*ts, TITLES[f]] for f, ts in TEMPLATES.items()}
        notices = [(f, TOKEN.findall(t.lower())) for f, ts in every.items() for t in ts] + [(UNKNOWN, TOKEN.findall(t.lower())) for t in GENERIC]
        self.informative = frozenset(w for _, x in notices for w in x if len(w) > 1 and w not in STOP)
        # the background names no licence itself
        known = [g for _, x in notices if (g := grams(x, self.informative))]
        runs = frozenset(g for x in known for g in x if g.count(" ") == 2)
        lines = [list(x) for x in dict.fromkeys(map(tuple, lines)) if TALK.isdisjoint(x) and not self.notice(x, known, runs)][:BACKGROUND_PARAGRAPHS]
        filler = list(dict.fromkeys(w for x in lines for w in x))[:500]
        self.names = [*TEMPLATES, UNKNOWN, NONE]
        self.templates = {f: [grams(TOKEN.findall(t.lower()), self.informative) for t in ts] for f, ts in every.items()}
        self.texts = {f: [f" {' '.join(TOKEN.findall(t.lower()))} " for t in ts] for f, ts in every.items()}
        self.runs = frozenset(g for ts in self.templates.values() for t in ts for g in t if " " in g)
        # what tells families apart: numbers, and words of a few families only
        of: dict[str, set[str]] = {}
        for family, x in notices:
            for w in x:
                of.setdefault(w, set()).add(family)
        self.decisive = frozenset(w for w, fs in of.items() if w.isdigit() or len(fs) <= FEW_FAMILIES)
        # words round a notice must not make it another
        train, held = [], []
        for family, words in notices:
            for i, v in enumerate(variants(words, filler, rng, VARIANTS, self.decisive)):
                (held if i % 5 == 4 else train).append((self.names.index(family), grams(v, self.informative)))
        train += [(len(self.names) - 1, grams(x, self.informative)) for x in lines]
        # nor is ordinary talk with such words
        for t in ORDINARY:
            for i, v in enumerate(variants(TOKEN.findall(t.lower()), filler, rng, 5)):
                (held if i % 5 == 4 else train).append((len(self.names) - 1, grams(v, self.informative)))
        # single words of notices in ordinary text are no licence
        train += [(len(self.names) - 1, {str(w)}) for w in sorted(self.informative - {"license", "licensed"}) if w.isalpha()]
        self.at = {g: i for i, g in enumerate(sorted({g for _, s in train for g in s}))}
        self.weights = np.zeros((len(self.at) + 1, len(self.names)))
        self.weights[-1, -1] = 3.0
        x = [np.array([self.at[g] for g in s] + [len(self.at)]) for _, s in train]
        y = np.array([c for c, _ in train])
        some = np.array([i for i in range(len(x)) if y[i] != len(self.names) - 1 or len(x[i]) > 1])
        g2 = np.full(self.weights.shape, 1e-2)
        for _ in range(12):
            for i in rng.permutation(some):
                p = self.softmax(self.weights[x[i]].sum(0))
                p[y[i]] -= 1
                g2[x[i]] += p * p
                self.weights[x[i]] -= 0.3 * p / np.sqrt(g2[x[i]])
        # temperature by held-out likelihood
        z = np.array([self.weights[[self.at[g] for g in s if g in self.at] + [len(self.at)]].sum(0) for _, s in held])
        c = np.array([c for c, _ in held])
        fit = lambda t: np.mean([-np.log(self.softmax(v / t)[k] + 1e-12) for v, k in zip(z, c)])
        self.temperature = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=fit)

    def notice(self, words: list[str], known: list[set[str]], runs: frozenset[str]) -> bool:
        """Whether words hold a notice, or are a part of one for the most."""
        if self.informative.isdisjoint(words):
            return False
        own = grams(words, self.informative)
        three = [g for g in own if g.count(" ") == 2]
        return sum(g in runs for g in three) * 2 >= max(1, len(three)) or any(len(t & own) >= ALIKE * len(t) for t in known)

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max())
        return e / e.sum()

    def classify(self, words: list[str]) -> tuple[str, float, float] | None:
        """Family, probability and likeness to the best template; None for no licence."""
        own = grams(words, self.informative)
        p = self.softmax(self.weights[[self.at[g] for g in own if g in self.at] + [len(self.at)]].sum(0) / self.temperature)
        if p[-1] >= 0.5:
            return None
        best = int(p[:-2].argmax())
        name = self.names[best]
        alike = max((len(t & own) / len(t) for t in self.templates[name] if t), default=0.0)
        if p[best] >= SURE and alike >= ALIKE:
            return name, float(p[best]), alike
        # no template confirms a family: licence talk of another, where it is that
        return None if TALK.isdisjoint(words) else (UNKNOWN, float(1 - p[-1]), alike)

    def scan(self, text: str | None) -> Iterator[tuple[int, int, str, float, float]]:
        run: list[tuple[int, int, list[str]]] = []
        for start, end, line in paragraphs(text or ""):
            words = TOKEN.findall(line.lower())
            if run and start != run[-1][1] + 1:
                yield from self.named(run)
                run = []
            if not self.informative.isdisjoint(words):
                run.append((start, end, words))
            elif run and words:
                yield from self.named(run)
                run = []
        yield from self.named(run)

    def named(self, run: list[tuple[int, int, list[str]]]) -> Iterator[tuple[int, int, str, float, float]]:
        """What a run of lines with informative words names: wrapped notices first, then each line left."""
        alone = [self.classify(words) for _, _, words in run]
        i = 0
        while i < len(run):
            # the longest stretch from here that is one notice: it explains its template better than any line in it
            best, stop = alone[i], i + 1
            if len(run) > 1 and not self.runs.isdisjoint(grams(run[i][2], self.informative)):
                held = list(run[i][2])
                for j in range(i + 1, min(len(run), i + WRAPPED)):
                    if self.runs.isdisjoint(grams(held[-2:] + run[j][2], self.informative)):
                        break
                    held += run[j][2]
                    got = self.classify(held)
                    if got and got[0] != UNKNOWN and self.one_notice(got[0], run[i:j + 1]) and (best is None or best[0] in (UNKNOWN, got[0]) or got[2] > best[2]):
                        best, stop = got, j + 1
            if best:
                yield run[i][0], run[stop - 1][1], *best
            i = stop

    def one_notice(self, family: str, lines: list[tuple[int, int, list[str]]]) -> bool:
        """Whether each of the lines has its share of one and the same notice of the family."""
        return any(all(self.within(t, words) for _, _, words in lines) for t in self.texts[family])

    @staticmethod
    def within(template: str, words: list[str]) -> bool:
        two = [" ".join(words[k : k + 2]) for k in range(max(1, len(words) - 1))]
        return sum(f" {x} " in template for x in two) * 2 >= len(two)


def train(docs: DataFrame, background_docs: int = BACKGROUND_DOCS) -> LicenceModel:
    """Fit with a bounded sample of documents as background."""
    able = docs.where((F.length("text") > 0) & (F.length("text") <= 20_000))
    keyed = able.select("text", F.xxhash64("text").alias("h"))
    sample = keyed.select("h").distinct().orderBy("h").limit(background_docs)
    texts = keyed.join(F.broadcast(sample), "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(background_docs)
    return LicenceModel([r.text for r in texts.collect()])


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, text) to doc_id and found: the paragraphs with a licence (start, end in characters, family, probability, alike)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[dict(zip(("start", "end", "family", "probability", "alike"), x)) for x in held.value.scan(t)] for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "found": found})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, found array<struct<start:int,end:int,family:string,probability:double,alike:double>>")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families named in each whole text, sorted, with the count of paragraphs that name one."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    return found.select("doc_id", F.size("found").cast("long").alias("n_licences"), F.array_join(families, ",").alias("families"), F.get(F.transform("found", lambda x: x["start"]), F.lit(0)).alias("first_start"))
