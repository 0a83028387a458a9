"""Licence scan: a trained paragraph classifier; scoring uses DataFrame operations only.

A multinomial logistic regression over sparse word 1- to 3-grams, fitted on the driver to the fixed texts below and
disturbed copies of them (a bounded training set), gives every paragraph the probabilities of the families, of
``unknown`` (another licence, or everyday use of licence words) and of ``none`` (plain text). The temperature is
calibrated on wordings and names that were held out of the fit. A paragraph is reported if ``none`` has
less than half of the probability. Its family is the likeliest one if that reaches ``LEAST`` and a template of the family confirms it
(shared word pairs over the smaller set of word pairs reach ``COVER``) and the text does not deny it (``DENIED``), otherwise ``unknown``.
Features are words of licences only, and wordings with made-up names teach the model that a wording alone names no family.

A paragraph is a line. A reported line that names no family by itself is judged again together with such lines among the
``CONTEXT`` lines before and after it, so notices that were wrapped are recognised.

Lines without any word that speaks for a licence cannot be reported, whatever else they hold; they are left out first by a
pattern made of the model's own weights.

Defined results for odd input: null text has no paragraphs; null ids are carried as null; repeated rows and paragraphs are
reported each; of equally likely families the first in the order of ``FAMILIES`` counts; texts of any length are scanned whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismflow import storage

#: Short public notices by family, after the wording that the licences themselves suggest.
NOTICES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction; the above copyright notice shall be included in all copies.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Distributed under the terms of the LGPL.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal, public domain dedication.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
#: How the families are called.
NAMES: dict[str, list[str]] = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache Software License"],
    "mit": ["MIT License", "MIT", "MIT licence"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL", "GPL version 2", "GPLv3", "GPL-2.0-only", "GPL"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU LGPL", "LGPL", "LGPLv3"],
    "bsd": ["BSD 3-Clause License", "BSD license", "BSD-2-Clause", "2-clause BSD license", "BSD"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License", "MPL 2.0"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC 3.0"],
    "cc0": ["CC0 1.0 Universal", "CC0 1.0", "CC0", "Creative Commons Zero"],
}
#: Names of other licences and terms.
OTHER_NAMES = [
    "GNU Affero General Public License", "GNU Affero General Public License version 3", "GNU Affero GPL", "AGPL-3.0", "AGPLv3", "GNU Free Documentation License", "European Union Public Licence", "EUPL", "EUPL-1.2", "Eclipse Public License", "Eclipse Public License 2.0", "EPL-2.0",
    "Common Development and Distribution License", "CDDL", "Artistic License 2.0", "ISC License", "ISC", "zlib License", "Zlib", "Boost Software License", "BSL-1.0", "WTFPL", "The Unlicense", "SIL Open Font License", "OFL-1.1",
    "Microsoft Public License", "MS-PL", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0",
    "Python Software Foundation License", "PSF-2.0", "PostgreSQL License", "Academic Free License", "Open Software License", "Business Source License", "Server Side Public License", "SSPL", "Elastic License 2.0",
    "Common Public License", "Foundation Public License 1.0", "IBM Public License", "Q Public License", "Netscape Public License", "CeCILL", "Mulan PSL", "Ruby License", "Vim License", "Sun Public License", "Lucent Public License", "Open Data Commons License",
    "Open Database License", "proprietary license", "commercial license", "vendor's own license", "end user license agreement", "company license", "same terms as the project", "internal use license",
    "CC BY-ND 3.0", "CC BY-ND", "CC BY-NC-SA 3.0", "CC BY-NC-ND 3.0", "Creative Commons Attribution-NoDerivatives License", "Eclipse Public License", "EPL", "AGPL", "AGPL version 3", "Affero General Public License", "ISC licence", "MIT-0", "BSD-4-Clause-UC",
]
#: How a text says that it is under a licence.
WORDINGS = [
    "Released under the {}.", "Licensed under {}.", "Distributed under the terms of the {}.", "Available under {}", "This work is licensed under a {}.", "SPDX-License-Identifier: {}",
    "This program is made available under the {}.", "License: {}", "You may use this file under the {}", "Published under {}, see the file.", "This project is licensed under the terms of the {}.", "The code is under the {}.", "SPDX: {}", "This is under the {}.", "The {} applies to this work.",
    "{} licensed.", "{}-Lizenz", "Copyright 2020 Example Inc. {} licensed.", "Lizenz: {}", "Veröffentlicht unter der {}.", "Sous licence {}", "Licencia {}", "The sources are {} licensed, see the file.",
]
#: Paragraphs of licences and of everyday use that name none of the families.
OTHERS = [
    "His driving licence was taken away for a year.",
    "You need a fishing license before you go to the lake.",
    "The university sells parking licenses to the staff.",
    "A parking license is needed on the campus.",
    "The copyright of the novel passed to the heirs of the author.",
    "The warranty covers parts and labour for two years.",
    "The house of commons met in the morning.",
    "The gnu is a large antelope that lives in herds.",
    "A herd of gnu crossed the river.",
    "The Apache people lived in the south.",
    "An Apache helicopter landed at the base.",
    "He studied at MIT and took a degree in physics.",
    "The MIT press published the book.",
    "The creative work of the commons was on show.",
    "A licence fee pays for the public broadcaster in the country.",
    "Redistribution of income was the subject of the debate.",
    "The city has licensed twelve new taxis this year.",
    "Copyright 2019 by the authors.",
    "Copyright (c) 2021 Example Corporation and contributors.",
    "All rights reserved. Copyright of the publisher.",
    "All rights reserved.",
    "No part of this publication may be reproduced without written permission.",
    "Licensed premises close at eleven.",
    "The software comes with a licence that the vendor sends by mail.",
    "This file is licensed under the terms stated elsewhere.",
    "See the file LICENSE for the terms.",
    "Unauthorized copying of this file is strictly prohibited.",
    "You may not redistribute this material without a license from the owner.",
    "This software is provided as is without warranty of any kind.",
]
#: Plain text, some of it with words that licences hold too.
PLAIN = [
    "The end of the year was cold and the lake froze.", "For the public of the country it was free to enter.", "It was as if all of this and that had been said before.", "In the morning by the lake they met the children.",
    "The new version of the story was published last week.", "She wrote the code on a piece of paper and made a copy.", "A person without work may apply for help at the office.", "He gave notice and left under the terms they had agreed.",
    "The source of the river lies in the hills above the town.", "You can use the file that the teacher handed out.", "The following day the conditions were better for sailing.", "They obtained a copy of the map and went on.",
    "The foundation of the house was laid in spring.", "The later form of the word is found in old books.", "The program starts at eight and is open to any person.", "The library opened its doors to the general public.",
    "Permission to enter was given by the guard at the gate.", "The project was developed by a small team.", "An international meeting was held in the city.", "Use of the pool is subject to the weather.",
    "The binary star was seen through the telescope.", "This is only possible if the rest is done by then.", "The right to vote was won at a high price.", "All the rights of the workers were discussed.",
    "The distribution of food took the whole day.", "It may be in the public interest to know the source.", "The attribution of the painting is still in doubt.", "They share alike what the garden gives them.",
    "Mit dem Hund ging er durch den Wald.", "Er kam mit der Bahn und mit einem Koffer.", "Das Haus mit den roten Fenstern steht am Fluss.", "Wir fahren mit Freunden ans Meer.", "Sie lebt mit ihrer Tochter in der Stadt.",
    "Die neue Fassung des Textes ist seit gestern bekannt.", "Am Abend kam der Regen und blieb bis zum Morgen.", "Un jour le chat est parti sans rien dire.", "Elle lit un livre dans le jardin de la maison.", "Les enfants jouent sous les arbres du parc.",
    "La version finale du film sort en mars.", "El perro duerme bajo la mesa de la cocina.", "La casa es de todos los que viven en ella.", "Los libros que compramos ayer son para la escuela.", "El agua del rio es clara y fria.",
    "Click here to read more about the news of the day.", "Write to 30@mail1.example.com or to the office, www.example.org.", "Home page contact about us search", "Sign up for the letter and get news every week.", "Read more share this page", "The price is 4.0 or 3.0 per unit, 2.0 in bulk.", "Chapter 2 section 1 table 3",
]
#: Words that never speak for a licence by themselves.
FUNCTION_WORDS = set("a all an and any are as at be by can for from has have he his if in is it its no not of on only or she so that the their they this to two under use was were which with you your s t v c above made may own same see der sous unter ver".split())
UNKNOWN, NONE = "unknown", "none"
FAMILIES = [*NOTICES, UNKNOWN]
CLASSES = [*FAMILIES, NONE]
LEAST, COVER, CONTEXT = 0.5, 0.6, 3
#: A denial a few words before what says that a text is under a licence.
DENIED = r"(?i)\b(?:not|never|no longer|isn't|aren't|neither|nicht|n'est pas)\b[^.;:!?\n]{0,40}\b(?:licen[sc]ed|released|distributed|available|published|covered|lizenziert|under)\b"
#: Disturbed copies of a text, steps and rate of the fit, penalty, least weight that counts, least texts that share a gram.
COPIES, STEPS, RATE, PENALTY, SMALLEST, SHARED, SEED = 1, 200, 0.1, 2e-5, 0.2, 3, 5


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams_of(words: list[str]) -> list[str]:
    """Distinct runs of one to three words."""
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)))


def pairs_of(words: list[str]) -> list[str]:
    """What templates are compared by: distinct pairs of neighbouring words; a lone word stands for itself."""
    return list(dict.fromkeys(" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1)))) if words else []


def templates(family: str) -> list[str]:
    """The notices of a family and every wording with its names."""
    return [*NOTICES[family], *(w.format(n) for w in WORDINGS for n in NAMES[family])]


def _strange(rng: np.random.Generator, n: int) -> list[str]:
    """Words of no language."""
    return ["".join(rng.choice(list("abcdefghijklmnoprstuvwyz"), int(rng.integers(5, 10)))) for _ in range(n)]


def everyday(words: list[str]) -> list[str]:
    """Plain lines around short words, which mean something else in many languages."""
    rng = np.random.default_rng(SEED)
    return [" ".join([*_strange(rng, int(rng.integers(1, 6))), w, *_strange(rng, int(rng.integers(1, 6)))]) for w in words for _ in range(16)]


def nameless(wordings: list[str]) -> list[str]:
    """Every wording with names that nobody has: the wording alone says that there is a licence, not which."""
    rng = np.random.default_rng(SEED + 1)
    ends = ("", " License", " Public License", " License 2.0", " 4.0", " Software License", "-1.1")
    return [w.format(_strange(rng, 1)[0].capitalize() + end) for w in wordings for end in ends for _ in range(2)]


@functools.cache
def _real_words() -> frozenset[str]:
    """The words of names, notices and wordings, and those that several of the other paragraphs share and no plain text has. What only plain texts
    hold, or what one paragraph is about (a herd, a campus), says nothing of licences."""
    names = [n for ns in (*NAMES.values(), OTHER_NAMES) for n in ns]
    notices = [n for of in NOTICES.values() for n in of]
    others, plain = [w for t in OTHERS for w in set(words_of(t))], {w for t in PLAIN for w in words_of(t)}
    return frozenset(w for t in (*names, *notices, *WORDINGS) for w in words_of(t)) | {w for w in others if others.count(w) > 1 and w not in plain}


def wrapped(notice: str, words: int = 9) -> list[str]:
    """Lines that a long notice may be broken into."""
    every = notice.split()
    return [" ".join(every[k : k + words]) for k in range(0, len(every) - words // 2, words // 3)] if len(every) > words else []


def training_texts(skip_wordings: tuple[int, ...] = (), skip_others: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(text, class) of all texts but those with the wordings or other names left out."""
    wordings = [w for k, w in enumerate(WORDINGS) if k not in skip_wordings]
    out = [(w.format(n), k) for k, f in enumerate(NOTICES) for w in wordings for n in NAMES[f]]
    out += [(t, k) for k, f in enumerate(NOTICES) for notice in NOTICES[f] for t in [notice] * 8 + 2 * wrapped(notice)]
    unknown, none = CLASSES.index(UNKNOWN), CLASSES.index(NONE)
    out += [(w.format(n), unknown) for w in wordings for n in OTHER_NAMES if n not in skip_others]
    out += [(t, unknown) for t in nameless(wordings)]
    out += [(t, none) for t in everyday(sorted({w for ns in (*NAMES.values(), OTHER_NAMES) for n in ns for w in words_of(n) if len(w) <= 3 and not w.isdigit()}))]
    return out + [(t, unknown) for t in OTHERS for _ in range(8)] + [(t, none) for t in PLAIN for _ in range(8)]


def _disturbed(rng: np.random.Generator, text: str) -> list[str]:
    """The words of a text, some lost, some strange ones around."""
    words = [w for w in words_of(text) if rng.random() > 0.1]
    strange = _strange(rng, int(rng.integers(0, 5)))
    cut = int(rng.integers(0, len(strange) + 1))
    return strange[:cut] + words + strange[cut:]


def _full(gram: str) -> list[str]:
    """The words of a gram that mean something."""
    return [w for w in gram.split() if w not in FUNCTION_WORDS and not w.isdigit()]


class Model:
    """Features (gram to weights per class), bias, temperature, and the words that speak for a licence."""

    def __init__(self):
        #: A paragraph without a gram gives ``none`` more than half, at any temperature up to 1.
        self.bias = np.zeros(len(CLASSES))
        self.bias[CLASSES.index(NONE)] = np.log(len(CLASSES)) + 0.1
        held_wordings, held_names = (3, 8, 11, 13), tuple(OTHER_NAMES[4::6])
        inside = set(training_texts(held_wordings, held_names))
        self._fit(sorted(inside))
        held = [x for x in training_texts() if x not in inside]
        z, y = self._scores(held), np.eye(len(CLASSES))[[k for _, k in held]]
        loss = {t: -np.log((self._softmax(z / t) * y).sum(axis=1) + 1e-12).mean() for t in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)}
        self.temperature = min(loss, key=loss.get)
        self.held_out_accuracy = float((z.argmax(axis=1) == y.argmax(axis=1)).mean())
        self._fit(training_texts())
        self._find_cues()

    def _fit(self, texts: list[tuple[str, int]]) -> None:
        """Fit to all grams that ``SHARED`` texts have in common, then again to those whose weight came out as ``SMALLEST`` or more.
        Only words of the texts above make features; made-up ones do not."""
        rng = np.random.default_rng(SEED)
        rows = [(grams_of(words_of(t)), k) for t, k in texts] + [(grams_of(_disturbed(rng, t)), k) for t, k in texts for _ in range(COPIES)]
        real, seen = _real_words(), {}
        for grams, _ in rows:
            for g in grams:
                if real.issuperset(g.split()):
                    seen[g] = seen.get(g, 0) + 1
        y = np.eye(len(CLASSES), dtype=np.float32)[[k for _, k in rows]]
        weight = (y @ (1 / np.maximum(y.sum(axis=0), 1)) ** 0.5)[:, None]
        weight /= weight.mean()
        names = sorted(g for g in seen if seen[g] >= SHARED and _full(g))
        for _ in range(2):
            self.column = {g: i for i, g in enumerate(names)}
            x = self._matrix([g for g, _ in rows])
            self.w = np.zeros((len(names), len(CLASSES)), np.float32)
            mean, square = np.zeros_like(self.w), np.zeros_like(self.w)
            for k in range(1, STEPS + 1):
                slope = x.T @ ((self._softmax(x @ self.w + self.bias.astype(np.float32)) - y) * weight) / len(x) + PENALTY * self.w
                mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
                self.w -= RATE * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
            large = np.abs(self.w).max(axis=1) >= SMALLEST
            names = [g for g, use in zip(names, large.tolist(), strict=True) if use]

    def _matrix(self, grams: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(grams), len(self.column)), np.float32)
        for i, of in enumerate(grams):
            x[i, [self.column[g] for g in of if g in self.column]] = 1
        return x

    def _scores(self, texts: list[tuple[str, int]]) -> np.ndarray:
        return self._matrix([grams_of(words_of(t)) for t, _ in texts]) @ self.w + self.bias

    def _find_cues(self) -> None:
        """Of every gram that favours some class over ``none``, the word that plain text holds least."""
        none, common = CLASSES.index(NONE), {}
        for word in (w for t in PLAIN for w in set(words_of(t))):
            common[word] = common.get(word, 0) + 1
        gain = (np.delete(self.w, none, axis=1) - self.w[:, [none]]).max(axis=1)
        speaks = [g for g, i in self.column.items() if gain[i] > 0]
        self.cues = sorted({min(_full(g), key=lambda w: (common.get(w, 0), -gain[self.column[w]] if w in self.column else 0, w)) for g in speaks})
        self.weights = {g: [round(float(v), 4) for v in self.w[i]] for g, i in self.column.items()}
        self.bias = [round(float(v), 4) for v in self.bias]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


@functools.cache
def model() -> Model:
    return Model()


def one_of(words: list[str]) -> str:
    """A pattern for any of the words, branching letter by letter so that a word is refused after a letter or two."""
    tree: dict = {}
    for word in words:
        at = tree
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = {}

    def written(at: dict) -> str:
        ends = "" in at
        parts = [letter + written(at[letter]) for letter in sorted(at) if letter]
        if not parts:
            return ""
        whole = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
        return whole + ("?" if ends else "")

    return written(tree)


def _array(values: list) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _let(value: Column, use) -> Column:
    """``use(value)``, the value computed once."""
    return F.transform(F.array(value), use)[0]


def _pairs(words: Column, other: Column) -> Column:
    """``words`` joined with ``other``, which starts one word later."""
    both = F.zip_with(words, other, lambda a, b: F.when(b.isNotNull() & a.isNotNull(), F.concat_ws(" ", a, b)))
    return F.filter(both, lambda x: x.isNotNull())


def _tail(words: Column, k: int) -> Column:
    return F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0)))


def _constant(value: list | dict, kind: str) -> Column:
    """A literal of any depth; Spark folds it once."""
    return F.from_json(F.lit(json.dumps({"is": value})), f"struct<is:{kind}>")["is"]


#: Parts the weights are dealt into by CRC-32, so that a gram is compared with few others.
PARTS = 512


def _judged(text: Column, of: Model) -> Column:
    """struct(family, probability, coverage, none) of a paragraph."""
    dealt: list[dict] = [{} for _ in range(PARTS)]
    for gram, weights in of.weights.items():
        dealt[zlib.crc32(gram.encode()) % PARTS][gram] = weights
    table = _constant(dealt, "array<map<string,array<double>>>")
    patterns = _constant([sorted({tuple(sorted(pairs_of(words_of(t)))) for t in templates(f)}) for f in NOTICES], "array<array<array<string>>>")

    def add(total: Column, gram: Column) -> Column:
        found = F.try_element_at(table[(F.crc32(gram.cast("binary")) % PARTS).cast("int")], gram)
        return _let(found, lambda w: F.when(w.isNull(), total).otherwise(F.zip_with(total, w, lambda a, b: a + b)))

    def score(words: Column) -> Column:
        def with_pairs(two: Column) -> Column:
            grams = F.array_distinct(F.concat(words, two, _pairs(two, _tail(words, 2))))
            return _let(F.aggregate(grams, _array(of.bias), add), lambda z: classified(z, F.when(F.size(words) > 1, F.array_distinct(two)).otherwise(words)))

        return _let(_pairs(words, _tail(words, 1)), with_pairs)

    def classified(z: Column, own: Column) -> Column:
        powers = F.transform(z, lambda v: F.exp((v - F.array_max(z)) / F.lit(float(of.temperature))))
        return _let(powers, lambda e: _let(F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)), lambda p: named(p, own)))

    def named(p: Column, own: Column) -> Column:
        some = F.slice(p, 1, len(FAMILIES))
        best, none = F.array_max(some), p[len(FAMILIES)] >= 0.5
        at = F.array_position(some, best).cast("int")
        share = lambda t: F.size(F.array_intersect(own, t)) / F.least(F.size(own), F.size(t))
        cover = F.when(none | (at > len(NOTICES)), 0.0).otherwise(F.aggregate(F.element_at(patterns, F.least(at, F.lit(len(NOTICES)))), F.lit(0.0), lambda m, t: F.greatest(m, share(t))))
        return _let(cover, lambda c: F.struct(F.when((best >= LEAST) & (c >= COVER) & ~text.rlike(DENIED), F.element_at(_array(FAMILIES), at)).otherwise(UNKNOWN).alias("family"), F.round(best, 6).alias("probability"), F.round(c, 6).alias("coverage"), none.alias("none")))

    return _let(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), score)


def names_in(text: Column) -> Column:
    """The families that a text calls by one of their names; names in capitals must be in capitals."""

    def pattern(name: str) -> str:
        words = r"[^A-Za-z0-9]+".join(re.findall("[A-Za-z0-9]+", name))
        return f"(?:{'' if name.upper() == name else '(?i)'}(?<![A-Za-z0-9]){words}(?![A-Za-z0-9]))"

    named = [F.when(text.rlike("|".join(map(pattern, names))), F.lit(family)) for family, names in NAMES.items()]
    return F.array_compact(F.array(*named))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per reported paragraph: id, paragraph (line from 0), family, probability, coverage, and ``also``, other families that the line names
    (a line under two licences)."""
    of = model()
    cue = r"(?i)(?<![a-z0-9])" + one_of(of.cues) + r"(?![a-z0-9])"
    some = storage.spread(docs.select(id_col, text_col)).where(F.col(text_col).rlike(cue))
    lines = F.transform(F.split(text_col, "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    held = some.select(F.col(id_col).cast("long").alias("id"), F.filter(lines, lambda x: x["line"].rlike(cue)).alias("lines"))
    alone = held.select("id", F.transform("lines", lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"), _judged(x["line"], of).alias("own"))).alias("lines"))
    alone = alone.select("id", F.filter("lines", lambda x: ~x["own"]["none"]).alias("lines"))

    def around(x: Column, k: Column) -> Column:
        """``x`` and the unnamed lines near it, as one text; null if there are none."""
        first = F.greatest(k - CONTEXT, F.lit(0))
        near = F.filter(F.slice(F.col("lines"), first + 1, k - first + 1 + CONTEXT), lambda y: (F.abs(y["i"] - x["i"]) <= CONTEXT) & (y["own"]["family"] == UNKNOWN))
        return F.when((x["own"]["family"] == UNKNOWN) & (F.size(near) > 1), F.array_join(F.transform(near, lambda y: y["line"]), " "))

    def final(x: Column, k: Column) -> Column:
        return _let(around(x, k), lambda text: F.struct(x["i"].alias("i"), x["line"].alias("line"), x["own"].alias("own"), F.when(text.isNotNull(), _judged(text, of)).alias("both")))

    each = alone.select("id", F.explode(F.transform("lines", final)).alias("x"))
    said = F.when(F.col("x.both.family") != UNKNOWN, F.col("x.both")).otherwise(F.col("x.own"))
    return each.select(F.col("id").alias(id_col), F.col("x.i").alias("paragraph"), said["family"].alias("family"), said["probability"].alias("probability"), said["coverage"].alias("coverage"), F.array_remove(names_in(F.col("x.line")), said["family"]).alias("also"))
