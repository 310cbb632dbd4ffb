"""Training data and training of the licence classifier: logistic regression on word n-grams, made on the driver.

The data are short templates, each expanded over its slots; nothing is read from a corpus. Features are
the n-grams of one to three words that hold an anchor word, so a paragraph without one has no feature and
is of the unknown class by the model's own bias.
"""

from __future__ import annotations

import itertools
import random
import re
from functools import lru_cache

import numpy as np

UNKNOWN = "unknown"
NGRAM = 3

# Words at least one of which stands in every feature.
ANCHORS = (
    "license licensed licensing licence licenced licences licenses sublicense gnu gpl lgpl agpl affero apache bsd mozilla mpl isc unlicense unencumbered "
    "creative commons cc cc0 copyright copyrighted copyleft permission permissions redistribution redistribute redistributed warranty warranties "
    "merchantability noninfringement noncommercial attribution sharealike noderivatives rights reserved software source spdx contributors dedication"
).split()

# Opening phrases and notices of licence families; {a|b} is a slot.
TEMPLATES = {
    "MIT": [
        "{released|licensed|distributed|available|published} under the mit license",
        "{this|the} {project|software|work|code|file|library} is {licensed|released|available|distributed} under the {mit license|terms of the mit license|mit licence}",
        "{mit license|the mit license}",
        "mit license copyright c",
        "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "Apache-2.0": [
        "licensed under the apache license version 2 0",
        "{this|the} {project|software|work|code|file|library} is {licensed|released|available|distributed} under the {apache license version 2 0|apache license 2 0|apache 2 0 license}",
        "{released|distributed|available|published} under the {apache license version 2 0|apache license 2 0|apache 2 0 license}",
        "apache license {version 2 0|version 2 0 january 2004}",
        "spdx license identifier apache 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
    ],
    "GPL": [
        "{this|the} {work|program|software|project|code|file|library} is {licensed|released|distributed|available} under the {gnu general public license|gnu gpl|gpl} {version 2|version 3|v2|v3}",
        "{released|licensed|distributed|published} under the {gnu general public license|gnu gpl|gpl} {version 2|version 3|v2|v3}",
        "spdx license identifier gpl {2|3} 0 {only|or later}",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {2|3} of the license or at your option any later version",
        "you should have received a copy of the gnu general public license along with this program",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ],
    "LGPL": [
        "{this|the} {work|program|software|project|code|file|library} is {licensed|released|distributed|available} under the {gnu lesser general public license|gnu lgpl|lgpl} {version 2 1|version 3|v2 1|v3}",
        "{released|licensed|distributed|published} under the {gnu lesser general public license|gnu lgpl|lgpl} {version 2 1|version 3|v2 1|v3}",
        "spdx license identifier lgpl {2 1|3 0} {only|or later}",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    ],
    "AGPL": [
        "{this|the} {work|program|software|project|code|file|library} is {licensed|released|distributed|available} under the {gnu affero general public license|gnu agpl|agpl} {version 3|v3}",
        "{released|licensed|distributed|published} under the {gnu affero general public license|gnu agpl|agpl} {version 3|v3}",
        "spdx license identifier agpl 3 0 {only|or later}",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    ],
    "BSD": [
        "{this|the} {work|program|software|project|code|file|library} is {licensed|released|distributed|available} under the {bsd license|bsd 2 clause license|bsd 3 clause license|new bsd license|simplified bsd license}",
        "{released|licensed|distributed|published} under the {bsd license|bsd 2 clause license|bsd 3 clause license|new bsd license|simplified bsd license}",
        "spdx license identifier bsd {2|3} clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "MPL-2.0": [
        "{this|the} {work|program|software|project|code|file|library} is {licensed|released|distributed|available} under the {mozilla public license|mpl} {version 2 0|2 0|v 2 0}",
        "{released|licensed|distributed|published} under the {mozilla public license|mpl} {version 2 0|2 0|v 2 0}",
        "spdx license identifier mpl 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ],
    "ISC": [
        "{this|the} {work|program|software|project|code|file|library} is {licensed|released|distributed|available} under the isc license",
        "{released|licensed|distributed|published} under the isc license",
        "spdx license identifier isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "CC-BY": [
        "{licensed|released|published|available} under {cc by|a creative commons attribution|the creative commons attribution} {4 0|3 0|4 0 international} license",
        "licensed under cc by {4 0|3 0|2 0}",
        "this {work|document|text|article|page|image} is licensed under a creative commons attribution {4 0|3 0} {international|unported} license",
    ],
    "CC-BY-SA": [
        "{licensed|released|published|available} under {cc by sa|a creative commons attribution sharealike|the creative commons attribution share alike} {4 0|3 0|4 0 international} license",
        "licensed under cc by sa {4 0|3 0|2 0}",
        "this {work|document|text|article|page|image} is licensed under a creative commons attribution sharealike {4 0|3 0} {international|unported} license",
    ],
    "CC-BY-NC": [
        "{licensed|released|published|available} under {cc by nc|a creative commons attribution noncommercial|the creative commons attribution non commercial} {4 0|3 0|4 0 international} license",
        "licensed under cc by nc {4 0|3 0|2 0}",
        "licensed under cc by nc {sa|nd} {4 0|3 0|2 0}",
        "this {work|document|text|article|page|image} is licensed under a creative commons attribution noncommercial {4 0|3 0} {international|unported} license",
    ],
    "CC-BY-ND": [
        "licensed under cc by nd {4 0|3 0|2 0}",
        "this {work|document|text|article|page|image} is licensed under a creative commons attribution noderivatives {4 0|3 0} {international|unported} license",
    ],
    "CC0": [
        "{released|published|dedicated|licensed} under {cc0|cc0 1 0|creative commons zero|the cc0 1 0 universal license}",
        "this {work|document|software|text} has been dedicated to the public domain under cc0 1 0 universal public domain dedication",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this {work|document|software|text}",
    ],
    "Unlicense": [
        "this is free and unencumbered software released into the public domain",
        "{released|licensed|distributed} under the unlicense",
    ],
    "All-Rights-Reserved": [
        "copyright c {the author|the company|its owner} all rights reserved",
        "all rights reserved no part of this {publication|work|book|document} may be reproduced without prior written permission",
        "all rights reserved unauthorized copying is prohibited",
    ],
}

# What tells families apart whose notices share nearly all words.
NAMES = {"GPL": r"\bgpl\b|gnu general", "LGPL": r"lgpl|lesser", "AGPL": r"agpl|affero"}

# Prose that holds anchor words but no licence.
OTHER = [
    "you need a driving {license|licence} to rent a car here",
    "the {fishing|marriage|taxi|hunting|software|liquor} license {expired|was renewed|costs forty euros} last year",
    "she asked for permission to leave the {room|building|source}",
    "the software {update|team|engineer|company} {fixed|wrote|shipped|sold} the source code",
    "a creative {writer|idea|mind} and a commons for the village",
    "{human|civil|voting|animal} rights {groups|lawyers|laws} won",
    "the {copyright|license} lawyer explained the law to the {class|court}",
    "the table is reserved and the source of the noise is unknown",
    "the {apache|bsd|mozilla} {helicopter|people|server|history|foundation} was described in the {book|article}",
    "the warranty covers {two|three} years of {repairs|service}",
    "{many|several} contributors sent {letters|recipes} to the {paper|magazine}",
    "the attribution of the {painting|quote} to him is in doubt",
    "{general|public|new} software and source and license and rights and copyright and permission",
    "redistribution of {wealth|land|income} was debated",
    "a dedication ceremony for the {library|bridge}",
]


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def expanded(template: str, most: int, draw: random.Random) -> list[str]:
    parts = [p.split("|") for p in re.split(r"[{}]", template)]
    every = ["".join(x) for x in itertools.islice(itertools.product(*parts), 4000)]
    return draw.sample(every, most) if len(every) > most else every


def ngrams(words: list[str], anchors: frozenset[str] = frozenset(ANCHORS)) -> set[str]:
    """The n-grams of 1 to NGRAM words that hold an anchor."""
    return {" ".join(words[i : i + n]) for n in range(1, NGRAM + 1) for i in range(len(words) - n + 1) if not anchors.isdisjoint(words[i : i + n])}


class LicenseModel:
    """classes, weights (n-gram -> one weight for each class), bias, word pairs of each family's templates, the words of the longest template, and the temperature's inverse."""

    def __init__(self, classes, weights, bias, references, longest, scale):
        self.classes, self.weights, self.bias, self.references, self.longest, self.scale = classes, weights, bias, references, longest, scale

    def own_pairs(self, family: str) -> set[str]:
        """Word pairs that stand in templates of this family only (of a family with NAMES those that name it)."""
        others = {p for name, texts in self.references.items() if name != family for t in texts for p in t}
        return {p for t in self.references[family] for p in t if p not in others and re.search(NAMES.get(family, ""), p)}


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax regression, by gradient descent from zero."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    for _ in range(rounds):
        error = (softmax(x @ w + b) - y) * weight[:, None] / len(x)
        w -= rate * (x.T @ error * 8 + decay * w)
        b -= rate * error.sum(axis=0) * 8
    return w, b


@lru_cache(1)
def trained(most: int = 60, rounds: int = 400, rate: float = 0.5, decay: float = 2e-4, folds: int = 5) -> LicenseModel:
    """Softmax regression on all templates; a temperature calibrates its probabilities.

    The temperature is fitted on what models that have not seen a template, in any of its expansions, say of it.
    """
    draw = random.Random(11)
    classes = [*TEMPLATES, UNKNOWN]
    rows: list[tuple[list[str], int, int]] = []  # words, class, template
    for k, name in enumerate(TEMPLATES):
        for template in TEMPLATES[name]:
            made, at = [words_of(x) for x in expanded(template, most, draw)], len(rows)
            rows += [(w, k, at) for w in made]
            # parts of long notices, as broken lines show them
            rows += [(w[: max(6, len(w) * 2 // 3)], k, at) for w in made if len(w) > 14] * 2
    for template in OTHER:
        made, at = [words_of(x) for x in expanded(template, most, draw)], len(rows)
        rows += [(w, len(TEMPLATES), at) for w in made]
        rows += [([x], len(TEMPLATES), at) for x in sorted({x for w in made for x in w})]
    plain = [[], *([a] for a in ANCHORS if a not in ("gpl", "lgpl", "agpl", "unlicense", "cc0"))]
    rows += [(w, len(TEMPLATES), len(rows) + i) for i, w in enumerate(plain) for _ in range(6 if w else 200)]
    names = sorted(set().union(*(ngrams(w) for w, _, _ in rows)))
    place = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for r, (w, _, _) in enumerate(rows):
        x[r, [place[g] for g in ngrams(w)]] = 1
    y = np.eye(len(classes), dtype=np.float32)[[k for _, k, _ in rows]]
    # each class weighs the same, and in it each template
    which = np.array([t for _, _, t in rows])
    of_class = {k: len({t for _, c, t in rows if c == k}) for k in range(len(classes))}
    times = {t: int(n) for t, n in zip(*np.unique(which, return_counts=True), strict=True)}
    weight = np.array([1 / (of_class[k] * times[t]) for _, k, t in rows], np.float32)
    weight *= len(rows) / weight.sum()

    order = sorted(times)
    draw.shuffle(order)
    fold = {t: i % folds for i, t in enumerate(order)}
    of_row = np.array([fold[t] for t in which])
    logits = np.zeros_like(y)
    for f in range(folds):
        out = of_row == f
        w, b = fitted(x[~out], y[~out], weight[~out], rounds, rate, decay)
        logits[out] = x[out] @ w + b
    scales = np.linspace(0.25, 4, 76)
    loss = [-(weight * np.log((softmax(logits * s) * y).sum(axis=1) + 1e-9)).sum() for s in scales]
    scale = float(scales[int(np.argmin(loss))])
    w, b = fitted(x, y, weight, rounds, rate, decay)
    strong = np.flatnonzero(np.abs(w).max(axis=1) > 0.02)
    weights = {names[i]: [float(v) for v in w[i] * scale] for i in strong}
    references, longest = {}, 0
    for name in TEMPLATES:
        texts = {tuple(words_of(t)) for template in TEMPLATES[name] for t in expanded(template, 4000, draw)}
        longest = max(longest, *map(len, texts))
        references[name] = [sorted({f"{a} {c}" for a, c in itertools.pairwise(t)}) for t in sorted(texts)]
    return LicenseModel(classes, weights, [float(v) for v in b * scale], references, longest, scale)
