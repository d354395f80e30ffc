"""Licence scan: a trained paragraph classifier, confirmed against templates.

A line is cut into sentences; word n-grams (one and two words) that the training text holds are
its sparse features.  One multinomial logistic regression, fitted by Spark ML, tells the licence
families, other licences (``unknown``) and ``none`` apart.  Evidence is additive, so neighbouring
sentences are parted into stretches of one label each, the best partition of all, and a stretch into
paragraphs: the lines of a wrapped text that go on with a template are one, and a notice beside
another is one of its own.  A paragraph is judged as a whole.  Probabilities are calibrated by a temperature on held-out
examples, and so are the two levels above which a paragraph speaks of licences at all and is one
family's.  A family's paragraph must then be confirmed: it shares enough word pairs with one of
the family's templates.  Between the two levels, and unconfirmed, it is ``unknown``.

It is trained on templates, cut and noised by rule; on licence phrases with invented names
(``unknown``); and, as ``none``, on a few sentences that use the words in another sense and a
bounded sample of the corpus' own sentences: at most ``SAMPLE``, those of smallest hash, drawn from
documents of small hash, without those that share three words in a row with a template.

A sentence's scores are summed only if the sum of its n-grams' largest advantages over ``none`` leaves
another label a chance; the bound is exact, so it changes no result.

Cases: null or empty text has no paragraph; repeated rows are scanned one by one; an empty table
gives an empty result; very long lines are scanned whole; signs other than letters and digits part
words; extra columns are ignored.
"""

from __future__ import annotations

import functools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only
from .words import chunks, mixed, word_hashes

#: Paragraphs by which the families are named or granted.
TEMPLATES = {
    "mit": (
        "MIT License",
        "The MIT License (MIT)",
        "Distributed under the terms of the MIT License.",
        "This software is available under the MIT license.",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "apache-2.0": (
        "Apache License, Version 2.0",
        "Distributed under the terms of the Apache License 2.0.",
        "The code is available under the Apache 2.0 license.",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "BSD License",
        "BSD 3-Clause License",
        "Licensed under the BSD license.",
        "The code is available under the BSD 2-Clause License.",
        "Distributed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "GNU General Public License v3.0",
        "Licensed under GPLv3.",
        "The code is available under GPL version 3.",
        "Distributed under the terms of the GNU GPL, version 2 or later.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mpl-2.0": (
        "Mozilla Public License Version 2.0",
        "Distributed under the terms of the MPL 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright, all rights reserved. No part of this work may be reproduced without the written permission of the publisher.",
    ),
}
#: Phrases of other licences, to be filled with invented names.
OTHERS = (
    "Released under the {} License.",
    "Licensed under the {} license, version 3.",
    "Licensed under the {} Public License.",
    "Distributed under the terms of the {} licence.",
    "This work is licensed under {}.",
    "Subject to the {} licence of 1990.",
    "Use of this work is governed by the {} licence agreement.",
    "You may copy and share this work under the terms of the {} agreement.",
    "Permission to copy this document is granted under the {} licence.",
    "SPDX-License-Identifier: {}",
)
#: Ordinary sentences, some with the words in another sense.
OTHER_SENSE = (
    "He renewed his driving licence last week.",
    "The licence fee for television rose again.",
    "The shop lost its licence to sell spirits.",
    "She licensed the design to a maker of chairs.",
    "The museum holds the copyright in the painting.",
    "The road runs through public domain land by the river.",
    "All seats are reserved for members and the rights of way are marked.",
    "A fishing permission was granted to the village in that year.",
    "He went to any of the shops that were open in the town.",
    "They have to be at the station in time for it, or without it.",
    "This is one of the books that was given to her by the school.",
    "It may be that some of them will not come without a letter.",
    "In the morning the rain stopped and all of us went out into the garden.",
    "You can see the sea from the top of the hill or from the road to this place.",
    "Some of these are to be found in any part of the north, as well as in other parts.",
    "She used to publish and sell copies of the letters of a person that she knew.",
)
NONE, UNKNOWN = "none", "unknown"
LABELS = (NONE, UNKNOWN, *TEMPLATES)
SAMPLE, COPIES, SEED = 4000, 12, 7
#: A word n-gram of the sample is a feature from so many sentences.
SEEN = 3
#: Share of a template's word pairs in a paragraph, or of a paragraph's (at least so many) in a template.
CONFIRMED, LEAST_PAIRS = 0.6, 4
#: A sentence is another paragraph's if another licence explains it and this one explains it by less than so much of that.
APART = 0.5
#: What each further sentence of a paragraph must add at least.
JOINED = 2.5
#: Wrong predictions among held-out ones: of a family, and of a licence in ordinary text.
WRONG_FAMILY, WRONG_LICENCE = 0.01, 0.001

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Sentences and n-gram hashes of some texts.

    Of each sentence: its text, line (blank ones not counted), block (lines without a blank one between),
    first and last byte.  Of each n-gram: its sentence and hash; a pair belongs to its second word.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        n = len(data)
        newline = np.zeros(n + 1, dtype=bool)
        newline[:n] = data == 10
        after = np.append(np.append(data, 10)[1:], 10)[: n + 1]
        stop = np.zeros(n + 1, dtype=bool)
        stop[:n] = ((data == 46) | (data == 33) | (data == 63)) & ((after[:n] == 32) | (after[:n] == 10))
        begin_text = np.zeros(n + 1, dtype=bool)
        begin_text[np.append(0, ends[:-1])] = True
        inside = _INSIDE[data]
        odd = np.flatnonzero((data[:-1] == 0xE2) & (data[1:] == 0x80)) if n else np.zeros(0, dtype=np.int64)
        for k in range(3):  # dashes, quotes and blanks of U+2000 to U+203F
            inside[odd[odd + k < n] + k] = False
        begin, end, h = word_hashes(data, inside, begin_text)
        # Places where a sentence or a line ends, counted up to each word.
        lines, stops = np.cumsum(newline), np.cumsum(stop)
        text_of = np.searchsorted(ends, begin, side="right")
        line_of = lines[begin] + text_of
        key = np.column_stack([text_of, line_of, stops[begin] + lines[begin]])
        new = np.append(True, (key[1:] != key[:-1]).any(axis=1)) if len(h) else np.zeros(0, dtype=bool)
        sentence = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.text, raw_line = text_of[first], line_of[first]
        new_line = np.append(True, raw_line[1:] != raw_line[:-1]) if len(first) else new
        at_text = np.append(True, self.text[1:] != self.text[:-1]) if len(first) else new
        self.block = np.cumsum(at_text | np.append(True, np.diff(raw_line) > 1)) if len(first) else new
        count = np.cumsum(new_line)
        self.line = count - count[at_text][np.cumsum(at_text) - 1] if len(first) else count
        self.begin, self.end = begin[first], np.append(end[first[1:] - 1], end[-1:]) if len(first) else first
        pair = np.flatnonzero(self.block[sentence[1:]] == self.block[sentence[:-1]]) + 1 if len(h) else np.zeros(0, dtype=np.int64)
        self.hashes = np.concatenate([h, mixed(h[pair - 1] * _PAIR + h[pair])])
        self.owner = np.concatenate([sentence, sentence[pair]])

    def __len__(self) -> int:
        return len(self.text)

    def words(self, data: np.ndarray, first: int, last: int) -> str:
        """The text from the first to the last sentence."""
        return data[self.begin[first] : self.end[last]].tobytes().decode("utf-8", "replace")

    @classmethod
    def of(cls, texts: list[str]) -> Grams:
        """All texts at once, for training."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        return cls(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([len(r) for r in raw]))


class Vocabulary:
    """Places of known 64-bit hashes in an open table; unknown ones get the last place."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        size = 1 << max(4, int(4 * len(self.hashes) + 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.places = np.zeros(size, dtype=np.uint64), np.full(size, len(self.hashes), dtype=np.int32)
        rest = np.arange(len(self.hashes))
        self.steps = 0
        slot = self.hashes & self.mask
        while len(rest):
            free = self.places[slot[rest]] == len(self.hashes)
            taken, which = np.unique(slot[rest][free], return_index=True)
            put = rest[free][which]
            self.keys[taken], self.places[taken] = self.hashes[put], put
            rest = np.setdiff1d(rest, put)
            slot[rest] = (slot[rest] + np.uint64(1)) & self.mask
            self.steps += 1

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & self.mask
        out = np.where(self.keys[slot] == hashes, self.places[slot], len(self.hashes))
        for _ in range(self.steps):
            # A used slot with another key: the hash may stand further on.
            more = np.flatnonzero((out == len(self.hashes)) & (self.places[slot] < len(self.hashes)))
            if not len(more):
                break
            slot[more] = (slot[more] + np.uint64(1)) & self.mask
            at = slot[more]
            out[more] = np.where(self.keys[at] == hashes[more], self.places[at], len(self.hashes))
        return out


def pairs_of(text: str) -> frozenset:
    """Word pairs of a text; the word alone of a single one."""
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return frozenset(zip(words, words[1:])) or frozenset(words)


_TEMPLATE_PAIRS = {f: [pairs_of(t) for t in ts] for f, ts in TEMPLATES.items()}


@functools.lru_cache(4096)
def likeness(family: str, paragraph: str) -> float:
    """The largest share of a template's word pairs in the paragraph, or of the paragraph's in a template."""
    own = pairs_of(paragraph)
    shares = [0.0]
    for pairs in _TEMPLATE_PAIRS[family]:
        both = len(own & pairs)
        shares.append(max(both / len(pairs), both / len(own) if len(own) >= LEAST_PAIRS else 0.0))
    return max(shares)


def continues(family: str, before: str, longer: str) -> bool:
    """Whether what is added to a paragraph goes on with one of the templates."""
    added = pairs_of(longer) - pairs_of(before)
    return any(2 * len(added & pairs) > len(added) for pairs in _TEMPLATE_PAIRS[family])


class Scanner:
    """vocabulary, weights (n-grams x labels), bias, temperature, and the two calibrated levels."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least_licence: float = 0.5, least_family: float = 0.5):
        self.known = Vocabulary(hashes)
        self.weights = np.vstack([weights, np.zeros((1, len(LABELS)))]).astype(np.float32)
        self.held_out: dict[str, tuple[int, float, float]] = {}  # of the training's held-out examples, by label
        self.bias, self.temperature, self.least_licence, self.least_family = bias, temperature, least_licence, least_family
        self.most = (self.weights[:, 1:] - self.weights[:, :1]).max(axis=1).astype(np.float64)
        self.room = float((bias[1:] - bias[0]).max())

    def parts(self) -> tuple:
        return self.known.hashes, self.weights[:-1], self.bias, self.temperature, self.least_licence, self.least_family

    def evidence(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """(sentences, their sums of weights) of all sentences that may speak for a licence."""
        place = self.known(grams.hashes)
        known = np.flatnonzero(place < len(self.known.hashes))
        # Each n-gram of a sentence counts once.
        each = np.unique(grams.owner[known] << 32 | place[known])
        owner, place = each >> 32, each & 0xFFFFFFFF
        bound = np.bincount(owner, weights=self.most[place], minlength=len(grams))
        chosen = np.flatnonzero(bound > min(0.0, -self.room))
        fine = np.zeros(len(grams), dtype=bool)
        fine[chosen] = True
        held = fine[owner]
        owner, place = owner[held], place[held]
        sums = np.zeros((len(chosen), len(LABELS)))
        if len(owner):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sums[np.searchsorted(chosen, owner[starts])] = np.add.reduceat(self.weights[place], starts, axis=0)
        return chosen, sums

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        x = (sums + self.bias) / self.temperature
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def stretches(self, sums: np.ndarray) -> list[tuple[int, int]]:
        """(first, last) of the best partition of neighbouring sentences into stretches of one label each.

        A stretch's worth is its sum of advantages over ``none``, less JOINED for each further sentence; sentences in
        no stretch are worth nothing.  The best partition is found in one pass over the sentences, with the best
        worth up to each sentence for each label that its stretch may have.  A stretch doesn't reach over a sentence
        that another licence explains much better.
        """
        gain = sums[:, 1:] - sums[:, :1]
        top = gain.max(axis=1, keepdims=True)
        gain = np.where((top > JOINED) & (gain > 0) & (gain < APART * top), -np.inf, gain)
        start = self.bias[1:] - self.bias[0]
        worth = np.full(gain.shape[1], -np.inf)  # of partitions whose last stretch goes on, by its label
        first = np.zeros(gain.shape[1], dtype=np.int64)
        best, last = [0.0], [None]  # of partitions of the first k sentences: worth, and the stretch that ends there
        for k, g in enumerate(gain):
            begins = best[k] + start
            new = begins >= worth - JOINED
            worth = np.where(new, begins, worth - JOINED) + g
            first = np.where(new, k, first)
            c = int(worth.argmax())
            better = worth[c] > best[k]
            best.append(float(worth[c]) if better else best[k])
            last.append((int(first[c]), k) if better else None)
        out, k = [], len(gain)
        while k:
            if last[k] is None:
                k -= 1
            else:
                out.append(last[k])
                k = last[k][0]
        return out[::-1]

    def scan(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, str, float, float]]:
        """(text, first line, last line, family, probability, likeness) of the licence paragraphs."""
        grams = Grams(data, ends)
        chosen, sums = self.evidence(grams)
        if not len(chosen):
            return []
        out = []
        block = grams.block[chosen]
        for run in np.split(np.arange(len(chosen)), np.flatnonzero((np.diff(chosen) > 1) | (np.diff(block) > 0)) + 1):
            # No stretch exceeds the run's positive advantages.
            if np.maximum(sums[run, 1:] - sums[run, :1], 0).max(axis=1).sum() + self.room <= 0:
                continue
            found = [p for x, y in self.stretches(sums[run]) for p in self.paragraphs_of(grams, data, chosen[run[x]], sums[run[x : y + 1]])]
            for k, (a, b, family, p, alike) in enumerate(found):
                stop = found[k + 1][0] if k + 1 < len(found) else len(grams)
                while family != UNKNOWN and b + 1 < stop and grams.block[b + 1] == grams.block[b] and continues(family, grams.words(data, a, b), grams.words(data, a, b + 1)):
                    b += 1
                out.append((int(grams.text[a]), int(grams.line[a]), int(grams.line[b]), family, float(p[LABELS.index(family)]), alike))
        return out

    def paragraphs_of(self, grams: Grams, data: np.ndarray, a: int, sums: np.ndarray) -> list[tuple[int, int, str, np.ndarray, float]]:
        """(first, last, family, probabilities, likeness) of the paragraphs of a stretch that begins at sentence ``a``.

        A sentence that doesn't go on with a template of its paragraph begins the next one, so that repeated and
        neighbouring notices are judged one by one; a paragraph holds no more sentences than a template has word pairs.
        If no paragraph is confirmed, the stretch is one of an unknown licence.
        """
        whole = self.probabilities(sums.sum(axis=0)[None])[0]
        family = LABELS[1 + int(whole[1:].argmax())]
        cuts = [0]
        for k in range(1, len(sums)):
            if family != UNKNOWN and not continues(family, grams.words(data, a + cuts[-1], a + k - 1), grams.words(data, a + cuts[-1], a + k)):
                cuts.append(k)
        out = []
        for x, y in zip(cuts, [*cuts[1:], len(sums)]):
            p = self.probabilities(sums[x:y].sum(axis=0)[None])[0]
            if 1 - p[0] < self.least_licence:
                continue
            text = lambda i, y=y: grams.words(data, a + i, a + y - 1)
            kind, alike = self.decided(p, text(x))
            begin = x
            while kind != UNKNOWN and x + 1 < y and not continues(kind, text(x + 1), text(x)) and likeness(kind, text(x + 1)) >= alike:
                x += 1
            if x > begin:  # what was cut off is judged by itself
                out += self.paragraphs_of(grams, data, a + begin, sums[begin:x])
            out.append((a + x, a + y - 1, kind, p, alike))
        if all(f == UNKNOWN for _, _, f, _, _ in out):
            out = [(a, a + len(sums) - 1, UNKNOWN, whole, 0.0)] if 1 - whole[0] >= self.least_licence else []
        return out

    def decided(self, p: np.ndarray, text: str) -> tuple[str, float]:
        """The paragraph's family, with its likeness to a template; unknown unless sure and confirmed."""
        best = 2 + int(p[2:].argmax())
        if p[best] >= self.least_family * (1 - p[0]) and p[best] >= p[1]:
            alike = likeness(LABELS[best], text)
            if alike >= CONFIRMED:
                return LABELS[best], alike
        return UNKNOWN, 0.0


def _pieces(text: str, rng: random.Random) -> list[str]:
    """A template's paragraph, its stretches as lines of a wrapped text hold them, and both noised."""
    words = text.split()
    out = [text] * 3
    for _ in range(COPIES * (1 + len(words) // 16)):
        if len(words) > 8:
            n = rng.randrange(6, 15)
            a = rng.randrange(0, max(1, len(words) - n + 1))
            piece = words[a : a + n]
        else:
            piece = words
        out.append(" ".join([w for w in piece if rng.random() > 0.04] or piece))
    return out


def examples(drawn: list[str], rng: random.Random) -> list[tuple[int, str]]:
    """(label, text) of the training text; filler words and invented names come from the sample."""
    filler = [w for x in drawn[:400] for w in x.split()[:10]] or ["word"]
    invented = lambda: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))).capitalize()
    made = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            for piece in _pieces(text, rng):
                n = rng.choice((0, 0, 0, 2, 4))
                made.append((LABELS.index(family), " ".join([*[rng.choice(filler) for _ in range(n)], piece])))
    for phrase in OTHERS:
        made += [(1, phrase.format(" ".join(invented() for _ in range(rng.choice((1, 1, 2)))))) for _ in range(2 * COPIES)]
    made += [(0, x) for x in OTHER_SENSE for _ in range(COPIES)]
    return made + [(0, x) for x in drawn]


def sampled(documents: DataFrame, sample: int, seed: int) -> list[str]:
    """At most ``sample`` sentences of the corpus, without those that share three words in a row with a template.

    Different texts are drawn by a hash threshold, about ``sample`` of them, and give up to four sentences each, so what
    reaches the driver grows neither with the corpus nor with the copies of a text.
    """
    docs = documents.where(F.length("text") > 0)
    text_hash = F.xxhash64("text", F.lit(seed))
    n = docs.select(text_hash.alias("h")).distinct().count()
    share = min(1.0, sample / max(n, 1))
    small = (text_hash.cast("double") / 2.0**64 + 0.5) <= share
    cut = F.filter(F.split(F.regexp_replace("text", "([.!?]) ", "$1\n"), "\n"), lambda x: x.rlike("[A-Za-z0-9\\x{80}-\\x{10FFFF}]"))
    some = F.slice(F.array_sort(F.transform(cut, lambda x: F.struct(F.xxhash64(x, F.lit(seed)).alias("h"), x.alias("x")))), 1, 4)
    rows = docs.where(small).groupBy(text_hash.alias("t")).agg(F.min(some).alias("some")).select(F.inline("some")).collect()
    three = lambda w: set(zip(w, w[1:], w[2:]))
    words = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t).split()
    taken = set().union(*(three(words(t)) for ts in TEMPLATES.values() for t in ts))
    return [r.x for r in sorted(set(rows)) if taken.isdisjoint(three(words(r.x)))][:sample]


def _calibrated(scanner: Scanner, grams: Grams, text_label: np.ndarray) -> None:
    """Temperature by likelihood, then the levels, on held-out examples (a text each)."""
    sums = np.zeros((len(text_label), len(LABELS)))
    each = np.unique(np.column_stack([grams.text[grams.owner], scanner.known(grams.hashes)]), axis=0)
    np.add.at(sums, each[:, 0], scanner.weights[each[:, 1]])
    at = np.arange(len(text_label))

    def loss(t: float) -> float:
        scanner.temperature = t
        return float(-np.log(np.maximum(scanner.probabilities(sums)[at, text_label], 1e-12)).mean())

    scanner.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: (loss(t), t))
    p = scanner.probabilities(sums)
    ordinary = np.sort(1 - p[text_label == 0, 0])[::-1]
    allowed = int(WRONG_LICENCE * len(ordinary))
    scanner.least_licence = float(np.clip(np.nextafter(ordinary[allowed], 2) if len(ordinary) > allowed else 0.5, 0.5, 0.99))
    share = p[:, 2:].max(axis=1) / np.maximum(1 - p[:, 0], 1e-12)
    spoken = (1 - p[:, 0] >= scanner.least_licence) & (p[:, 2:].max(axis=1) >= p[:, 1])
    right = 2 + p[:, 2:].argmax(axis=1) == text_label
    order = np.flatnonzero(spoken)[np.argsort(-share[spoken], kind="stable")]
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= WRONG_FAMILY)
    scanner.least_family = float(np.clip(share[order][fine[-1]], 0.5, 0.95)) if len(fine) else 0.95


def measured(scanner: Scanner, labelled: list[tuple[int, str]]) -> dict[str, tuple[int, float, float]]:
    """Per label: examples, and the precision and recall of what the scanner says of them."""
    said = []
    for _, text in labelled:
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        families = {LABELS.index(f) for _, _, _, f, _, _ in scanner.scan(raw, np.array([len(raw)]))}
        said.append(families or {0})
    out = {}
    for c, name in enumerate(LABELS):
        own, given = sum(y == c for y, _ in labelled), sum(c in f for f in said)
        right = sum(y == c and c in f for (y, _), f in zip(labelled, said))
        out[name] = own, right / max(given, 1), right / max(own, 1)
    return out


def train(spark: SparkSession, documents: DataFrame, text_col: str = "text", sample: int = SAMPLE, seed: int = SEED) -> Scanner:
    """Fit on the examples, four fifths of them, and calibrate on the rest."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector

    drawn = sampled(only(documents, text=text_col), sample, seed)
    made = examples(drawn, random.Random(seed))
    fit, held = [x for k, x in enumerate(made) if k % 5 != 4], [x for k, x in enumerate(made) if k % 5 == 4]
    grams, label = Grams.of([x for _, x in fit]), np.array([y for y, _ in fit])
    owner = grams.text[grams.owner]
    each = np.unique(np.column_stack([grams.hashes, owner.astype(np.uint64)]), axis=0)
    hashes, times = np.unique(each[:, 0], return_counts=True)
    known = Vocabulary(hashes[times >= SEEN])
    place = known(grams.hashes)
    counts: list[dict[int, float]] = [{} for _ in fit]
    for d, p in zip(owner.tolist(), place.tolist()):
        if p < len(known.hashes):
            counts[d][p] = 1.0
    rows = [(float(y), SparseVector(len(known.hashes), c)) for y, c in zip(label.tolist(), counts)]
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60, standardization=False).fit(spark.createDataFrame(rows, ["label", "features"]).repartition(4))
    scanner = Scanner(known.hashes, model.coefficientMatrix.toArray().T, model.interceptVector.toArray())
    _calibrated(scanner, Grams.of([x for _, x in held]), np.array([y for y, _ in held]))
    scanner.held_out = measured(scanner, held)
    return scanner


def _scans(batches, sent):
    """(batch, (text, first line, last line, family, probability, likeness)...) of each batch."""
    own = Scanner(*sent.value)
    for batch in batches:
        found = []
        for part, data, ends in chunks(batch.column(1)):
            found += [(part.start + x[0], *x[1:]) for x in own.scan(data, ends)]
        yield batch, found


def _sent(documents: DataFrame, scanner: Scanner):
    return documents.sparkSession.sparkContext.broadcast(scanner.parts())  # some thousand n-grams, whatever the corpus' size


def paragraphs(documents: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_line, last_line, family, probability, likeness of every licence paragraph; blank lines don't count."""
    sent = _sent(documents, scanner)
    names = ["doc_id", "first_line", "last_line", "family", "probability", "likeness"]
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64())

    def run(batches):
        for batch, found in _scans(batches, sent):
            columns = list(zip(*found)) if found else [[]] * 6
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns[1:], kinds)]], names=names)

    docs = only(documents, doc_id=id_col, text=text_col)
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, first_line int, last_line int, family string, probability double, likeness double")


def scanned(documents: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, families (of its paragraphs, sorted), n_licence_lines, n_confirmed (lines of confirmed paragraphs)."""
    sent = _sent(documents, scanner or train(documents.sparkSession, documents, text_col))

    def run(batches):
        for batch, found in _scans(batches, sent):
            families: list[set] = [set() for _ in range(batch.num_rows)]
            lines: list[dict[int, bool]] = [{} for _ in range(batch.num_rows)]
            for d, a, b, family, _, _ in found:
                families[d].add(family)
                for k in range(a, b + 1):
                    lines[d][k] = lines[d].get(k, False) or family != UNKNOWN
            columns = [batch.column(0), pa.array([sorted(f) for f in families], pa.list_(pa.string())), pa.array([len(x) for x in lines], pa.int64()), pa.array([sum(x.values()) for x in lines], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "families", "n_licence_lines", "n_confirmed"])

    docs = only(documents, doc_id=id_col, text=text_col)
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, families array<string>, n_licence_lines long, n_confirmed long")
