"""Licence families of paragraphs: a trained sparse n-gram classifier, confirmed against templates.

A paragraph is a line, or a run of neighbouring lines with words over which a
statement is wrapped. Its words (lower case, punctuation dropped) and pairs of
words, those across line ends too, are hashed features of a softmax regression
over licence families and an unknown class. It is trained here on statements made from the templates below,
alone and inside prose, and on lines of a bounded sample of the corpus. A
temperature fitted on a fifth of the examples calibrates the probabilities. A
line whose most probable family beats the limit is a finding if it holds enough
of one of the family's templates. So is a run of lines, if it holds enough of a
template, and by a margin more of it than any finding of the family among its lines:
of runs that overlap, the one
that holds most of a template, then the shortest, then the first. Runs go as
far as the longest template can reach, however it is wrapped. Templates are
statements (sentences, clauses) of the published texts, so that a whole text
gives a finding for each statement, or one for each line that holds several.

Defined cases: a null text has no paragraphs; null keys and repeated rows are
rows like any other; a line of any length is read whole; of families or
templates that are equally near the first counts; an empty table gives an empty result (the classifier is
then trained on made prose alone); further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import first_by, text_or_empty
from pulseloom.llm.shingles import CHUNK, hash_words, mix

# Names of licence families, usual notices, and statements of their published texts and headers.
NAMES = {
    "MIT": ["the MIT License", "the MIT license (Expat)", "MIT", "an MIT license"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 License", "Apache-2.0", "the Apache License", "Apache License 2.0"],
    "GPL": [
        "the GNU General Public License, version 3", "the GNU General Public License, version 2", "the GNU GPL v3", "the GNU GPLv2", "GPL-3.0-or-later", "GPL-2.0-only",
        "the GNU General Public License", "the GPL", "GPLv2", "GPLv3", "the GPLv2", "the GPLv3",
    ],
    "LGPL": [
        "the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1", "LGPL-3.0-or-later",
        "the GNU Lesser General Public License", "the LGPL", "LGPLv2.1", "LGPLv3", "the LGPLv3",
    ],
    "AGPL": [
        "the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPL-3.0-only",
        "the GNU Affero General Public License", "the AGPL", "AGPLv3", "the AGPLv3",
    ],
    "BSD": ["the BSD 3-Clause License", "the BSD 2-Clause License", "a BSD-style license", "BSD-3-Clause", "BSD-2-Clause", "the BSD license", "the new BSD license", "the simplified BSD license"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0", "the Mozilla Public License", "the MPL"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "the Eclipse Public License v 2.0", "EPL-2.0", "the Eclipse Public License"],
    "ISC": ["the ISC License", "the ISC license", "ISC"],
    "Unlicense": ["the Unlicense", "the Unlicense (public domain)", "Unlicense"],
    "CC0": ["CC0 1.0 Universal", "the Creative Commons Zero 1.0 public domain dedication", "CC0-1.0", "CC0"],
    "CC-BY": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "CC BY 3.0", "a Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0", "CC BY-SA", "a Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC", "a Creative Commons Attribution-NonCommercial License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0", "CC BY-ND", "a Creative Commons Attribution-NoDerivatives License"],
    "Artistic-2.0": ["the Artistic License 2.0", "the Artistic License, version 2.0", "Artistic-2.0", "the Artistic License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0", "BSL-1.0", "the Boost Software License"],
    "Zlib": ["the zlib License", "the zlib/libpng License", "Zlib"],
    "WTFPL": ["the WTFPL", "WTFPL", "the Do What The Fuck You Want To Public License"],
}
NOTICES = [
    "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under the terms of {}.", "Available under {}.",
    "This software is made available under {}.", "SPDX-License-Identifier: {}", "The code in this repository is licensed under {}.",
    "You may use this file under {}.", "Published under {}.", "License: {}", "is {} licensed.",
]
SENTENCES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "AGPL": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY",
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE",
        "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ],
    "CC0": [
        "the person who associated a work with this deed has dedicated the work to the public domain",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "CC-BY": ["You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-SA": ["You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC-BY-NC": ["You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-ND": ["You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NoDerivatives 4.0 International Public License"],
    "Artistic-2.0": [
        "This is free software, licensed under: The Artistic License 2.0 (GPL Compatible)",
        "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
        "you can redistribute it and/or modify it under the terms of the Artistic License",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "This notice may not be removed or altered from any source distribution.",
    ],
    "WTFPL": [
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
        "You just DO WHAT THE FUCK YOU WANT TO.",
    ],
}
#: Words around which unknown notices are made, so that the form of a notice alone does not decide.
UNKNOWN = "the terms of use; our agreement; the conditions below; the Acme License; a commercial license; the Zeta Public License; written permission; the supervision of the board; the bridge; fire"

FAMILIES = ["unknown", *NAMES]


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample, size of the feature table, and limits of a finding."""

    sample_documents: int = 300
    sample_lines: int = 6000
    bits: int = 17
    epochs: int = 6
    rate: float = 0.3
    decay: float = 1e-6
    least_probability: float = 0.5
    least_similarity: float = 0.7
    least_gain: float = 0.3
    seed: int = 11


_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower())
    elif _c >= 128:
        _FOLD[_c] = _c


def _line_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hash_words(_FOLD[data], offsets)


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return _line_words(data, np.array([0, len(data)]))[0]


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


def _features(words: np.ndarray, bits: int) -> np.ndarray:
    return (np.concatenate((words, _pairs(words))) >> np.uint64(64 - bits)).astype(np.int64)


def templates() -> dict[str, list[str]]:
    return {f: [n.format(name) for name in names for n in NOTICES] + SENTENCES.get(f, []) for f, names in NAMES.items()}


#: Words of the longest template.
LONGEST = max(len(words_of(t)) for ts in templates().values() for t in ts)


@dataclass
class Classifier:
    """Weights of hashed features and the temperature; one class for each of FAMILIES."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def logits(self, text: str) -> np.ndarray:
        return self.weights[_features(words_of(text), self.bits)].sum(axis=0, keepdims=True)


def _coded(text: str) -> str:
    return " ".join(map(str, words_of(text).tolist()))


def _known() -> list[str]:
    """The templates of three words or more."""
    return [c for ts in templates().values() for t in ts if (c := _coded(t)).count(" ") >= 2]


def examples(lines: list[str], s: Settings) -> list[tuple[str, int]]:
    """Statements of every family, whole, damaged, and inside prose; notices of no family; and the sampled lines that neither hold a template nor are a part of one."""
    r = np.random.default_rng(s.seed)
    known = _known()
    every = " | ".join(known)
    part = lambda c: c.count(" ") >= 2 and c in every
    plain = [x for x in lines for c in [_coded(x)] if not part(c) and not any(t in c for t in known)]
    prose = plain or ["".join(r.choice(list("aeinorst"), r.integers(2, 9))) for _ in range(500)]
    cut = lambda: " ".join(prose[r.integers(len(prose))].split(None, 25)[: r.integers(0, 25)])
    out = [(x, 0) for x in plain]
    for k, (_, statements) in enumerate(templates().items(), 1):
        for t in statements:
            words = t.split()
            out += [(t, k), (t.upper(), k), (f"{cut()} {t}", k), (f"{t} {cut()}", k), (f"{cut()} {t} {cut()}", k)]
            if len(words) > 8:
                for _ in range(3):
                    out.append((" ".join(w for w in words if r.random() > 0.15), k))
    for phrase in UNKNOWN.split("; "):
        for n in NOTICES:
            out += [(n.format(phrase), 0), (f"{cut()} {n.format(phrase)} {cut()}", 0)] * 2
    return [out[i] for i in r.permutation(len(out))]


def train(lines: list[str], s: Settings = Settings()) -> Classifier:
    """Softmax regression by stochastic gradients with adaptive rates, then a temperature on held-out examples."""
    data = examples(lines, s)
    rows = [_features(words_of(x), s.bits) for x, _ in data]
    labels = np.array([k for _, k in data])
    held = np.arange(len(data)) % 5 == 4
    weights = np.zeros((1 << s.bits, len(FAMILIES)), np.float32)
    scale, bias = np.full((1 << s.bits, 1), 1e-8, np.float32), np.zeros(len(FAMILIES), np.float32)
    model = Classifier(weights, bias, 1.0, s.bits)
    for _ in range(s.epochs):
        for i in np.flatnonzero(~held):
            at = rows[i]
            p = model.probabilities(weights[at].sum(axis=0, keepdims=True))[0]
            p[labels[i]] -= 1
            used = np.unique(at)
            scale[used] += float(p @ p)
            weights[used] -= s.rate * (p / np.sqrt(scale[used])) / np.sqrt(len(used)) + s.decay * weights[used]
            bias -= 0.01 * p
    logits = np.array([weights[rows[i]].sum(axis=0) for i in np.flatnonzero(held)])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.2, 8, 40):
        model.temperature = float(t)
        p = model.probabilities(logits)[np.arange(len(logits)), labels[held]]
        best = min(best, (float(-np.log(p + 1e-12).mean()), float(t)))
    model.temperature = best[1]
    return model


class Forms:
    """Templates of one family, by their pairs of words."""

    def __init__(self, texts: list[str]):
        sets = [np.unique(_pairs(words_of(t))) for t in texts]
        pairs, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.owner = pairs[order], owner[order]
        self.sizes = np.array([len(x) if len(x) > 1 else np.inf for x in sets])

    def shares(self, words: np.ndarray) -> np.ndarray:
        """For each template, which share of its pairs of words these words have; none of a template of one pair."""
        own = np.unique(_pairs(words))
        low, high = np.searchsorted(self.pairs, own), np.searchsorted(self.pairs, own, side="right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes)) / self.sizes


def _template_forms() -> dict[int, Forms]:
    return {k: Forms(ts) for k, ts in enumerate(templates().values(), 1)}


def _runs(words: np.ndarray, at: np.ndarray, full: np.ndarray, docs: np.ndarray, logits: np.ndarray, model: Classifier, longest: int):
    """(first lines, last lines, logits) of all runs of 2, 3, ... lines in which a statement of at most ``longest`` words can begin in the first and end in the last."""
    joined = (np.diff(full) == 1) & (docs[1:] == docs[:-1])
    ahead = np.append(at[full], at[full[-1] + 1])  # words before each line
    bridge = mix(words[at[full[:-1] + 1] - 1] * np.uint64(0x9E3779B97F4A7C15) + words[at[full[1:]]])
    first = np.flatnonzero(joined)
    own = logits[first]
    last = first
    while len(first):
        own = own + model.weights[(bridge[last] >> np.uint64(64 - model.bits)).astype(np.int64)] + logits[last + 1]
        last = last + 1
        yield first, last, own
        on = (last < len(full) - 1) & (ahead[last + 1] - ahead[first + 1] < longest)
        on[on] = joined[last[on]]
        first, last, own = first[on], last[on], own[on]


def _unwrapped(text: str, known: list[str]) -> list[str]:
    """Lines with a word that are not part of a block over whose lines a known statement is wrapped."""
    out: list[str] = []
    block: list[str] = []
    for line in [*text.split("\n"), ""]:
        if len(words_of(line)):
            block.append(line)
            continue
        coded = [_coded(x) for x in block]
        whole = " ".join(coded)
        if not any(t in whole and not any(t in c for c in coded) for t in known):
            out += block
        block = []
    return out


def _scan_chunk(data: np.ndarray, offsets: np.ndarray, model: Classifier, forms: dict[int, Forms], s: Settings):
    """Findings (text, line, start byte, end byte, family, probability, similarity) of the texts of a chunk."""
    breaks = np.flatnonzero(data == 10)
    # Lines begin at texts and after newlines; a text that ends in a newline has an empty last line.
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    words, at = _line_words(data, np.append(starts, len(data)))
    counts = np.diff(at)
    full = np.flatnonzero(counts)
    if not len(full):
        return
    logits = np.zeros((len(full), len(FAMILIES)), np.float32)
    step = 1 << 16
    order = np.cumsum(counts[full])
    lo = 0
    while lo < len(full):
        base = int(at[full[lo]])
        hi = max(lo + 1, int(np.searchsorted(order, order[lo] - counts[full[lo]] + step, side="right")))
        part = words[base : base + int(counts[full[lo:hi]].sum())]
        first = np.concatenate(([0], np.cumsum(counts[full[lo:hi]])[:-1]))
        single = model.weights[(part >> np.uint64(64 - model.bits)).astype(np.int64)]
        pair = np.zeros_like(single)
        if len(part) > 1:
            pair[:-1] = model.weights[(_pairs(part) >> np.uint64(64 - model.bits)).astype(np.int64)]
        pair[np.append(first[1:], len(part)) - 1] = 0  # a line's last word begins no pair
        logits[lo:hi] = np.add.reduceat(single + pair, first, axis=0)
        lo = hi
    p = model.probabilities(logits)
    p[:, 0] = np.where(p[:, 1:].max(axis=1) >= s.least_probability, 0, 1)
    docs = np.searchsorted(offsets, starts[full], side="right") - 1

    def shares(i: int, j: int, k: int) -> np.ndarray:
        """Which share of each template of a family lines i to j have."""
        return forms[k].shares(words[at[full[i]] : at[full[j] + 1]])

    findings: list[tuple] = []
    held: dict[tuple[int, int], np.ndarray] = {}  # by line and family, what findings there have of the templates

    def note(i: int, j: int, k: int, probability: float, found: np.ndarray) -> None:
        findings.append((i, j, k, probability, float(found.max())))
        for n in range(i, j + 1):
            held[n, k] = np.maximum(held.get((n, k), 0.0), found)

    for i in np.flatnonzero(p[:, 0] == 0):
        k = int(p[i, 1:].argmax()) + 1
        found = shares(i, i, k)
        if found.max() >= s.least_similarity:
            note(int(i), int(i), k, float(p[i, k]), found)
    wrapped = []
    for first, last, own in _runs(words, at, full, docs, logits, model, LONGEST):
        q = model.probabilities(own)
        for r in np.flatnonzero(q[:, 1:].max(axis=1) >= s.least_probability):
            i, j, k = int(first[r]), int(last[r]), int(q[r, 1:].argmax()) + 1
            found = shares(i, j, k)
            if found.max() >= s.least_similarity:
                wrapped.append((-float(found.max()), j - i, i, j, k, float(q[r, k]), found))
    for _, _, i, j, k, probability, found in sorted(wrapped, key=lambda w: w[:4]):
        before = np.max([held.get((n, k), np.zeros_like(found)) for n in range(i, j + 1)], axis=0)
        if ((found >= s.least_similarity) & (found - before > s.least_gain)).any():
            note(i, j, k, probability, found)
    for i, j, k, probability, alike in sorted(findings):
        start, doc = int(starts[full[i]]), int(docs[i])
        ahead = np.searchsorted(breaks, starts[full[j]])
        end = int(breaks[ahead]) if ahead < len(breaks) else len(data)
        end = min(end, int(offsets[doc + 1]))
        number = int(np.searchsorted(breaks, start) - np.searchsorted(breaks, offsets[doc]))
        yield doc, number, start - int(offsets[doc]), end - int(offsets[doc]), k, probability, alike


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", settings: Settings = Settings()) -> Classifier:
    """A classifier trained with lines of a bounded sample of docs: the first documents by hash, then their first lines."""
    some = first_by(docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")), F.xxhash64("k", "t"), settings.sample_documents)
    some = some.orderBy("k", "t").limit(settings.sample_documents)
    known = _known()
    return train([x for r in some.collect() for x in _unwrapped(r["t"], known)][: settings.sample_lines], settings)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", settings: Settings = Settings(), classifier: Classifier | None = None) -> DataFrame:
    """A row for each finding: doc_id, paragraph (its first line, from 0), start and n_chars in code points, family, probability, similarity.

    classifier: one that was fitted before, such as that of an earlier snapshot; by default it is fitted to docs.
    """
    model = docs.sparkSession.sparkContext.broadcast(classifier or fit(docs, text, key, settings))

    def find(batches):
        forms = _template_forms()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            buffers = texts.buffers()
            offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
            found: list[tuple] = []
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
                part = data[offsets[lo] : offsets[hi]]
                for doc, number, start, end, k, p, alike in _scan_chunk(part, offsets[lo : hi + 1] - offsets[lo], model.value, forms, settings):
                    own = part[int(offsets[lo + doc] - offsets[lo]) :]
                    ahead = len(own[:start].tobytes().decode("utf-8", "replace"))
                    length = len(own[start:end].tobytes().decode("utf-8", "replace"))
                    found.append((batch.column(0)[lo + doc].as_py(), number, ahead, length, FAMILIES[k], p, alike))
                lo = hi
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()
            names = ["doc_id", "paragraph", "start", "n_chars", "family", "probability", "similarity"]
            columns = list(zip(*found)) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return chosen.mapInArrow(find, "doc_id long, paragraph int, start long, n_chars long, family string, probability double, similarity double")
