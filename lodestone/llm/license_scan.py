"""License scans with a trained paragraph classifier.

A paragraph is a line of a document. Its features are those 1-, 2- and 3-word runs of its
lower-case words that the fixed texts below hold; sparse multinomial logistic regression over license families and an unknown class
tells what it is. The model is trained on the driver from the templates below (in full, and
in excerpts of every length) and, as the unknown class, from near misses and a bounded sample of the table's
own paragraphs; an L1 penalty leaves few weights. The unknown class is calibrated on wordings that are not trained
on: a temperature is fitted to their likelihood, and a family needs a probability of ``LEAST_PROBABILITY``.

Scanning is DataFrame expressions over every whole text, and the model scores every paragraph: the hashes
(64 bits) of all its runs meet the features in one broadcast join, whose small side the fixed texts
bound. A paragraph that holds no feature is unknown, as the bias of that class is the greatest. Weights are multiples
of 2^-20, so that no order of summation changes a score. The family found is then confirmed by comparison with the templates: the share of the
paragraph's word pairs that stand in its own, if no other family's have more of them and one
pair stands in no other family's. Text that families share confirms none of them.

Defined results: null and empty texts have no paragraphs; repeated rows with equal id and
text are scanned once; null ids are carried; extra columns are ignored; a table without
license text, or without rows, gives no rows.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.draw import least

SAMPLE_PARAGRAPHS, SAMPLE_CHARS = 2000, 2000
LEAST_PROBABILITY, LEAST_SHARED = 0.5, 0.6
STEPS, L1, SEED = 12, 3e-4, 11
#: Weights are multiples of 1 / GRAIN; of a sum over pairs, the part below HALF counts a family's pairs and the rest those that no other has.
GRAIN, HALF = 1 << 20, 1 << 20
_NOT_WORD = "[^a-z0-9]+"

#: Public wordings of licenses, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "BSD": [
        "This software is released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is Incompatible With Secondary Licenses, as defined by the Mozilla Public License, v. 2.0.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages.",
        "SPDX-License-Identifier: ISC",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License, Version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "Zlib": [
        "This software is released under the zlib License.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such.",
        "SPDX-License-Identifier: Zlib",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved.",
    ],
}
UNKNOWN = "unknown"
#: Other wordings, which the model is not trained on; its temperature is fitted to them.
HELD_OUT = {
    "MIT": ["Distributed under the MIT License; see the file LICENSE.", "The code is MIT licensed."],
    "Apache-2.0": ["Available under the Apache License 2.0.", "The project is released under the terms of the Apache 2.0 license."],
    "GPL": ["Distributed under the GNU General Public License v2 or later.", "This is free software under the GNU GPL."],
    "BSD": ["Use of this source code is governed by a BSD-style license.", "Released under the BSD license."],
    "CC-BY-NC": ["This text is available under a Creative Commons Attribution-NonCommercial license."],
    "CC-BY": ["The article is published under the Creative Commons Attribution 4.0 license.", "Text: CC BY 4.0."],
    "CC-BY-SA": ["Content is available under the Creative Commons Attribution-ShareAlike license.", "Text: CC BY-SA 4.0."],
    "CC-BY-ND": ["Shared under Creative Commons Attribution-NoDerivatives."],
    "LGPL": ["The library is licensed under the GNU Lesser General Public License."],
    "AGPL": ["The server is licensed under the GNU Affero General Public License."],
    "MPL-2.0": ["The files are subject to the Mozilla Public License."],
    "ISC": ["The package is under the ISC license."],
    "EPL-2.0": ["Made available under the Eclipse Public License."],
    "CC0": ["Released under CC0 1.0 Universal."],
    "Unlicense": ["Placed in the public domain as free and unencumbered software."],
    "all-rights-reserved": ["No part may be copied. All rights reserved."],
}
#: Lines that use the words of licenses and grant none; of the unknown class, the second half for the temperature alone.
NEAR_MISSES = [
    "You need a driving license to rent a car.", "The license plate was found near the gate.", "A software license costs more every year.", "Licensed practitioners may open a practice here.",
    "The city granted the company a license to sell beer.", "Apache helicopters flew over the valley.", "The Apache people lived in the mountains.", "The Boston campus of the MIT has a museum.",
    "The general public may visit the garden on Sunday.", "All seats in the first row are reserved.", "Human rights are reserved to every person.", "Creative work is common in this school.",
    "Members of the commons voted on the attribution of funds.", "The warranty of the washing machine ended in May.", "Ask for permission before you use the kitchen.", "The notice hung above the door for a year.",
    "Copyright law changed in that year.", "The author disclaims any knowledge of the plot.", "Contributors to the journal receive a free copy.", "The Mozilla browser was slow on that computer.",
    "A gnu is an animal of the savanna.", "The eclipse was seen by the public.", "Rocket boost software failed at the start.", "The package was distributed without a fee.",
    "The fishing license is valid for any purpose at the lake.", "The work is licensed to the theatre for one season.", "A public license office opened in the town.", "The terms of the license are secret.",
    "The version of the contract was changed.", "The bsd meeting was moved to Monday.", "Rights of way are reserved for farmers.", "Permission was hereby refused to every person in the room.",
]

def tokens(text: str) -> list[str]:
    """The lower-case words of a paragraph; letters beyond ASCII separate."""
    return [w for w in re.split(_NOT_WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]


def grams(words: list[str]) -> set[str]:
    """The runs of one to three words."""
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


#: The runs that may be features: those of the fixed texts. A table's own runs are none, so it cannot make the model grow.
FEATURES = frozenset().union(*(grams(tokens(t)) for ts in [*TEMPLATES.values(), *HELD_OUT.values(), NEAR_MISSES] for t in ts))
#: The words of the features: a paragraph without any of them holds no feature. "mit" in capitals needs no rule of its own.
CUES, _MIT = sorted(f for f in FEATURES if " " not in f), r"(?<![A-Za-z0-9])MIT(?![A-Za-z0-9])"


def _idle() -> set[str]:
    """The templates' runs that the model does not use: none."""
    return {x for ts in TEMPLATES.values() for t in ts for x in grams(tokens(t))} - FEATURES


def _examples() -> list[tuple[set[str], str]]:
    """Templates and their excerpts of five words or more, and the first half of the near misses."""
    chance, out = random.Random(SEED), []
    for family, texts in TEMPLATES.items():
        for text in texts:
            w = tokens(text)
            out += [(grams(w), family)] * 6
            for _ in range(3 * min(len(w), 40)):
                n = chance.randint(min(5, len(w)), len(w))
                at = chance.randint(0, len(w) - n)
                out.append((grams(w[at : at + n]), family))
    return out + [(grams(tokens(t)), UNKNOWN) for t in NEAR_MISSES[: len(NEAR_MISSES) // 2]] * 6


class Model:
    """Weights by run, biases, and the temperature that calibrates both."""

    def __init__(self, families: list[str]):
        self.families, self.weights, self.bias, self.temperature = families, defaultdict(lambda: [0.0] * len(families)), [0.0] * len(families), 1.0

    def scores(self, x: set[str]) -> list[float]:
        out = list(self.bias)
        for f in x:
            if f in self.weights:
                for k, w in enumerate(self.weights[f]):
                    out[k] += w
        return out

    def chances(self, x: set[str], temperature: float | None = None) -> list[float]:
        s = [v / (temperature or self.temperature) for v in self.scores(x)]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]


def train(background: list[str]) -> Model:
    """Stochastic AdaGrad with an L1 penalty on templates and nine tenths of the background; the temperature from wordings that are not trained on."""
    model = Model([*TEMPLATES, UNKNOWN])
    number = {f: i for i, f in enumerate(model.families)}
    known = [(grams(w), UNKNOWN) for w in map(tokens, background) if w]
    unseen = known[::10] + [(grams(tokens(t)), UNKNOWN) for t in NEAR_MISSES[len(NEAR_MISSES) // 2 :]]
    unseen += [(grams(tokens(t)), f) for f, ts in HELD_OUT.items() for t in ts]
    rows = _examples() + [x for i, x in enumerate(known) if i % 10]
    fit, held = ([(sorted(x & FEATURES), number[f]) for x, f in part] for part in (rows, unseen))
    sums: dict = defaultdict(lambda: [1e-6] * len(number))
    for turn in range(STEPS):
        random.Random(SEED + turn).shuffle(fit)
        for x, y in fit:
            p = model.chances(x)
            for k in range(len(number)):
                g = p[k] - (k == y)
                if abs(g) < 1e-3:
                    continue
                model.bias[k] -= 0.02 * g
                for f in x:
                    sums[f][k] += g * g
                    rate = 0.3 / math.sqrt(sums[f][k])
                    w = model.weights[f][k] - rate * g
                    model.weights[f][k] = math.copysign(max(0.0, abs(w) - rate * L1), w)
    for f in [f for f, w in model.weights.items() if max(map(abs, w)) < 1e-3]:
        del model.weights[f]
    for w in [*model.weights.values(), model.bias]:
        w[:] = [round(v * GRAIN) / GRAIN for v in w]
    model.bias[number[UNKNOWN]] = max(model.bias) + 1 / GRAIN  # without features nothing speaks for a family
    loss = lambda t: -sum(math.log(max(1e-12, model.chances(x, t)[y])) for x, y in held)
    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0), key=loss)
    return model


def _words(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, _NOT_WORD), "")


def background(documents: DataFrame, most: int = SAMPLE_PARAGRAPHS) -> list[str]:
    """At most ``most`` paragraphs of the table, one a document, by hash; ``SAMPLE_CHARS`` of each at most."""
    one = F.get(F.split("text", "\n"), F.pmod(F.xxhash64("doc_id"), F.size(F.split("text", "\n"))).cast("int"))
    rows = documents.filter("text IS NOT NULL").select(F.left(one, F.lit(SAMPLE_CHARS)).alias("p"), F.xxhash64("doc_id", "text").alias("h"))
    return [r["p"] for r in least(rows, most, F.col("h"))]


def _pairs(words: list[str]) -> set[str]:
    """The words and word pairs that a comparison with templates looks at."""
    return {" ".join(words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)}


def unlike_templates(sample: list[str]) -> list[str]:
    """The paragraphs of a sample that no family's templates cover: license text is no example of the unknown class."""
    known = [set().union(*(_pairs(tokens(t)) for t in texts)) for texts in TEMPLATES.values()]
    return [p for p in sample if (own := _pairs(tokens(p))) and max(len(own & k) for k in known) < LEAST_SHARED * len(own)]


def scan(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, shared, confirmed): every paragraph that ``model`` (by default one trained beside the table) gives to a family."""
    spark = documents.sparkSession
    model = model or train(unlike_templates(background(documents)))
    known = {f: set().union(*(_pairs(tokens(t)) for t in texts)) for f, texts in TEMPLATES.items()}
    holders, families = Counter(p for pairs in known.values() for p in pairs), list(known)
    none = [0.0] * len(model.families)
    runs = [(r, r.count(" ") + 1, list(map(float, model.weights.get(r, none))), [(r in known[f]) + HALF * (r in known[f] and holders[r] == 1) for f in families]) for r in sorted(model.weights.keys() | holders.keys())]
    features = spark.createDataFrame(runs, "run string, size int, weights array<double>, held array<long>")
    word = [F.get(F.split("run", " "), F.lit(i)) for i in range(3)]
    features = features.withColumn("h", F.when(F.col("size") == 1, F.xxhash64(word[0])).when(F.col("size") == 2, F.xxhash64(*word[:2])).otherwise(F.xxhash64(*word))).drop("run")

    rows = documents.filter("text IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("ls"))
    lines = rows.select("row", "doc_id", "th", F.posexplode("ls").alias("paragraph", "line"))
    lines = lines.select("row", "doc_id", "th", "paragraph", F.explode(F.array(_words(F.col("line")))).alias("w"))  # what a generator gives out is not computed anew for each run
    at, n = lambda i: F.get("w", i), F.size("w")
    ends = lambda x, i: F.array(F.xxhash64(x), F.when(i + 1 < n, F.xxhash64(x, at(i + 1))), F.when(i + 2 < n, F.xxhash64(x, at(i + 1), at(i + 2))))
    every = F.array_distinct(F.flatten(F.transform("w", ends)))
    two = F.array_distinct(F.transform(F.slice("w", 1, F.greatest(n - 1, F.lit(0))), lambda x, i: F.xxhash64(x, at(i + 1))))
    of = F.when(n > 1, F.size(two)).otherwise(n)
    key = ["row", "paragraph", "doc_id", "th", "own_pairs"]
    lines = lines.select(*key[:4], F.inline(F.array(F.struct(every.alias("every"), of.alias("own_pairs"), n.alias("n")))))
    met = lines.select(*key, "n", F.explode("every").alias("h")).join(F.broadcast(features), "h")  # the fixed texts bound it
    count, counts = len(model.families), F.col("size") == F.least(F.col("n"), F.lit(2))  # pairs, of a single word the word
    sums = met.groupBy(*key).agg(*[F.sum(F.col("weights")[k]).alias(f"s{k}") for k in range(count)], *[F.sum(F.when(counts, F.col("held")[k])).alias(f"p{k}") for k in range(len(families))])
    scores = F.array(*[(F.col(f"s{k}") + model.bias[k]) / model.temperature for k in range(count)])
    total = sums.withColumn("s", scores)
    top = F.array_max("s")
    total = total.withColumn("best", F.array_position("s", top).cast("int")).withColumn("probability", 1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("s"))))
    family = F.element_at(F.array(*map(F.lit, model.families)), F.col("best"))
    total = total.withColumn("family", family).filter((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY)).dropDuplicates(["doc_id", "th", "paragraph"])

    pairs = [F.coalesce(F.col(f"p{k}"), F.lit(0)) for k in range(len(families))]
    common = F.transform(F.array(*pairs), lambda x: x % HALF)
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("int")
    own, named = F.element_at(common, number), F.element_at(F.array(*pairs), number) >= HALF
    shared = own / F.col("own_pairs")
    total = total.withColumn("shared", F.round(shared, 6)).withColumn("confirmed", (F.col("shared") >= LEAST_SHARED) & (own == F.array_max(common)) & named)
    return total.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), "shared", "confirmed")
