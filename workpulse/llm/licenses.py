"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment confirms them.

Words are runs of letters, digits and non-ASCII bytes, A-Z lowered, so line breaks and punctuation do not matter. A template of ``n`` shingles belongs to
the class of the next power of two ``P >= n``, 4 at least. A document's windows of that class are ``2 P`` shingles long and start every ``P / 2``,
so every stretch of ``1.5 P`` shingles lies in one of them. A window that holds a share ``CONTAINED`` of a template has a Jaccard similarity of
`similarity(n)` at least with it; there are as many bands of one minimum as it takes to bring the chance that all of them differ under
``MISS``. A window that agrees with a template in a band is confirmed if it holds at least ``CONTAINED`` of the template's shingles. Minima are taken of
windows that hold a shingle of some template; the others share none, so they agree with none.

Shingles have five words; a template of fewer words is one shingle of all its words. The documents are not shuffled, and tasks hold the
templates only, which are a parameter of bounded size.

Null and empty texts and texts shorter than every template match nothing. Repeated documents are reported each. If several windows hold a template, the first
of those that hold most of it is reported, and how many do. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from workpulse.llm.text import PUNCTUATION, parts, shingles, word_values, words

WORDS = 5
CONTAINED = 0.75
MISS = 1e-6
SMALLEST = 4
MOST_TEMPLATES = 20_000
_SIEVE = 20  # bits of the table that most of a document's shingles fail

# Notices, standard headers and opening paragraphs of public licenses, and lines of SPDX identifiers.
_GNU = "This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{b} either version {version} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {kind} 4.0 International License."
_SPDX = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC MPL-2.0 EPL-2.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-4.0"
_SPDX += " GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later"
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-2.0": _GNU.format(what="program", a=";", kind="", b=";", version="2"),
    "LGPL-2.1": _GNU.format(what="library", a=";", kind="Lesser ", b=";", version="2.1"),
    "LGPL-3.0": _GNU.format(what="program", a=":", kind="Lesser ", b=",", version="3"),
    "AGPL-3.0": _GNU.format(what="program", a=":", kind="Affero ", b=",", version="3"),
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": _CC.format(kind="Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _CC.format(kind="Attribution-NoDerivatives"),
    "CC-BY-NC-4.0": _CC.format(kind="Attribution-NonCommercial"),
    **{f"SPDX {code}": f"SPDX-License-Identifier: {code}" for code in _SPDX.split()},
}


def similarity(shingles_: int) -> float:
    """The least Jaccard similarity of a template of so many shingles and a window that holds enough of it."""
    held = math.ceil(CONTAINED * shingles_)
    return held / (2 * window_class(shingles_) + shingles_ - held)


def window_class(shingles_: int) -> int:
    return max(SMALLEST, 1 << (shingles_ - 1).bit_length())


def bands(shingles_: int) -> int:
    """Bands of one minimum for which a window that holds enough of a template is missed with chance ``MISS`` at most."""
    return math.ceil(math.log(MISS) / math.log(1 - similarity(shingles_)))


class Scanner:
    """The templates, by words of a shingle and window class, with their minima."""

    def __init__(self, templates: dict[str, str]):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        self.groups: dict[int, dict[int, list]] = {}
        rng = np.random.Generator(np.random.PCG64(11))
        self.xor = rng.integers(0, 1 << 32, 4096, dtype=np.uint32)
        self.times = rng.integers(0, 1 << 31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        for name, text in templates.items():
            of_words, _ = self._values(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
            if not len(of_words):
                continue
            size = min(WORDS, len(of_words))
            own = np.unique(shingles(of_words, np.array([0, len(of_words)]), size, whole=False)[0])
            self.groups.setdefault(size, {}).setdefault(window_class(len(own)), []).append((name, own))
        self.minima, self.known, self.sieves = {}, {}, {}
        for size, classes in self.groups.items():
            self.known[size] = np.unique(np.concatenate([own for members in classes.values() for _, own in members]))
            self.sieves[size] = np.zeros(1 << _SIEVE, bool)
            self.sieves[size][(self.known[size] >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True
        for size, classes in self.groups.items():
            for width, members in classes.items():
                count = max(bands(len(own)) for _, own in members)
                self.minima[size, width] = [np.unique([self._shuffled((own >> np.uint64(32)).astype(np.uint32), k).min() for _, own in members]) for k in range(count)]

    @staticmethod
    def _values(data, offsets):
        starts, ends, firsts = words(data, offsets, PUNCTUATION)
        return word_values(data, starts, ends), firsts

    def _shuffled(self, small, k):
        mixed = (small ^ self.xor[k]) * self.times[k]
        return mixed ^ (mixed >> np.uint32(16))

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """``text, template, share held, first word of the window, windows`` of each text and template found in it."""
        of_words, firsts = self._values(data, offsets)
        for size, classes in self.groups.items():
            runs, first = shingles(of_words, firsts, size, whole=False)
            if not len(runs):
                continue
            near = np.flatnonzero(self.sieves[size][(runs >> np.uint64(64 - _SIEVE)).astype(np.int64)])
            near = near[np.isin(runs[near], self.known[size])]
            if not len(near):
                continue
            small = (runs >> np.uint64(32)).astype(np.uint32)
            for width, members in classes.items():
                yield from self._confirmed(runs, first, self._agreeing(small, near, size, width), width, members)

    def _agreeing(self, small: np.ndarray, near: np.ndarray, size: int, width: int) -> np.ndarray:
        """Windows that agree with a template in a band. Only those that hold one of the shingles ``near`` are looked at, as others share none with a template.

        A window is four steps of ``width / 2``; the last ones may be shorter.
        """
        step, last = width // 2, (len(small) - 1) // (width // 2)
        own = near // step
        steps = np.unique(np.clip(own[:, None] + np.arange(-3, 4), 0, last))
        windows = np.unique(np.maximum(own[:, None] - np.arange(4), 0))
        places = steps[:, None] * step + np.arange(step)
        beyond = places >= len(small)
        values = small[np.minimum(places, len(small) - 1)]
        of_window = np.searchsorted(steps, np.minimum(windows[:, None] + np.arange(4), last))
        hit = np.zeros(len(windows), bool)
        for k, wanted in enumerate(self.minima[size, width]):
            shuffled = self._shuffled(values, k)
            shuffled[beyond] = np.iinfo(np.uint32).max
            hit |= np.isin(shuffled.min(1)[of_window].min(1), wanted)
        return windows[hit]

    def _confirmed(self, runs, first, windows, width, members):
        """Windows may reach into the next text; the part in each text counts by itself."""
        best: dict[tuple[int, str], list] = {}
        for window in windows.tolist():
            begin = window * (width // 2)
            end = min(begin + 2 * width, len(runs))
            a, b = np.searchsorted(first, begin, "right") - 1, np.searchsorted(first, end, "left")
            for text in range(a, b):
                x, y = max(begin, first[text]), min(end, first[text + 1])
                inside = np.unique(runs[x:y])
                for name, own in members:
                    held = np.isin(own, inside, assume_unique=True).sum() / len(own)
                    if held >= CONTAINED:
                        old = best.setdefault((text, name), [0.0, 0, 0])
                        if held > old[0]:
                            old[:2] = held, x - first[text]
                        old[2] += 1
        for (text, name), (held, at, count) in best.items():
            yield text, name, float(held), int(at), count


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, license, contained, first_word, windows``: a row for each document and template found in it."""
    scanner = Scanner(templates)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            for i, _, data, offsets in parts(batch.column(1)):
                found = list(scanner.scan(data, offsets))
                if found:
                    text, name, held, at, count = zip(*found, strict=True)
                    ids = batch.column(0).take(pa.array([i + x for x in text]))
                    yield pa.RecordBatch.from_pydict({"doc_id": ids, "license": list(name), "contained": list(held), "first_word": np.array(at, np.int64), "windows": np.array(count, np.int64)})

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, license string, contained double, first_word bigint, windows bigint")
