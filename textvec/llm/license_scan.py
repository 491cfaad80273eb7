"""Operator 3, licence scans by Dice coefficient over word bigrams.

A text is lower-cased, and every run of other characters than a-z and 0-9 is one space. Units are the whole text and
each of its lines; a unit is its set of word bigrams. Dice(A, B) = 2 |A & B| / (|A| + |B|) is at least ``t`` only if
|B| is within t / (2 - t) and (2 - t) / t of |A|, so a unit is compared only with templates of such a size, and only
if it shares a bigram with one.

A notice that is wrapped over lines or stands within a longer line is no unit. So runs of word bigrams of the whole text,
of any length that the bounds allow, are compared as well (windows). A text is ruled out only if it has less than
t / (2 - t) of the bigrams of every template."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short notices by which texts name their licence.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Full licence texts, without the line of the copyright.
FULL: dict[str, str] = {
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0-text": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
_OTHER = re.compile("[^a-z0-9]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def bigrams(text: str) -> set[tuple[str, str]]:
    words = _OTHER.sub(" ", text.translate(_UPPER)).split()
    return set(zip(words, words[1:]))


class Scanner:
    """Templates, by size and by bigram."""

    def __init__(self, templates: dict[str, str], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be in (0, 1]")
        self.sets = {name: bigrams(text) for name, text in sorted(templates.items())}
        self.threshold = threshold
        self.having: dict[tuple[str, str], list[str]] = {}
        for name, own in self.sets.items():
            for x in own:
                self.having.setdefault(x, []).append(name)
        sizes = [len(x) for x in self.sets.values() if x] or [0]
        self.least, self.most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold

    def match(self, text: str) -> list[tuple[float, str]]:
        """Dice and name of every template that a unit is like."""
        own = bigrams(text)
        if not self.least <= len(own) <= self.most:
            return []
        shared: dict[str, int] = {}
        for x in own:
            for name in self.having.get(x, ()):
                shared[name] = shared.get(name, 0) + 1
        return [x for x in ((2 * n / (len(own) + len(self.sets[name])), name) for name, n in shared.items()) if x[0] >= self.threshold]

    def window(self, name: str, pairs: list[tuple[str, str]], hits: list[int]) -> tuple[float, int] | None:
        """Dice and first pair of the run of pairs most like a template, ties to the first. It begins and ends with a pair of the template.

        A run that meets its first pair again has the same pairs without that first one, so runs end before it: all runs
        together are no longer than the text times the size of the template."""
        own, best = self.sets[name], None
        again, later = [0] * len(hits), dict[tuple[str, str], int]()
        for k in range(len(hits) - 1, -1, -1):
            again[k] = later.get(pairs[hits[k]], len(pairs))
            later[pairs[hits[k]]] = hits[k]
        need, most = self.threshold * len(own) / (2 - self.threshold), len(own) * (2 - self.threshold) / self.threshold
        for k, start in enumerate(hits):
            if len(hits) - k < need - 1e-9:
                break
            seen: set[tuple[str, str]] = set()
            shared = 0
            for i in range(start, again[k]):
                x = pairs[i]
                if x in seen:
                    continue
                seen.add(x)
                if len(seen) > most:
                    break
                if x in own:
                    shared += 1
                    dice = 2 * shared / (len(seen) + len(own))
                    if dice >= self.threshold and (best is None or dice > best[0]):
                        best = dice, start
            if best and best[0] == 1:
                break
        return best

    def every(self, text: str | None) -> list[tuple[str, float, int]]:
        """Each licence found, with Dice and line of what is most like it, the best first; units come before windows."""
        lines = (text or "").split("\n")
        words: list[str] = []
        ends: list[int] = []
        for line in lines:
            words += _OTHER.sub(" ", line.translate(_UPPER)).split()
            ends.append(len(words))
        pairs = list(zip(words, words[1:]))
        hits: dict[str, list[int]] = {}
        for i, x in enumerate(pairs):
            for name in self.having.get(x, ()):
                hits.setdefault(name, []).append(i)
        part = self.threshold / (2 - self.threshold)
        hits = {name: at for name, at in hits.items() if len({pairs[i] for i in at}) >= part * len(self.sets[name]) - 1e-9}
        if not hits:  # a unit has no other pairs than its text
            return []
        found = [(-dice, 0, at, name) for at, unit in enumerate([text or ""] if len(lines) == 1 else [text or "", *lines]) for dice, name in self.match(unit)]
        for name, at in hits.items():
            if best := self.window(name, pairs, at):
                found.append((-best[0], 1, bisect_right(ends, best[1]) + 1, name))
        first: dict[str, tuple[str, float, int]] = {}
        for dice, _, at, name in sorted(found):
            first.setdefault(name, (name, -dice, at))
        return list(first.values())

    def scan(self, text: str | None) -> tuple[str | None, float, int]:
        """Licence, Dice and line (from 1; 0: the whole text) of the best unit or window, ties to the first; None if none."""
        found = self.every(text)
        return found[0] if found else (None, 0.0, -1)


def _scan(templates: dict[str, str], threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                rows = [scanner.scan(t) for t in batch.column("text").to_pylist()]
                cols = list(zip(*rows)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], ["doc_id", "license", "dice", "line"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, dice and line of the unit or window of each text that is most like a template, by `TEMPLATES` and `FULL`.

    Texts without such a unit, null and empty ones included, have a null license, dice 0 and line -1. Repeated rows
    are scanned row by row; other columns are ignored."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_scan(templates or TEMPLATES | FULL, threshold), "doc_id long, license string, dice double, line long")


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, dice and line of every licence that a text names, by `TEMPLATES` and the full texts in `FULL`."""
    known = templates or TEMPLATES | FULL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, threshold)
        for batch in batches:
            rows = [(i, *x) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for x in scanner.every(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int64()))], ["doc_id", "license", "dice", "line"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, license string, dice double, line long")
