"""License scans by conditional compression.

A block is what stands around words of licensing. For each template the windows of its length around these
words are compressed alone and with the template as a zstandard raw dictionary. Templates are ranked by the bytes that they save; those that save LEAST or more are confirmed in that order by
the wording, as a difference of word sequences. The first that is confirmed, or of those that save about as much
the one with the fewest differing words, takes its best spans out of the block, and what is left is compressed and
ranked anew, so a template wins by what no better one has explained."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

#: Notices by which works are put under public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "BSD-3-no-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "EUPL-1.2": "Licensed under the European Union Public Licence, version 1.2.",
    "GPL-3.0-short": "licensed under GPL version 3",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SPDX-BSD-3": "SPDX-License-Identifier: BSD-3-Clause",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
LEAST, NEAR = 4, 8  # bytes that a template saves at least; by which two save alike
HINT = re.compile(r"licen[sc]|permission|redistribut|copyright|rights reserved|free software|public domain", re.I)
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
LEVEL = 19  # at lower ones a dictionary's effect on prose is as large as that of a short notice


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.words = {k: WORD.findall(t.lower()) for k, t in templates.items()}
        self.own = {k: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, t in templates.items()}
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.sizes = {k: len(t) for k, t in templates.items()}
        self.known: dict = {}
        self.savings: dict = {}
        self.room = 32 << 20  # characters of blocks that are remembered

    def gain(self, name: str, text: str) -> float:
        b = text.encode()
        return 1 - len(self.own[name].compress(b)) / len(self.alone.compress(b))

    def aligned(self, name: str, words: list[str], differ: float):
        """(differing words, first word, end) of the template's places in words, where few enough differ."""
        t, own = self.words[name], set(self.words[name])
        most = int(differ * len(t))
        if not t or len(own.difference(words)) > most:
            return
        sums = [0]
        for w in words:
            sums.append(sums[-1] + (w in own))
        span, done = len(t) + most, 0
        for j, w in enumerate(words):
            if j < done or w not in own or sums[min(j + span, len(words))] - sums[j] < len(t) - most:
                continue
            same = SequenceMatcher(None, t, words[j : j + span], autojunk=False).get_matching_blocks()
            n = sum(x.size for x in same)
            inside = same[-2].b + same[-2].size - same[0].b if n else 0
            wrong = len(t) - n + inside - n
            # versions must be the template's
            held = {words[j + x.b + k] for x in same for k in range(x.size)}
            if wrong <= most and all(w in held for w in t if any(c.isdigit() for c in w)):
                yield wrong, j + same[0].b, j + same[0].b + inside
                done = j + same[0].b + inside if not wrong else 0

    def saving(self, k: str, window: str) -> int:
        """By how many bytes the template makes the window's compression smaller."""
        if (k, window) not in self.savings:
            if len(self.savings) > 50_000:
                self.savings.clear()
            b = window.encode()
            self.savings[k, window] = len(self.alone.compress(b)) - len(self.own[k].compress(b))
        return self.savings[k, window]

    def ranked(self, text: str, names: set[str]) -> list[tuple[int, str]]:
        """(bytes saved, template) of those that save LEAST bytes or more, from the most. A template is tried around each word of
        licensing, as far as its length goes: in a wider window the rest would cost or save as much as a short notice."""
        hits, out = [m.span() for m in HINT.finditer(text)], []
        for k in names:
            n = self.sizes[k]
            if (most := max((self.saving(k, text[slice(*widened(text, a - n, b + n))]) for a, b in hits), default=0)) >= LEAST:
                out.append((-most, k))
        return [(-n, k) for n, k in sorted(out)]

    def confirmed(self, k: str, words: list[str], differ: float, taken: set) -> list[tuple]:
        """(differing words, first word, end) of a template's free spans that don't overlap, the fewest differing words first."""
        out, own = [], set(taken)
        for wrong, i, j in sorted(self.aligned(k, words, differ)):
            if own.isdisjoint(range(i, j)):
                own.update(range(i, j))
                out.append((wrong, i, j))
        return out

    def block(self, text: str, differ: float = 0.25) -> list[tuple]:
        """(start, template, reduction, differing words) of the confirmed spans, none of which overlap, in order."""
        if text not in self.known:
            self.room -= len(text)
            if self.room < 0:
                self.known.clear()
                self.room = 32 << 20
            at = [(m.start(), m.end()) for m in WORD.finditer(text)]
            words, out, taken, left = [text[x:y].lower() for x, y in at], [], set(), set(self.words)
            rest = text
            while ranked := self.ranked(rest, left):
                best = None
                for saved, k in ranked:
                    if best and saved < best[0] - NEAR:
                        break
                    if own := self.confirmed(k, words, differ, taken):
                        best = best or (saved, k, own)
                        best = (best[0], k, own) if own[0][0] < best[2][0][0] else best
                    else:
                        left.discard(k)  # its free spans become fewer, never more
                if not best:
                    break
                _, k, own = best
                for wrong, i, j in own:
                    if wrong > own[0][0]:
                        break  # another template may fit these better
                    taken.update(range(i, j))
                    out.append((at[i][0], k, self.gain(k, " ".join(text[at[i][0] : at[j - 1][1]].split())), wrong))
                rest = " ".join(text[x:y] for n, (x, y) in enumerate(at) if n not in taken)
            self.known[text] = sorted(out)
        return self.known[text]


def widened(text: str, a: int, b: int) -> tuple[int, int]:
    """The stretch of text with the words whole that it begins and ends in."""
    a, b = max(0, a), min(len(text), b)
    while a and not text[a - 1].isspace():
        a -= 1
    while b < len(text) and not text[b].isspace():
        b += 1
    return a, b


def blocks(text: str, reach: int) -> list[tuple[int, int]]:
    """The stretches of text within reach of a word of licensing, overlapping ones joined."""
    out: list = []
    for m in HINT.finditer(text):
        a, b = widened(text, m.start() - reach, m.end() + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_blocks, licenses array<string> sorted, found array<struct>) for every row, over whole texts.

    A block is a word of licensing with the text before and after it, as far as twice the longest template's
    length goes; blocks that overlap are one. Every confirmed span is told, with the line that it begins in and its own
    relative reduction; of spans that overlap, that of the template that saves the most bytes of the block, then the first name. A word
    with a digit, such as a version, must be the template's. Null and empty texts hold none; repeated rows are told each."""
    templates = TEMPLATES if templates is None else templates
    longest = 2 * max(map(len, templates.values()), default=0)
    item = pa.list_(pa.struct([("license", pa.string()), ("line", pa.int32()), ("reduction", pa.float64()), ("n_differ", pa.int32())]))

    def run(batches):
        scanner = Scanner(templates)
        for b in batches:
            found = []
            for text in b.column(1).to_pylist():
                own = []
                if text and templates and HINT.search(text):
                    line = seen = 0
                    for start, end in blocks(text, longest):
                        for place, name, gain, wrong in scanner.block(text[start:end]):
                            line, seen = line + text.count("\n", seen, start + place), start + place
                            own.append({"license": name, "line": line, "reduction": round(gain, 6), "n_differ": wrong})
                found.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([sorted({g["license"] for g in x}) for x in found], pa.list_(pa.string())), pa.array(found, item)], ["doc_id", "n_blocks", "licenses", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_rows(rows).mapInArrow(run, "doc_id long, n_blocks long, licenses array<string>, found array<struct<license string, line int, reduction double, n_differ int>>")
