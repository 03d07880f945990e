"""License scans by conditional compression.

Candidate blocks are runs of sentences or lines with a word that licence notices
use. A block is compressed with zstandard by itself and with each licence template
(notices, headers, whole texts) as raw dictionary; templates are ranked by how much
smaller the block gets. All are confirmed by wording: for every phrase of a template the
stretches of words that overlap the block and differ least from it, words added and words
left out counted alike. A stretch counts if few words differ, every word that tells the
licence apart (name, version, clauses) is there and no word of that kind which the phrase
lacks. Of stretches that overlap the one with the most agreeing words stays; gains decide
between equals. BSD's opening is BSD-3-Clause where the third clause follows before
another opening.

Nothing has a bound on its length: a block is as long as its sentences, a stretch may go
on before and behind it by the longest phrase. Null and empty texts have no blocks. Every
block has a row for each of its stretches, and one where no licence is confirmed (license
is null then). Repeated rows have their blocks each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common

#: Names of licences as notices write them, and the words that tell each apart.
NAMES = {
    "Apache-2.0": (["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], "apache 2.0"),
    "MIT": (["MIT License", "MIT license (MIT)"], "mit"),
    "BSD-2-Clause": (["BSD 2-Clause License", "Simplified BSD License"], "bsd"),
    "BSD-3-Clause": (["BSD 3-Clause License", "New BSD License", "Modified BSD License"], "bsd"),
    "GPL-2.0": (["GNU General Public License, version 2", "GNU GPL v2", "GPL version 2"], "2"),
    "GPL-3.0": (["GNU General Public License, version 3", "GNU GPL v3", "GPL version 3"], "3"),
    "LGPL-2.1": (["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"], "2.1"),
    "LGPL-3.0": (["GNU Lesser General Public License, version 3", "GNU LGPL v3"], "3"),
    "AGPL-3.0": (["GNU Affero General Public License, version 3", "GNU AGPL v3"], "3"),
    "MPL-2.0": (["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"], "2.0"),
    "ISC": (["ISC License"], "isc"),
    "Unlicense": (["The Unlicense"], "unlicense"),
    "CC0-1.0": (["CC0 1.0 Universal", "Creative Commons Zero 1.0"], "1.0"),
    "CC-BY-4.0": (["CC BY 4.0", "Creative Commons Attribution 4.0 International License"], "4.0"),
    "CC-BY-SA-4.0": (["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"], "4.0"),
    "CC-BY-NC-4.0": (["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"], "4.0"),
    "CC-BY-ND-4.0": (["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"], "4.0"),
}
#: How a notice grants a licence.
GRANTS = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This program is distributed under the terms of the {}.", "This file is subject to the terms of the {}.", "Distributed under the {}, see the accompanying file LICENSE.")
#: Opening sentences of licence texts.
OPENINGS = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
}
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
#: Titles of full licence texts and standard headers of files.
HEADERS = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004"],
    "MIT": ["The MIT License (MIT)"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _GNU.format("General Public License", "2")],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format("General Public License", "3")],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _GNU.format("Lesser General Public License", "2.1")],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format("Lesser General Public License", "3")],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _GNU.format("Affero General Public License", "3")],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC0-1.0": ["Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International Public License"],
}
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole texts of licences, without the line that names the holder.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD_TWO + _BSD_END,
    "BSD-3-Clause": _BSD_TWO + _BSD_THREE + _BSD_END,
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
#: Fixed value: what BSD's third clause says, in lower-case words.
THIRD_CLAUSE = "may be used to endorse or promote products derived from this software"
TRIGGER = re.compile(r"(?i)licen[cs]|copyright|permission|warrant|redistribut|public domain|creative commons|\bCC[ -]?(?:BY|0)|\bSPDX|\b[al]?gpl|\bMPL\b|(?:released|distributed) under|terms of the|unlicen")
_END = re.compile(r"[.!?](?=\s)|\n")
_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
#: Words that tell one licence from another.
TELLING = set("apache mit bsd gnu gpl lgpl agpl mozilla mpl isc unlicense cc cc0 sa nc nd lesser affero sharealike noncommercial noderivatives simplified 1.0 2 2.0 2.1 3 4.0 v2 v2.1 v3".split())
#: So many of a phrase's words may differ.
MOST_DIFFERENT = 0.34
#: Blocks that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 100_000, 4096


def phrases() -> dict[str, list[str]]:
    return {k: [g.format(n) for g in GRANTS for n in names] + OPENINGS.get(k, []) + HEADERS.get(k, []) + ([TEXTS[k]] if k in TEXTS else []) for k, (names, _) in NAMES.items()}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, stop): runs of sentences or lines that hold a trigger word."""
    start = stop = None
    for hit in TRIGGER.finditer(text):
        if stop is not None and hit.start() < stop:
            continue
        a, behind = stop or 0, hit.start()
        a = max(a, text.rfind("\n", a, behind) + 1, *((at + 2 if (at := text.rfind(e, a, behind)) >= 0 else 0) for e in (". ", "! ", "? ")))
        end = found.end() if (found := _END.search(text, hit.end())) else len(text)
        if stop is not None and not text[stop:a].strip():
            stop = end
        else:
            if start is not None:
                yield start, stop
            start, stop = a, end
    if start is not None:
        yield start, stop


def differences(a: list[str], b: list[str]) -> int:
    """Words of either that aren't in a longest common subsequence of both."""
    return len(differing(a, b))


def differing(a: list[str], b: list[str]) -> list[str]:
    """Words of a that b lacks (-word) and words that it has beside (+word), by a longest common subsequence."""
    long = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    at = np.array(b, object)
    for i, w in enumerate(a, 1):
        long[i, 1:] = np.maximum(long[i - 1, 1:], np.where(at == w, long[i - 1, :-1] + 1, 0))
        long[i] = np.maximum.accumulate(long[i])
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif j and (not i or long[i, j - 1] >= long[i - 1, j]):
            j -= 1
            out.append("+" + b[j])
        else:
            i -= 1
            out.append("-" + a[i])
    return out[::-1]


def _distances(own: np.ndarray, text: np.ndarray, anchored: bool) -> np.ndarray:
    """For each length of text the least number of words added or left out between own and a stretch that ends there; anchored: that begins at its start."""
    place = np.arange(len(own) + 1)
    row, out = place.copy(), np.empty(len(text) + 1, np.int64)
    out[0] = row[-1]
    for j, w in enumerate(text, 1):
        new = row + 1
        new[0] = j if anchored else 0
        new[1:] = np.minimum(new[1:], np.where(own == w, row[:-1], len(own) + j))
        row = np.minimum.accumulate(new - place) + place
        out[j] = row[-1]
    return out


def closest(own: np.ndarray, text: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(differing words, start, stop) of stretches of text that differ from own by `most` words or fewer, the closest first, the others beside it."""
    todo = [(0, len(text))]
    while todo:
        low, high = todo.pop()
        if high - low < len(own) - most:
            continue
        far = _distances(own, text[low:high], False)
        stop = int(far.argmin())
        if far[stop] <= most:
            back = _distances(own[::-1], text[low : low + stop][::-1], True)
            start = low + stop - int(back.argmin())
            yield int(far[stop]), start, low + stop
            todo += [(low, start), (low + stop, high)]


class Scanner:
    """more: further whole texts of licences by name."""

    def __init__(self, more: dict[str, str] | None = None):
        given = phrases()
        for k, text in (more or {}).items():
            given.setdefault(k, []).append(text)
        self.number: dict[str, int] = {}
        self.phrases = {k: [(own, np.array([self.number.setdefault(w, len(self.number)) for w in own])) for own in map(words_of, ps)] for k, ps in given.items()}
        self.reach = 4 * max(len(own) for ps in self.phrases.values() for own, _ in ps) // 3
        self.plain = zstandard.ZstdCompressor(level=6, write_content_size=False)
        self.given = {k: zstandard.ZstdCompressor(level=6, write_content_size=False, dict_data=zstandard.ZstdCompressionDict("\n".join(ps).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, ps in given.items()}
        self.bsd = words_of(OPENINGS["BSD-2-Clause"][0])
        self.seen: dict[tuple, tuple] = {}

    def gains(self, block: str) -> dict[str, float]:
        """How much smaller the block gets by each template."""
        raw = block.encode()
        alone = len(self.plain.compress(raw))
        return {k: 1 - len(c.compress(raw)) / alone for k, c in self.given.items()}

    def __call__(self, block: str) -> tuple[str | None, float, int | None, str | None]:
        """The first licence of a text that is one block."""
        return next(iter(self.scan(block)), (0, block, None, 0.0, None, None))[2:]

    def scan(self, text: str) -> list[tuple[int, str, str | None, float, int | None, str | None]]:
        """(start, block, licence, gain of its template, number of differing words, the words) of every stretch of every block; one row of nulls and the best gain for a block without."""
        out: list[tuple] = []
        spans = list(blocks(text))
        if not spans:
            return out
        found = list(_WORD.finditer(text))
        words, starts = [m[0].lower() for m in found], [m.start() for m in found]
        free = 0  # words before are part of an earlier stretch
        for start, stop in spans:
            block = text[start:stop].rstrip()
            first, last = bisect_left(starts, start), bisect_left(starts, stop)
            low, high = max(free, first - self.reach), min(len(words), last + self.reach)
            key = (block, tuple(words[low:first]), tuple(words[last:high])) if len(block) <= LONGEST else None
            if (known := self.seen.get(key)) is None:
                gains = self.gains(block)
                taken: list[tuple[int, int, str, int, list[str]]] = []
                for d, p, q, name, own in sorted(self._stretches(words[low:high], first - low, last - low), key=lambda x: (2 * x[0] - len(x[4]), -gains[x[3]], x[3], x[1])):
                    if all(q <= a or b <= p for a, b, *_ in taken):
                        taken.append((p, q, name, d, own))
                rows = [(name, gains[name], d, " ".join(differing(own, words[low + p : low + q])), own == self.bsd, p) for p, q, name, d, own in sorted(taken, key=lambda x: x[:2])]
                known = (rows, max((b for _, b, *_ in taken), default=0), max(gains.values()))
                if key is not None:
                    if len(self.seen) > REMEMBERED:
                        self.seen.clear()
                    self.seen[key] = known
            rows, end, best = known
            free = max(free, low + end)
            out += [(start, block, self._bsd(words, low + p) if opens else name, gain, d, which) for name, gain, d, which, opens, p in rows] or [(start, block, None, best, None, None)]
        return out

    def _stretches(self, words: list[str], first: int, last: int) -> Iterator[tuple[int, int, int, str, list[str]]]:
        """(differing words, start, stop, licence, phrase) of stretches that overlap the words from first to last."""
        there, numbers = set(words), np.array([self.number.get(w, -1) for w in words])
        for name, ps in self.phrases.items():
            for own, ids in ps:
                needed, held, size = TELLING.intersection(own), set(own), len(own)
                most = int(MOST_DIFFERENT * size)
                if not needed <= there or len(held & there) < len(held) - most:
                    continue
                wide = size + most
                so_far = np.concatenate([[0], np.cumsum(np.isin(numbers, ids))])
                ends = np.minimum(np.arange(len(words)) + wide, len(words))
                some = np.flatnonzero(so_far[ends] - so_far[:-1] >= size - most)  # a stretch may begin here
                if not len(some):
                    continue
                cut = np.flatnonzero(np.diff(some) > wide) + 1
                for a, b in zip(some[np.concatenate([[0], cut])], ends[some[np.concatenate([cut - 1, [len(some) - 1]])]], strict=True):
                    for d, p, q in closest(ids, numbers[a:b], most):
                        p, q = a + p, a + q
                        if p < last and q > first and TELLING.intersection(words[p:q]) == needed:
                            yield d, int(p), int(q), name, own

    def _bsd(self, words: list[str], at: int) -> str:
        """Which BSD licence opens at a word, by whether the third clause comes before another opening."""
        opening, rest = self.bsd[:6], words[at + 6 :]
        clause = THIRD_CLAUSE.split()
        for i, w in enumerate(rest):
            if w == clause[0] and rest[i : i + len(clause)] == clause:
                return "BSD-3-Clause"
            if w == opening[0] and rest[i : i + 6] == opening:
                break
        return "BSD-2-Clause"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: dict[str, str] | None = None) -> DataFrame:
    """doc_id, start (in characters), block, license, gain, n_differences, differing (the words: -left out, +added), exact for every licence in a candidate block, or for the block. more: further whole texts of licences by name."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(more)
        for whole in batches:
            for batch in common.slices(whole):
                ids, rows = [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    found = scanner.scan(text)
                    ids += [doc_id] * len(found)
                    rows += found
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.string()), pa.array([d == 0 for d in cols[4]], pa.bool_())], names=["doc_id", "start", "block", "license", "gain", "n_differences", "differing", "exact"])

    return common.keyed(docs, id_col, text_col).mapInArrow(work, "doc_id long, start long, block string, license string, gain double, n_differences long, differing string, exact boolean")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))
