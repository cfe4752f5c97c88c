"""Licence scans: stretches of text compared with licence templates by Dice over word bigrams.

Stretches are single lines, paragraphs (between blank lines) and whole texts; where none of a document's matches a
template, all runs of words of any length are (a licence of several paragraphs in a longer text, or a notice that shares
its line). Words are runs of letters, digits and
bytes beyond ASCII, A-Z lower-cased. For bigram sets A and B of a stretch and a template

    dice = 2 |A & B| / (|A| + |B|)

and a stretch matches where dice >= ``least``. Sizes bound it: dice >= d needs |A| between d / (2 - d) |B| and
(2 - d) / d |B|, so a stretch is only held against templates of fitting size, and a stretch of fewer words than the
smallest fitting set has bigrams is skipped unread. The templates are few and fixed, so each task carries them; there
is no shuffle.

Defined results: null and empty texts match nothing; a stretch of one word has no bigrams; a line that holds a carriage
return isn't blank, so that a text of such line ends is one paragraph and its licences are found as runs of words; of stretches of a
document that match one template the best counts, of equal ones the first (lines, then paragraphs, then the whole, then
runs of words, kind ``passage``);
repeated rows are judged row by row; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linemill.llm._tokens import ALNUM, NOT_NEWLINE, U, Words, flat, grams, slices

LEAST = 0.8
#: The licences' notices and short texts.
TEMPLATES: dict[str, str] = {
    "MIT notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "all rights reserved": "Copyright. All rights reserved.",
}
_KINDS = ("line", "paragraph", "text", "passage")


class Templates:
    """Bigram sets as sorted hashes, with the sizes of stretches that can match each."""

    def __init__(self, texts: dict[str, str], least: float):
        self.names, self.least = list(texts), least
        self.sets = []
        for t in texts.values():
            data = np.frombuffer(t.encode(), np.uint8)
            self.sets.append(np.unique(grams(Words(data, np.array([0, len(data)]), ALNUM).hash, 2)))
        # A little outward, as a bound that is rounded inward loses stretches right at it; dice itself decides.
        self.low = np.array([least / (2 - least) * len(s) - 1e-6 for s in self.sets])
        self.high = np.array([(2 - least) / least * len(s) + 1e-6 for s in self.sets])
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, U)
        self.member = np.stack([np.isin(self.known, s) for s in self.sets]) if self.sets else np.zeros((0, 0), bool)


def _stretches(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, limits): byte limits of the stretches, by kind."""
    lines = Words(data, at, NOT_NEWLINE)
    yield 0, np.stack((lines.start, lines.end), axis=1)
    # Lines are of one paragraph while only one line feed parts them.
    text = lines.text_of()
    first = np.flatnonzero(np.concatenate(([True], (lines.start[1:] - lines.end[:-1] > 1) | (text[1:] != text[:-1])))) if len(lines) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(lines)) - 1 if len(first) else first
    several = first < last
    yield 1, np.stack((lines.start[first[several]], lines.end[last[several]]), axis=1)
    yield 2, np.stack((at[:-1], at[1:]), axis=1)


def _best_passage(gram: np.ndarray, inside: np.ndarray, size: int, templates: Templates, t: int) -> tuple[float, int]:
    """(dice, bigrams) of the run of words that is most like template t; gram: a document's bigrams, inside: the template's.

    Only runs that begin and end with a bigram of the template can be best, and none whose first bigram comes again, so
    all runs together are at most as long as the text times the template, whatever repeats.
    """
    _, gram = np.unique(gram, return_inverse=True)
    starts = np.flatnonzero(inside)
    order = np.lexsort((starts, gram[starts]))
    until = np.full(len(starts), len(gram))
    again = gram[starts[order[1:]]] == gram[starts[order[:-1]]]
    until[order[:-1][again]] = starts[order[1:][again]]
    enough = np.searchsorted(starts, until) - np.arange(len(starts)) >= templates.low[t]
    gram, inside, best = gram.tolist(), inside.tolist(), (0.0, 0)
    for a, end in zip(starts[enough].tolist(), until[enough].tolist(), strict=True):
        seen, both = set(), 0
        for j in range(a, end):
            if gram[j] in seen:
                continue
            seen.add(gram[j])
            if len(seen) > templates.high[t]:
                break
            if inside[j]:
                both += 1
                best = max(best, (2 * both / (len(seen) + size), len(seen)), key=lambda x: x[0])
                if both == size:
                    break
    return best


def _scan(batches: Iterator[pa.RecordBatch], templates: Templates) -> Iterator[pa.RecordBatch]:
    schema = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("kind", pa.string()), ("n_bigrams", pa.int64())])
    for batch in batches:
        for part in slices(batch, "text"):
            data, at = flat(part["text"])
            words = Words(data, at, ALNUM)
            pair = grams(words.hash, 2)
            where = np.searchsorted(templates.known, pair)
            where[where == len(templates.known)] = 0
            known = (templates.known[where] == pair) if len(templates.known) else np.zeros(len(pair), bool)
            seen = np.concatenate(([0], np.cumsum(known)))
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for kind, limits in _stretches(data, at):
                lo, hi = np.searchsorted(words.start, limits[:, 0]), np.searchsorted(words.start, limits[:, 1])
                n = hi - lo - 1  # bigrams, repeats included
                need = min(templates.low, default=np.inf)
                # At least half of (the least fitting size times dice) has to be known.
                begin = np.minimum(lo, len(seen) - 1)
                able = np.flatnonzero((n >= need) & (seen[np.maximum(hi - 1, begin)] - seen[begin] >= need * templates.least / 2))
                owner = np.searchsorted(at, limits[able, 0], side="right") - 1 if kind < 2 else able
                for i, doc in zip(able, owner, strict=True):
                    found = np.unique(pair[lo[i] : hi[i] - 1])
                    fit = np.flatnonzero((templates.low <= len(found)) & (len(found) <= templates.high))
                    if not len(fit):
                        continue
                    index = np.searchsorted(templates.known, found)
                    index[index == len(templates.known)] = 0
                    hit = index[templates.known[index] == found]
                    for t in fit:
                        both = int(templates.member[t, hit].sum())
                        dice = 2 * both / (len(found) + len(templates.sets[t]))
                        if dice >= templates.least and dice > best.get((int(doc), int(t)), (0.0, 0, 0))[0]:
                            best[int(doc), int(t)] = (dice, kind, len(found))
            # Documents with enough different bigrams of a template that no stretch matched.
            at_known = np.flatnonzero(known)
            at_known = at_known[at_known + 1 < words.of_text[words.text_of()[at_known] + 1]] if len(at_known) else at_known
            different = np.unique(words.text_of()[at_known].astype(np.int64) * len(templates.known) + where[at_known])
            for t, members in enumerate(templates.sets):
                often = np.bincount((different // max(1, len(templates.known)))[templates.member[t, different % max(1, len(templates.known))]], minlength=part.num_rows)
                for doc in np.flatnonzero(often >= max(1, templates.low[t])) if len(members) else ():
                    if (int(doc), t) in best:
                        continue
                    lo, hi = words.of_text[doc], words.of_text[doc + 1] - 1
                    dice, n_ = _best_passage(pair[lo:hi], known[lo:hi] & templates.member[t, where[lo:hi]], len(members), templates, t)
                    if dice >= templates.least:
                        best[int(doc), t] = (dice, 3, n_)
            matches: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for (doc, t), (dice, kind, n_) in sorted(best.items(), key=lambda x: (x[0][0], -x[1][0], templates.names[x[0][1]])):
                matches[doc].append({"license": templates.names[t], "dice": dice, "kind": _KINDS[kind], "n_bigrams": n_})
            yield pa.record_batch([part["doc_id"], pa.array(matches, pa.list_(schema))], names=["doc_id", "matches"])


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, matches): array of (license, dice, kind, n_bigrams), best first, of each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates, least))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _scan(b, shared.value), "doc_id long, matches array<struct<license:string,dice:double,kind:string,n_bigrams:long>>")


def license_report(docs: DataFrame) -> DataFrame:
    found = scan_licenses(docs)
    best = F.get("matches", 0)
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_licenses"), best["license"].alias("license"), F.round(best["dice"], 6).alias("dice"),
        best["kind"].alias("kind"), F.array_join(F.array_sort(F.transform("matches", lambda m: m["license"])), ",").alias("licenses"),
    )


def brute_force(text: str | None, templates: dict[str, str], least: float) -> list[tuple[str, float]]:
    """The definition, for tests: (license, dice), best first."""
    def bigrams(t: str) -> set:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return set(zip(w, w[1:], strict=False))

    text = text or ""
    pieces = [x for x in text.split("\n") if x] + [p for p in re.split(r"\n(?:\n)+", text) if "\n" in p.strip("\n")] + [text]
    out = {}
    for name, t in templates.items():
        b = bigrams(t)
        for p in pieces:
            a = bigrams(p)
            d = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if d >= least and d > out.get(name, 0):
                out[name] = d
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))
