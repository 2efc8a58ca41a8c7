"""License scan by patience alignment against license templates.

Text and template are lower-case words.  Words that are unique in both are anchors; the longest subsequence of anchors
that rises in both is kept, and the gaps between kept anchors are aligned the same way; where no word is unique, equal
words at both ends of the gap match.  Coverage is the matched part of the template.

A text can hold a notice several times, which leaves it no unique words.  So stretches of at most twice the template's
length that hold enough of its words, each as often as both hold it, are aligned one by one, from left to right; no
alignment matches more words than that.  A stretch that covers enough may begin in the prose before the notice and end
within it, so it is aligned again around the place where most matched words say that the template begins, for as long as
more words match.  Where templates match the same words, the one counts whose matched words most exceed its missing ones,
then the one better covered.  A license that is often quoted without its warranty has a template with it and one without.

Each row is handled in its own task, without a shuffle.  Defined cases: a null or empty text has no findings; texts are
read whole; equal templates are reported under the name first in order; repeated rows give repeated findings.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame

from .common import keyed_texts, map_batches

COVERAGE = 0.8
TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

# Public wordings of license notices.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.")
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.")
_BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu(work: str, license: str, version: str, address: str) -> str:
    """The notice that the GNU licenses ask for at the head of each file."""
    return (
        f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {license} "
        f"General Public License as published by the Free Software Foundation; either version {version} of the License, or "
        f"(at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        f"GNU {license} General Public License for more details. You should have received a copy of the GNU {license} "
        f"General Public License along with this {work}; if not, {address}")


_FSF = "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_SEE = "see https://www.gnu.org/licenses/."

TEMPLATES = {
    "agpl-3.0-header": _gnu("program", "Affero", "3", _SEE),
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "bsd-2-clause": _BSD + _BSD_WARRANTY,
    "bsd-2-clause-conditions": _BSD,
    "bsd-3-clause": _BSD + _BSD_NAMES + _BSD_WARRANTY,
    "bsd-3-clause-conditions": _BSD + _BSD_NAMES,
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "gpl-2.0-header": _gnu("program", "", "2", _FSF),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": _gnu("program", "", "3", _SEE),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."),
    "lgpl-2.1-header": _gnu("library", "Lesser", "2.1", _FSF),
    "lgpl-3.0-header": _gnu("library", "Lesser", "3", _SEE),
    "mit": "Released under the MIT License",
    "mit-grant": _MIT,
    "mit-text": _MIT + (
        " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."),
}


def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, given by rising first place, whose second places rise too (patience sorting)."""
    tops: list[int] = []  # second place on top of each pile
    top_pair: list[int] = []
    back: list[int] = []
    for i, (_, second) in enumerate(pairs):
        pile = bisect_left(tops, second)
        back.append(top_pair[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(second)
            top_pair.append(i)
        else:
            tops[pile], top_pair[pile] = second, i
    out, i = [], top_pair[-1] if top_pair else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (text, template) by patience alignment; both rise."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        lo, hi, low, high = gaps.pop()
        while lo < hi and low < high and text[lo] == template[low]:
            matched.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and text[hi - 1] == template[high - 1]:
            hi, high = hi - 1, high - 1
            matched.append((hi, high))
        if lo == hi or low == high:
            continue
        count, own = Counter(text[lo:hi]), Counter(template[low:high])
        at = {w: i for i, w in enumerate(template[low:high], low) if own[w] == 1}
        anchors = rising([(i, at[w]) for i, w in enumerate(text[lo:hi], lo) if w in at and count[w] == 1])
        if anchors:
            matched += anchors
            ends = [(lo - 1, low - 1), *anchors, (hi, high)]
            gaps += [(a + 1, c, b + 1, d) for (a, b), (c, d) in zip(ends, ends[1:], strict=False)]
    return sorted(matched)


def begins(matched: list[tuple[int, int]]) -> int:
    """Where the template begins in the text, by the middle one of the matched pairs' differences."""
    return sorted(i - j for i, j in matched)[len(matched) // 2]


def merit(matched: list[tuple[int, int]]) -> tuple[int, int]:
    """More matched words first, then fewer words of the text around them."""
    return len(matched), matched[0][0] - matched[-1][0]


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words(text)
        self.own = Counter(self.words)

    def within(self, count: Counter) -> int:
        """Words of the template that a text with these counts can match at most."""
        return sum(min(n, count[w]) for w, n in self.own.items())

    def whole(self, text: list[str], matched: list[tuple[int, int]], after: int) -> list[tuple[int, int]]:
        """The alignment of the notice that a first alignment has met, which may be only a part of it.

        Stretches around the place where the template begins are aligned, narrow ones too, as a neighbouring copy leaves a
        wide one without unique words; words before ``after`` belong to an earlier notice.
        """
        size = len(self.words)
        while True:
            at, best = begins(matched), matched
            for slack in (0, size // 16, size // 4, size // 2):
                lo, hi = max(after, at - slack), at + size + slack
                found = [(i + lo, j) for i, j in align(text[lo:hi], self.words)]
                if found and merit(found) > merit(best):
                    best = found
            if best is matched:
                return matched
            matched = best

    def findings(self, text: list[str], least: float) -> list[tuple[int, int, int, str]]:
        """(matched words, first word, end, name) of each place in the text that covers enough of the template."""
        needed, own = least * len(self.words), self.own
        places = [i for i, w in enumerate(text) if w in own]
        out, first, last, inside, after = [], 0, 0, Counter(), 0
        held = 0  # within(inside)
        reach = 2 * len(self.words)
        while first < len(places):
            while last < len(places) and places[last] < places[first] + reach:
                word = text[places[last]]
                inside[word] += 1
                held += inside[word] <= own[word]
                last += 1
            done = places[first] + 1
            if held >= needed:
                start, end = places[first], places[last - 1] + 1
                matched = [(i + start, j) for i, j in align(text[start:end], self.words)]
                if len(matched) >= needed:
                    matched = self.whole(text, matched, after)
                    after = matched[-1][0] + 1
                    done = max(done, after)
                    out.append((len(matched), matched[0][0], after, self.name))
            while first < len(places) and places[first] < done:
                word = text[places[first]]
                held -= inside[word] <= own[word]
                inside[word] -= 1
                first += 1
        return out


def scan(text: str, templates: list[Template], least: float) -> list[dict]:
    """Findings of one text that overlap no better one."""
    found, tokens = [], words(text)
    count = Counter(tokens)
    for t in templates:
        if t.within(count) >= least * len(t.words):
            size = len(t.words)
            found += [(size - 2 * n, -n / size, name, start, end) for n, start, end, name in t.findings(tokens, least)]
    out: list[dict] = []
    for _, part, name, start, end in sorted(found):
        if all(end <= o["start"] or o["end"] <= start for o in out):
            out.append({"license": name, "coverage": -part, "start": start, "end": end})
    return sorted(out, key=lambda o: o["start"])


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
                  text_col: str = "text", least: float = COVERAGE) -> DataFrame:
    """One row per notice found: doc_id, license, coverage, start, end (words of the text)."""
    known = [Template(name, text) for name, text in sorted((templates or TEMPLATES).items())]
    known = [t for t in known if t.words]

    def work(key: list, text: list[str]) -> dict | None:
        found = [(k, f) for k, t in zip(key, text, strict=True) for f in scan(t, known, least)]
        if not found:
            return None
        return {"doc_id": [k for k, _ in found],
                **{name: [f[name] for _, f in found] for name in ("license", "coverage", "start", "end")}}

    return map_batches(keyed_texts(docs, id_col, text_col), lambda: work,
                       "doc_id long, license string, coverage double, start int, end int")
