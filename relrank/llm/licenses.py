"""License scans: templates with optional and replaceable regions, compiled into token automata.

Template markup, after the public license templates: ``<<beginOptional>> ... <<endOptional>>`` may be missing (regions
nest), ``<<var;name=...;match=.{a,b}>>`` stands for a to b words of any kind. All other words are mandatory and must
stand in the text one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.llm.common import LOWER, Rolling, byte_table, slices, texts, words

# Words are runs of digits, letters a-z (after lower-casing A-Z) and all characters beyond ASCII.
SEPARATORS = ~byte_table(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
MATCHES = "doc_id long, n_words long, matches array<struct<label: string, base: boolean, first: long, last: long>>"


@dataclass(frozen=True)
class Template:
    """``base``: one of the plain phrases that are counted."""

    label: str
    markup: str
    base: bool = False


def _numbered(number: str, text: str) -> str:
    return f"<<beginOptional>>{number}.<<endOptional>> {text}"


# Plain phrases, notices, and the public wording of whole licenses.
HOLDER = "<<var;name=holder;match=.{1,12}>>"
BSD_HEAD = (
    "Redistribution and use <<beginOptional>>of <<var;name=software;match=.{1,8}>><<endOptional>> in source and binary forms, with or "
    "without modification, are permitted provided that the following conditions are met: "
    + _numbered("1", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. ")
    + _numbered(
        "2",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. ",
    )
)
BSD_ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product "
    "includes software developed by <<var;name=organisation;match=.{1,16}>>. "
)
BSD_NAMES = (
    f"Neither the name of {HOLDER} nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
BSD_DISCLAIMER = (
    f"THIS SOFTWARE IS PROVIDED BY {HOLDER} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    f"{HOLDER} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    # Whole licenses.
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=software;match=.{1,8}>> and associated "
        'documentation files <<beginOptional>>(the "Software")<<endOptional>>, to deal in <<var;name=software;match=.{1,4}>> without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be "
        "included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        f"MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {HOLDER} BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, <<beginOptional>>and<<endOptional>> <<beginOptional>>/or<<endOptional>> distribute "
        "this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        f'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {HOLDER} DISCLAIMS ALL WARRANTIES WITH REGARD TO '
        f"THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {HOLDER} BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    Template("bsd-2", BSD_HEAD + BSD_DISCLAIMER),
    Template("bsd-3", BSD_HEAD + _numbered("3", BSD_NAMES) + BSD_DISCLAIMER),
    Template("bsd-4", BSD_HEAD + _numbered("3", BSD_ADVERTISING) + _numbered("4", BSD_NAMES) + BSD_DISCLAIMER),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        + _numbered("1", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. ")
        + "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        + _numbered("2", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. ")
        + _numbered("3", "This notice may not be removed or altered from any source distribution."),
    ),
    # Notices, which name a license without its text.
    Template(
        "apache-2",
        "Licensed under the Apache License <<beginOptional>>, Version<<endOptional>> 2 <<beginOptional>>.0<<endOptional>>",
    ),
    Template(
        "gpl",
        "under the terms of <<beginOptional>>version <<var;name=version;match=.{1,2}>> of<<endOptional>> the GNU "
        "<<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License",
    ),
    Template("mpl-2", "subject to the terms of the Mozilla Public License, v <<beginOptional>>ersion<<endOptional>> 2 <<beginOptional>>.0<<endOptional>>"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template(
        "cc-by",
        "Creative Commons Attribution <<beginOptional>><<var;name=version;match=.{1,2}>><<endOptional>> "
        "<<beginOptional>>International<<endOptional>> <<beginOptional>>Unported<<endOptional>> License",
    ),
    Template(
        "cc-by-nc",
        "Creative Commons Attribution NonCommercial <<beginOptional>><<var;name=version;match=.{1,2}>><<endOptional>> "
        "<<beginOptional>>International<<endOptional>> <<beginOptional>>Unported<<endOptional>> License",
    ),
)

_PART = re.compile(r"<<beginOptional>>|<<endOptional>>|<<var;[^>]*?match=\.\{(\d+),(\d+)\}>>|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")
ANY = -1


@dataclass
class Automaton:
    """States 0 .. n with steps over words (word number, or ANY) and free steps; state 0 starts, ``final`` accepts."""

    steps: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])
    free: list[set[int]] = field(default_factory=lambda: [set()])
    final: int = 0

    def _state(self) -> int:
        self.steps.append({})
        self.free.append(set())
        return len(self.steps) - 1

    def _word(self, at: int, word: int) -> int:
        to = self._state()
        self.steps[at].setdefault(word, []).append(to)
        return to

    @classmethod
    def of(cls, markup: str, numbers: dict[str, int]) -> Automaton:
        made, at, opened = cls(), 0, []
        lower = re.sub(r"<<.*?>>|[A-Z]", lambda m: m[0] if m[0][0] == "<" else m[0].lower(), markup)
        for part in _PART.finditer(lower):
            if part[0] == "<<beginOptional>>":
                opened.append(at)
            elif part[0] == "<<endOptional>>":
                if not opened:
                    raise ValueError(f"no region to end: {markup}")
                to = made._state()
                made.free[at].add(to)
                made.free[opened.pop()].add(to)
                at = to
            elif part[3] is None:
                least, most = int(part[1]), int(part[2])
                end = made._state()
                for i in range(most):
                    if i >= least:
                        made.free[at].add(end)
                    at = made._word(at, ANY)
                made.free[at].add(end)
                at = end
            else:
                at = made._word(at, numbers.setdefault(part[3], len(numbers)))
        if opened:
            raise ValueError(f"a region does not end: {markup}")
        made.final = at
        if at in made.closure({0}):
            raise ValueError(f"a template needs a mandatory word: {markup}")
        return made

    def closure(self, states: Iterable[int]) -> set[int]:
        found, waiting = set(), list(states)
        while waiting:
            state = waiting.pop()
            if state not in found:
                found.add(state)
                waiting.extend(self.free[state])
        return found

    def first_words(self) -> set[int]:
        found = {word for state in self.closure({0}) for word in self.steps[state]}
        if ANY in found:
            raise ValueError("a template must start with a mandatory word")
        return found

    def match(self, numbers: np.ndarray, start: int, end: int) -> int:
        """The end of the longest match that starts at ``start``, or -1."""
        states, longest = self.closure({0}), -1
        for at in range(start, end):
            word = int(numbers[at])
            states = self.closure(to for s in states for key in (word, ANY) for to in self.steps[s].get(key, ()))
            if not states:
                break
            if self.final in states:
                longest = at + 1
        return longest


class Scanner:
    def __init__(self, templates: Iterable[Template]):
        numbers: dict[str, int] = {}
        self.templates = [(t, Automaton.of(t.markup, numbers)) for t in templates]
        spelled = b"".join(w.encode() for w in numbers)
        ends = np.cumsum([len(w.encode()) for w in numbers])
        hashes = Rolling(np.frombuffer(spelled, np.uint8), 1).of(np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashes)
        self._hashes, self._numbers = hashes[order], order
        self._starts = np.zeros((len(self.templates), len(numbers) + 1), bool)
        for i, (_, automaton) in enumerate(self.templates):
            self._starts[i, list(automaton.first_words())] = True

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        """Words of each text, and its matches: label, base, first and last word."""
        rows = len(offsets) - 1
        lower = LOWER[data]
        starts, ends, text = words(lower, offsets, SEPARATORS)
        counts = np.bincount(text, minlength=rows)
        found: list[list[dict]] = [[] for _ in range(rows)]
        if not len(starts):
            return counts, found
        hashes = Rolling(lower, 1).of(starts, ends)
        at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        numbers = np.where(self._hashes[at] == hashes, self._numbers[at], len(self._numbers))  # the last: any other word
        first = np.cumsum(counts) - counts
        for (template, automaton), mark in zip(self.templates, self._starts):
            for i in np.flatnonzero(mark[numbers]).tolist():
                row = int(text[i])
                stop = automaton.match(numbers, i, int(first[row] + counts[row]))
                if stop > 0:
                    found[row].append({"label": template.label, "base": template.base, "first": i - int(first[row]), "last": stop - 1 - int(first[row])})
        return counts, found


def scan_licenses(docs: DataFrame, templates: Iterable[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and all matches of the templates in each row's whole text: label, base, first and last word.

    A template can match at several places, each counts; at one place the longest match does. Null and empty texts
    have 0 words and no match. Repeated rows and null ids give a row each; an empty table gives an empty result.
    """
    scanner = Scanner(templates)

    def scan(batches):
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64())]))
        for batch, data, offsets in slices(batches):
            counts, found = scanner.scan(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(found, kind)], ["doc_id", "n_words", "matches"])

    return texts(docs, id_col, text_col).mapInArrow(scan, MATCHES)


def _labels(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """One row per text: how often and where base phrases stand, the labels, and as score the part of the words that
    stand in a match."""
    matches = F.col("matches")
    base = F.filter(matches, lambda m: m["base"])
    starts = F.transform(base, lambda m: m["first"])
    # Words in the union of the spans, from their first to their last.
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["first"].alias("first"), m["last"].alias("last"))))
    none = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("words"))
    fresh = lambda s, m: F.greatest(F.lit(0), m["last"] - F.greatest(s["end"], m["first"] - 1))
    merge = lambda s, m: F.struct(F.greatest(s["end"], m["last"]).alias("end"), (s["words"] + fresh(s, m)).alias("words"))
    covered = F.aggregate(spans, none, merge, lambda s: s["words"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(matches).alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )
