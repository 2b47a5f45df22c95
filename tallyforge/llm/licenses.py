"""License scans: base phrases, and templates compiled to token automata.

A template is license wording with markup: `<<optional>> ... <<end>>` encloses words that may be missing, and
`<<var n>>` stands for any 0 to n words (names, years), though not among the first two. It is compiled to an automaton over words: mandatory words
are steps, an optional region is a step around it, a replaceable region is a bounded loop. A text is accepted where
some run of its words is read from the first state to the last, so all mandatory wording must be there, exactly and
in order; the earliest start that is accepted is taken, with the longest run from it, and the scan goes on after it. A
number with a dot is several words; a run may not end within one, so version 2 isn't read out of version 2.1.

Templates of license texts hold their whole wording but for the copyright line; templates of notices hold a notice, and
name a version only where the notice does. A label is given for a text that holds the wording; other wording beside it
isn't looked at.

Words are the maximal runs of characters that are neither ASCII punctuation, blank nor control characters, with A-Z
lower-cased. Base phrases are looked for in every text; the automata run where a template's first two words stand.

Nulls: a null text counts as empty: no words, no labels, score 0. Very long texts are scanned whole; an automaton
keeps one state set. Repeated rows give a row each. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, tidy

# Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of license texts and notices in common use, with markup for what may be missing or replaced.
_AS_IS = "is provided <<optional>> by <<var 12>> <<end>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_GPL = "<<optional>> program <<end>> <<optional>> file <<end>> <<optional>> library <<end>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
_GPL_END = "<<optional>> program <<end>> <<optional>> file <<end>> <<optional>> library <<end>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0 <<optional>> the license you may not use this file except in compliance with the license <<optional>> you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license <<end>> <<end>>",
    "bsd-2-clause": f"{_BSD} this software {_AS_IS}",
    "bsd-3-clause": f"{_BSD} <<optional>> 3 <<end>> neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software {_AS_IS}",
    "cc-by-4.0": "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by 4.0",
    "cc-by-nc-4.0": "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by nc 4.0",
    "cc-by-sa-4.0": "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by sa 4.0",
    "gpl-2.0": "licensed under the <<optional>> terms of the <<end>> gnu general public license <<optional>> as published by the free software foundation either <<end>> version 2 <<optional>> 0 <<end>> <<optional>> only <<end>>",
    "gpl-2.0-or-later": f"this {_GPL} either version 2 of the license or at your option any later version <<optional>> this {_GPL_END} <<end>>",
    "gpl-3.0": "licensed under the <<optional>> terms of the <<end>> gnu general public license <<optional>> as published by the free software foundation either <<end>> version 3 <<optional>> 0 <<end>> <<optional>> only <<end>>",
    "gpl-3.0-or-later": f"this {_GPL} either version 3 of the license or at your option any later version <<optional>> this {_GPL_END} <<end>>",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var 12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var 12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<optional>> 1 <<end>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<optional>> 2 <<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<optional>> 3 <<end>> this notice may not be removed or altered from any source distribution",
}

_INNER = np.ones(256, bool)  # bytes of words
_INNER[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """States 0 to n; from each, words that lead on, states reached without a word, and wildcard steps."""

    def __init__(self, template: str):
        self.steps: list[dict[bytes, int]] = [{}]
        self.free: list[list[int]] = [[]]
        self.any: list[int | None] = [None]
        opened: list[int] = []
        skips: list[int] = []
        for mark, count, text in re.findall(r"<<(optional|end|var)(?: (\d+))?>>|((?:(?!<<).)+)", template, re.S):
            if mark == "optional":
                opened.append(self._last)
            elif mark == "end":
                self.free[opened.pop()].append(self._last)
            elif mark == "var":
                for _ in range(int(count)):
                    at = self._last
                    skips.append(at)
                    self.any[at] = self._add()
                for k in skips:
                    self.free[k].append(self._last)
                skips = []
            else:
                for word in _WORD.findall(text.lower().encode()):
                    at = self._last
                    self.steps[at][word] = self._add()
        self.final = self._last
        #: First words of accepted runs, with those that may follow each.
        self.heads: dict[bytes, set[bytes]] = {}
        for k in self.reach({0}):
            for word, to in self.steps[k].items():
                for n in self.reach({to}):
                    self.heads.setdefault(word, set()).update(self.steps[n])

    @property
    def _last(self) -> int:
        return len(self.steps) - 1

    def _add(self) -> int:
        self.steps.append({})
        self.free.append([])
        self.any.append(None)
        return self._last

    def reach(self, states: set[int]) -> set[int]:
        seen, left = set(states), list(states)
        while left:
            for k in self.free[left.pop()]:
                if k not in seen:
                    seen.add(k)
                    left.append(k)
        return seen

    def accepts(self, words: list[bytes], at: int, goes_on: Callable[[int], bool]) -> int | None:
        """The end of the longest accepted run of words from `at`, or None.

        goes_on(k): whether the number that word k - 1 is part of goes on with word k, as 2 does in 2.1. A run may not end
        there: the text names another version than the template.
        """
        states = self.reach({0})
        longest = None
        while states:
            if self.final in states and not goes_on(at):
                longest = at
            if at >= len(words):
                break
            word = words[at]
            states = self.reach({n for k in states for n in (self.steps[k].get(word), self.any[k]) if n is not None})
            at += 1
        return longest


@lru_cache(1)
def _compiled() -> tuple[dict[str, Automaton], re.Pattern, list[tuple[re.Pattern, str]]]:
    automata = {name: Automaton(template) for name, template in sorted(TEMPLATES.items())}
    edge = rb"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])", rb"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
    pairs = sorted({(w, x) for a in automata.values() for w, then in a.heads.items() for x in then})
    starts = re.compile(edge[0] + b"(?:" + b"|".join(w + _GAP + x for w, x in pairs) + b")" + edge[1])
    phrases = [(re.compile(edge[0] + _GAP.join(p.encode().split()) + edge[1]), label) for p, label in PHRASES.items()]
    return automata, starts, phrases


def scan(low: bytes, start: np.ndarray) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base places and accepted templates of a lower-cased text, each (first word, last word + 1, label).

    start: byte positions of the words of the text.
    """
    automata, starts, phrases = _compiled()
    base = []
    for pattern, label in phrases:
        for found in pattern.finditer(low):
            k = int(np.searchsorted(start, found.start()))
            base.append((k, k + len(_WORD.findall(found[0])), label))
    accepted = []
    words: list[bytes] = []
    heads = [int(np.searchsorted(start, found.start())) for found in starts.finditer(low)]
    if heads:
        words = _WORD.findall(low)

    def goes_on(k: int) -> bool:
        if not 0 < k < len(words) or not (words[k - 1].isdigit() and words[k].isdigit()):
            return False
        stop = int(start[k - 1]) + len(words[k - 1])
        return low[stop : int(start[k])] == b"."

    for name, automaton in automata.items():
        after = 0
        for k in heads:
            if k >= after and words[k] in automaton.heads and (end := automaton.accepts(words, k, goes_on)) is not None:
                accepted.append((k, end, name))
                after = end
    return sorted(base), accepted


_FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def _scanned(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in slices(batch.column("text")):
                inner = np.zeros(len(data) + 1, bool)
                inner[1:] = _INNER[data]
                first = inner[1:] & ~inner[:-1]
                heads = at[:-1][np.diff(at) > 0]
                first[heads] = inner[1:][heads]
                start = np.flatnonzero(first)
                cut = np.searchsorted(start, at)
                low = data.tobytes().lower()
                rows = []
                for k in range(j - i):
                    base, accepted = scan(low[at[k] : at[k + 1]], start[cut[k] : cut[k + 1]] - at[k])
                    n = int(cut[k + 1] - cut[k])
                    covered = np.zeros(n, bool)
                    for a, b, _ in [*base, *accepted]:
                        covered[a:b] = True
                    labels = {x[2] for x in base}
                    score = 1.0 if accepted else 0.5 + 0.5 * float(covered.mean()) if base else 0.0
                    rows.append((n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {x[2] for x in accepted})), score))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in names), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FIELDS.values(), strict=True))], [*names, *_FIELDS])

    return run


def detect(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of docs, which has `text`, with n_words, n_base (places of base phrases), first_word and
    last_word (their smallest and largest start), base_labels, labels (with the templates' names) and score:
    1 where a template is accepted, else half and half the covered share of words where a phrase stands, else 0."""
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    needed = docs.select(*dict.fromkeys([*columns, "text"]))
    return needed.mapInArrow(tidy(_scanned(list(columns))), f"{kept}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def base_phrases(docs: DataFrame) -> DataFrame:
    """What the base phrases say, without the templates."""
    return detect(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _sql() -> str:
    """The base phrases in DuckDB's SQL."""
    places = [f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(p.split(), 1))})" for p in PHRASES]
    names = ", ".join(f"p{k}" for k in range(len(places)))
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"{p} AS p{k}" for k, p in enumerate(places))} FROM d),
q AS (SELECT doc_id, n_words, list_concat({names}) AS places, list_sort(list_filter([{labels}], lambda x: x IS NOT NULL)) AS labels FROM p)
SELECT doc_id, n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(labels, ',') AS base_labels FROM q
"""


#: The base phrases in DuckDB's SQL.
SQL = _sql()
