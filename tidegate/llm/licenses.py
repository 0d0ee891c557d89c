"""License scans: template markup compiled into token automata that accept texts whose mandatory wording is exact.

Markup of a template, between words (letters and digits; case and punctuation do not matter):

    <<optional>> ... <</optional>>   a part that may be left out as a whole; parts may be nested
    <<any N>>                        a replaceable region of up to N words

A template starts with a mandatory or optional word, not with a replaceable region.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegate.llm.words import NOT_ALNUM, Words, slices

#: Phrases that give the base labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Labels of the method and their templates: notices, whole texts, file headers, key clauses and tags of public
#: licenses (fixed wording).
TEMPLATES = {
    "mit-notice": "<<optional>>this <<any 3>> is<</optional>> released under the <<optional>>terms of the<</optional>> "
                  "mit license",
    "apache-2.0-notice": "licensed under the apache license <<optional>>version<</optional>> 2 0",
    "gpl-3.0-notice": "licensed under the <<optional>>terms of the<</optional>> gnu general public license "
                      "<<optional>>as published by the free software foundation<</optional>> "
                      "<<optional>>either<</optional>> version 3 "
                      "<<optional>>of the license<</optional>> "
                      "<<optional>>or <<optional>>at your option<</optional>> any later version<</optional>>",
    "cc-by-nc-4.0-notice": "licensed under <<optional>>a<</optional>> <<optional>>creative commons<</optional>> "
                           "cc by nc 4 0",
    "mit-text":
        "permission is hereby granted free of charge to any person obtaining a copy of <<any 4>> software and "
        "associated documentation files the software to deal in the software without restriction including without "
        "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
        "software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> "
        "shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall <<any 10>> be liable "
        "for any claim damages or other liability whether in an action of contract tort or otherwise arising from out "
        "of or in connection with the software or the use or other dealings in the software",
    "isc-text":
        "permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with "
        "or without fee is hereby granted provided that the above copyright notice and this permission notice appear "
        "in all copies the software is provided as is and <<any 10>> disclaims all warranties with regard to this "
        "software including all implied warranties of merchantability and fitness in no event shall <<any 10>> be "
        "liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss "
        "of use data or profits whether in an action of contract negligence or other tortious action arising out of or "
        "in connection with the use or performance of this software",
    "bsd-2-clause-text":
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met <<optional>>1<</optional>> redistributions of source code must retain the "
        "above copyright notice this list of conditions and the following disclaimer <<optional>>2<</optional>> "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution this software "
        "is provided by <<any 12>> as is and any express or implied warranties including but not limited to the "
        "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
        "<<any 12>> be liable for any direct indirect incidental special exemplary or consequential damages including "
        "but not limited to procurement of substitute goods or services loss of use data or profits or business "
        "interruption however caused and on any theory of liability whether in contract strict liability or tort "
        "including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage",
    "bsd-3-clause-text":
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met <<optional>>1<</optional>> redistributions of source code must retain the "
        "above copyright notice this list of conditions and the following disclaimer <<optional>>2<</optional>> "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution "
        "<<optional>>3<</optional>> neither the name of <<any 12>> nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission this software "
        "is provided by <<any 12>> as is and any express or implied warranties including but not limited to the "
        "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
        "<<any 12>> be liable for any direct indirect incidental special exemplary or consequential damages including "
        "but not limited to procurement of substitute goods or services loss of use data or profits or business "
        "interruption however caused and on any theory of liability whether in contract strict liability or tort "
        "including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage",
    "apache-2.0-header":
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at <<optional>>http<</optional>> <<optional>>https<</optional>> "
        "www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations "
        "under the license",
    "gpl-2.0-header":
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation <<optional>>either<</optional>> version 2 of the "
        "license <<optional>>or at your option any later version<</optional>> this program is distributed in the hope "
        "that it will be useful but without any warranty without even the implied warranty of merchantability or "
        "fitness for a particular purpose see the gnu general public license for more details",
    "gpl-3.0-header":
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation <<optional>>either<</optional>> version 3 of the "
        "license <<optional>>or at your option any later version<</optional>> this program is distributed in the hope "
        "that it will be useful but without any warranty without even the implied warranty of merchantability or "
        "fitness for a particular purpose see the gnu general public license for more details",
    "mit-clause": "permission is hereby granted free of charge to any person obtaining a copy of <<any 4>> software "
                  "and associated documentation files the software to deal in the software without restriction",
    "apache-clause": "you may not use this file except in compliance with the license",
    "bsd-clause": "redistribution and use in source and binary forms with or without modification are permitted "
                  "provided that the following conditions are met",
    "gpl-clause": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                  "<<optional>>lesser<</optional>> general public license",
    "spdx-mit": "spdx license identifier mit",
    "spdx-isc": "spdx license identifier isc",
    "spdx-bsd-2-clause": "spdx license identifier bsd 2 clause",
    "spdx-bsd-3-clause": "spdx license identifier bsd 3 clause",
    "spdx-apache-2.0": "spdx license identifier apache 2 0",
    "spdx-gpl-2.0": "spdx license identifier gpl 2 0 <<optional>>only<</optional>> <<optional>>or later<</optional>>",
    "spdx-gpl-3.0": "spdx license identifier gpl 3 0 <<optional>>only<</optional>> <<optional>>or later<</optional>>",
}

#: Labels of single clauses: the wording after them is not looked at, so they alone do not name a license.
CLAUSES = frozenset({"mit-clause", "apache-clause", "bsd-clause", "gpl-clause"})

MARKUP = re.compile(r"<<(/?optional|any \d+)>>|([^\W_]+)")


def parsed(template: str) -> list:
    """Words as strings, replaceable regions as their number of words, optional parts as lists."""
    stack: list[list] = [[]]
    for markup, word in MARKUP.findall(template.lower()):
        if markup == "optional":
            stack.append([])
        elif markup == "/optional":
            part = stack.pop()
            stack[-1].append(part)
        else:
            stack[-1].append(int(markup[4:]) if markup else word)
    if len(stack) != 1:
        raise ValueError(f"an optional part is not closed: {template}")
    return stack[0]


class Automaton:
    """States are numbers; a step on a word follows its edge or the edge of a replaceable region."""

    def __init__(self, template: str):
        self.edges: list[dict[str | None, int]] = [{}]
        self.skips: list[list[int]] = [[]]
        self.end = self._add(parsed(template), 0)
        self.first = {word for state in self._closed({0}) for word in self.edges[state]}
        if None in self.first or self.end in self._closed({0}):
            raise ValueError(f"a template must start with a word: {template}")

    def _state(self) -> int:
        self.edges.append({})
        self.skips.append([])
        return len(self.edges) - 1

    def _add(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, list):
                inner = self._state()
                self.skips[at].append(inner)
                after = self._add(part, inner)
                self.skips[at].append(after)
                at = after
            else:
                for word in [None] * part if isinstance(part, int) else [part]:
                    after = self._state()
                    self.edges[at][word] = after
                    if word is None:
                        self.skips[at].append(after)
                    at = after
        return at

    def _closed(self, states: set[int]) -> set[int]:
        """With all states that need no further word."""
        todo, out = list(states), set(states)
        while todo:
            for after in self.skips[todo.pop()]:
                if after not in out:
                    out.add(after)
                    todo.append(after)
        return out

    def match(self, words: Iterator[str]) -> int:
        """Number of words of the longest accepted start of `words`; 0 if there is none."""
        states, longest = self._closed({0}), 0
        for n, word in enumerate(words, 1):
            after = {self.edges[s][w] for s in states for w in (word, None) if w in self.edges[s]}
            if not after:
                break
            states = self._closed(after)
            if self.end in states:
                longest = n
        return longest


@dataclass
class Scanner:
    """Compiled templates and base phrases, with the hashes of the words that can start them."""

    automata: dict[str, Automaton]
    phrases: dict[tuple[str, ...], str]

    def __post_init__(self):
        starts: dict[str, list[str]] = {}
        for label, automaton in self.automata.items():
            for word in automaton.first:
                starts.setdefault(word, []).append(label)
        for phrase in self.phrases:
            starts.setdefault(phrase[0], [])
        listed = sorted(starts)
        self.starts = starts
        self.wanted = Words(listed, NOT_ALNUM).hashes if listed else np.zeros(0, np.uint64)

    def scan(self, texts: list[str]) -> list[tuple[int, list[tuple[str, int]], list[tuple[str, int, int]]]]:
        """For each text: number of words, places of base phrases, places of template matches."""
        found = Words(texts, NOT_ALNUM)
        bounds = found.bounds.tolist()
        out = [(b - a, [], []) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        places = np.flatnonzero(np.isin(found.hashes, self.wanted))
        owners = np.searchsorted(found.bounds, places, "right") - 1
        for place, owner in zip(places.tolist(), owners.tolist(), strict=True):
            first = found.text(place)
            if first not in self.starts:
                continue
            start, stop = place - bounds[owner], bounds[owner + 1]
            for phrase, label in self.phrases.items():
                if phrase[0] == first and place + len(phrase) <= stop and all(
                        found.text(place + k) == word for k, word in enumerate(phrase)):
                    out[owner][1].append((label, start))
            for label in self.starts[first]:
                n = self.automata[label].match(found.text(i) for i in range(place, stop))
                if n:
                    out[owner][2].append((label, start, start + n))
        return out


def scanner(templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> Scanner:
    return Scanner({k: Automaton(v) for k, v in (TEMPLATES if templates is None else templates).items()},
                   {tuple(k.split()): v for k, v in (BASE if base is None else base).items()})


RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "labels array<string>, score double, matches array<struct<label:string,start:long,stop:long>>")


def _score(found: set[str], clauses: frozenset[str], phrase: bool) -> float:
    return 1.0 if found - clauses else 0.75 if found else 0.5 if phrase else 0.0


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None,
                  id_col: str = "doc_id", text_col: str = "text", clauses: frozenset[str] = CLAUSES) -> DataFrame:
    """License labels of every document, by base phrases and by template automata.

    Returns a row per input row: doc_id, n_words, n_base (places of base phrases), first_word and last_word (their
    smallest and largest start; null without), base_labels, labels (those and the templates'; sorted, distinct),
    score (1: the whole mandatory wording of a notice, text, header or tag stands in the document; 0.75: only that of
    a clause; 0.5: a base phrase only; else 0), matches (label and word range of each place where a template matches). A null text counts as empty; every row is scanned whole, in
    its own task, without a shuffle.
    """
    scan = scanner(templates, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                rows = scan.scan(texts[a:b])
                places = [[start for _, start in phrases] for _, phrases, _ in rows]
                base_labels = [sorted({label for label, _ in phrases}) for _, phrases, _ in rows]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
                    "n_base": pa.array([len(p) for p in places], pa.int64()),
                    "first_word": pa.array([min(p, default=None) for p in places], pa.int64()),
                    "last_word": pa.array([max(p, default=None) for p in places], pa.int64()),
                    "base_labels": pa.array(base_labels, pa.list_(pa.string())),
                    "labels": pa.array([sorted({*own, *(m[0] for m in found)})
                                        for own, (_, _, found) in zip(base_labels, rows, strict=True)],
                                       pa.list_(pa.string())),
                    "score": pa.array([_score({m[0] for m in found}, clauses, bool(p))
                                       for p, (_, _, found) in zip(places, rows, strict=True)], pa.float64()),
                    "matches": pa.array([[{"label": x, "start": i, "stop": j} for x, i, j in found]
                                         for _, _, found in rows],
                                        pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()),
                                                            ("stop", pa.int64())]))),
                })

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(run, RESULT)


def template_pattern(template: str) -> str:
    """The same language as a regular expression over words with a blank after each; for comparison."""

    def pattern(parts: list) -> str:
        return "".join(f"(?:{pattern(p)})?" if isinstance(p, list)
                       else f"(?:[^ ]+ ){{0,{p}}}" if isinstance(p, int) else f"{p} " for p in parts)

    return pattern(parsed(template))
