"""License scans by template markup.

A template is license wording with regions in double angle brackets:

    <<optional>> words <</optional>>      the words may be missing (regions nest)
    <<var 0-12>>                          any 0 to 12 words stand here

Templates are compiled into automata over tokens.  A text has a template's label where the automaton accepts: all
mandatory words stand in order, nothing else stands between them but optional or replaceable regions.
A template is anchored by its first run of mandatory words, which is found for all templates at once on word hashes;
automata run only from such places, and compare words.

Words are lower-cased (A-Z) runs of ASCII digits, letters and all non-ASCII characters.  Null texts are empty and have no
labels and score 0.  Repeated rows are each reported; further columns pass through.

The score is the largest evidence of any place: 1.0 for a full license text, 0.9 for a notice or identifier, 0.7 for
a base phrase.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.llm.common import flat, pieces, text_column
from tabspark.llm.tokens import ALNUM, U, mix, words

# Phrases and labels of the base scan.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Public license wording; regions follow the markup above.
PERMISSION = """
<<optional>><<optional>>The<</optional>> MIT License <<optional>>(MIT)<</optional>><</optional>>
<<optional>>Copyright <<optional>>(c)<</optional>> <<var 0-20>><</optional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice <<optional>>(including the next paragraph)<</optional>> shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL <<var 1-20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.
"""
ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND <<var 1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
"""
BSD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<optional>>1.<</optional>> Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. <<optional>>2.<</optional>> Redistributions in binary form must reproduce
the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution.
"""
APACHE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at <<var 1-12>> Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied.
"""
# (label, evidence, template)
TEMPLATES = [
    *[(label, 0.7, phrase) for phrase, label in BASE],
    ("mit", 1.0, PERMISSION),
    ("isc", 1.0, ISC),
    ("bsd", 1.0, BSD),
    ("apache-2.0", 1.0, APACHE),
    ("mit", 0.9, "<<optional>>This <<var 1-3>> is<</optional>> <<optional>>Released<</optional>><<optional>>Licensed<</optional>> under the <<optional>>terms of the<</optional>> MIT License"),
    ("apache-2.0", 0.9, "Licensed under the <<optional>>terms of the<</optional>> Apache License<<optional>>,<</optional>> Version 2.0"),
    ("gpl", 0.9, "licensed under <<optional>>the terms of<</optional>> the GNU General Public License<<optional>>,<</optional>> <<optional>>as published by the Free Software Foundation<</optional>> <<optional>>either<</optional>> version <<var 1-1>>"),
    ("lgpl", 0.9, "under <<optional>>the terms of<</optional>> the GNU Lesser General Public License"),
    ("mpl", 0.9, "subject to the terms of the Mozilla Public License"),
    ("cc-by", 0.9, "Licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> CC BY <<optional>>NC<</optional>> <<optional>>SA<</optional>> <<optional>>ND<</optional>> 4.0"),
    ("cc-by", 0.9, "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> Creative Commons Attribution <<var 0-4>> 4.0 International License"),
    ("spdx", 0.9, "SPDX License Identifier <<var 1-1>>"),
]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PART = re.compile(r"<<(/?optional|var (\d+)-(\d+))>>")


def _words(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


@dataclass
class Automaton:
    """States with word moves, free moves (empty) and wildcard moves; the last state accepts."""

    label: str
    evidence: float
    on_word: list[dict[bytes, list[int]]] = field(default_factory=lambda: [{}])
    on_any: list[list[int]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    anchor: list[str] = field(default_factory=list)  # first mandatory words
    lead: int = 0  # most words before the anchor

    def state(self) -> int:
        self.on_word.append({})
        self.on_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo.extend(self.free[s])
        return frozenset(seen)

    def run(self, tokens, at: int, end: int) -> int:
        """End of the longest accepted run of tokens from ``at``, or -1."""
        best, now = -1, self.closure([0])
        last = len(self.free) - 1
        while True:
            if last in now:
                best = at
            if at >= end or not now:
                return best
            word = tokens(at)
            now = self.closure([t for s in now for t in (*self.on_word[s].get(word, ()), *self.on_any[s])])
            at += 1


def compile_template(label: str, evidence: float, template: str) -> Automaton:
    a = Automaton(label, evidence)
    now, opened, fixed, done, longest, at = 0, [], [], False, 0, 0
    for m in [*_PART.finditer(template), None]:
        for w in _words(template[at : m.start() if m else len(template)]):
            new = a.state()
            a.on_word[now].setdefault(w.encode(), []).append(new)
            now = new
            if not opened and not done:
                fixed.append(w)
            elif not done:
                longest += 1
        if m is None:
            break
        at = m.end()
        if m[1] == "optional":
            if fixed:
                done = True
            opened.append(now)
            now = a.state()
            a.free[opened[-1]].append(now)
        elif m[1] == "/optional":
            new = a.state()
            a.free[now].append(new)
            a.free[opened.pop()].append(new)
            now = new
        else:
            if fixed and not opened:
                done = True
            low, high = int(m[2]), int(m[3])
            if not done:
                longest += high
            tail = []
            for i in range(high):
                if i >= low:
                    tail.append(now)
                new = a.state()
                a.on_any[now].append(new)
                now = new
            new = a.state()
            for s in (*tail, now):
                a.free[s].append(new)
            now = new
    a.anchor, a.lead = fixed, longest
    if not fixed:
        raise ValueError(f"template of {label} has no mandatory words")
    return a


def hash_words(wanted: list[str]) -> np.ndarray:
    data, offsets = flat(pa.array([" ".join(wanted)], pa.large_string()))
    return words(data, offsets, ALNUM).hash


class Scanner:
    def __init__(self, templates=None):
        self.automata = [compile_template(*t) for t in (TEMPLATES if templates is None else templates)]
        self.keys: dict[int, list[int]] = {}  # hash of up to three anchor words -> templates
        for i, a in enumerate(self.automata):
            k = min(3, len(a.anchor))
            self.keys.setdefault(k, {}).setdefault(int(_combine(hash_words(a.anchor[:k]), k)[0]), []).append(i)

    def places(self, data, offsets, w) -> list[set[tuple[int, int, int]]]:
        """Per text: (template, first word, end word) of every accepted place; words count from 0 in their text."""
        out: list[set] = [set() for _ in range(len(offsets) - 1)]
        token = lambda i: data[w.start[i] : w.end[i]].tobytes().lower()
        for k, table in self.keys.items():
            h = _combine(w.hash, k)
            known = np.array(list(table), U)
            for p in np.flatnonzero(np.isin(h, known)).tolist():
                d = int(np.searchsorted(w.first, p, "right")) - 1
                lo, hi = int(w.first[d]), int(w.first[d + 1])
                for i in table[int(h[p])]:
                    a = self.automata[i]
                    for s in range(max(lo, p - a.lead), p + 1):  # optional words may stand before the anchor
                        e = a.run(token, s, hi)
                        if e > p:
                            out[d].add((i, s - lo, e - lo))
                            break
        return out


def _combine(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) < k:
        return np.empty(0, U)
    out = np.zeros(len(h) - k + 1, U)
    for j in range(k):
        out = out * U(0x9FB21C651E98DF25) + h[j : j + len(out)]
    return mix(out)


def scan(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with __n_words and __found: array of (label, base, evidence, first, end word)."""
    shared = docs.sparkSession.sparkContext.broadcast(TEMPLATES)
    found = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("evidence", T.DoubleType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField("__n_words", T.LongType()), T.StructField("__found", found)])
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("evidence", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        scanner = Scanner(shared.value)
        for batch in pieces(batches):
            data, offsets = flat(text_column(batch, "text"))
            w = words(data, offsets, ALNUM)
            rows = []
            for hits in scanner.places(data, offsets, w):
                rows.append([{"label": scanner.automata[i].label, "base": i < len(BASE), "evidence": scanner.automata[i].evidence, "first": s, "end": e} for i, s, e in sorted(hits)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(w.first), pa.int64()), pa.array(rows, kind)], schema.names)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    out = scan(docs.select("doc_id", "text")).withColumn("__base", F.filter("__found", lambda x: x["base"]))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    starts = F.transform("__base", lambda x: x["first"])
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.size("__base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                      names("__base").alias("base_labels"), names("__found").alias("labels"), F.coalesce(F.array_max(F.transform("__found", lambda x: x["evidence"])), F.lit(0.0)).alias("score"))
