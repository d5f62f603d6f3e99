"""Benchmark decontamination by winnowing.

Words are hashed, ``K`` consecutive words give a k-gram hash, and the smallest hash of every ``window - K + 1``
consecutive k-grams is a fingerprint, so any ``window`` shared words share a fingerprint.  Fingerprints
of documents and benchmark items are joined, and each hit is extended along its diagonal to the maximal
run of equal words, compared word by word.  A run of at least ``window`` words is a hit in all its words.

Items shorter than the window are one window each; documents are winnowed once more for each such length,
with the k-gram and window sizes that guarantee it.

Benchmark items enter in blocks of bounded size, each broadcast on its own; every block meets every document.
Null texts have no words.  Items without words are never hit.  Repeated item rows count once by item_id (a null
item_id reads ``null``); repeated document rows are each reported.  Columns beside ``text`` pass through.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.llm.common import flat, pieces, text_column
from tabspark.llm.tokens import ALNUM, grams, words

K, WINDOW = 5, 10
BLOCK_BYTES = 16 << 20  # benchmark text in one broadcast
_TABLE = 1 << 20


def _sizes(length: int) -> tuple[int, int]:
    """k-gram size and k-grams per window, so that every run of ``length`` words has a fingerprint."""
    k = min(K, length)
    return k, length - k + 1


def winnow(hashes: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the fingerprints; ``first`` bounds the texts."""
    g = grams(hashes, k)
    n = len(g)
    size = np.diff(first)
    valid = np.zeros(n + 1, np.int64)  # +1/-1 marks of the window starts that stay inside their text
    long = size >= k + w - 1
    np.add.at(valid, first[:-1][long], 1)
    np.add.at(valid, first[1:][long] - (k + w - 2), -1)
    at = np.flatnonzero(np.cumsum(valid[:n]) > 0)
    if not len(at):
        return at, g[:0]
    best, where = g[at], at.copy()
    for j in range(1, w):
        other = g[at + j]
        less = other < best
        best = np.where(less, other, best)
        where = np.where(less, at + j, where)
    where = np.unique(where)
    return where, g[where]


class Block:
    """Fingerprints and words of some benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        data, offsets = flat(texts)
        w = words(data, offsets, ALNUM)
        self.ids = [i for i, _ in items]
        self.words = [w.hash[a:b] for a, b in zip(w.first, w.first[1:])]
        self.raw = [[data[s:e].tobytes().lower() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
        self.window = window
        self.classes = []  # (k, k-grams a window, filter, fingerprint -> [(item, position)])
        lengths = np.diff(w.first)
        for length in sorted({min(int(n), window) for n in lengths if n}):
            chosen = [i for i, n in enumerate(lengths) if n and min(n, window) == length]
            k, per = _sizes(length)
            places = defaultdict(list)
            for i in chosen:
                at, values = winnow(self.words[i], np.array([0, len(self.words[i])]), k, per)
                for p, v in zip(at.tolist(), values.tolist()):
                    places[v].append((i, p))
            seen = np.zeros(_TABLE, bool)
            seen[np.array(list(places), np.uint64) & np.uint64(_TABLE - 1)] = True
            self.classes.append((k, per, seen, dict(places)))

    def match(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Per text: word count, runs of hit words and ids of the items that hit it."""
        w = words(data, offsets, ALNUM)
        runs: list[list] = [[] for _ in range(len(offsets) - 1)]
        hit: list[set] = [set() for _ in range(len(offsets) - 1)]
        for k, per, seen, places in self.classes:
            at, values = winnow(w.hash, w.first, k, per)
            maybe = seen[values & np.uint64(_TABLE - 1)]
            diagonals = set()
            for p, v in zip(at[maybe].tolist(), values[maybe].tolist()):
                if v in places:
                    d = int(np.searchsorted(w.first, p, "right")) - 1
                    diagonals.update((d, i, p - q) for i, q in places[v])
            for d, i, shift in diagonals:
                item, lo, hi = self.words[i], int(w.first[d]), int(w.first[d + 1])
                a, b = max(lo, shift), min(hi, shift + len(item))
                same = np.concatenate([[False], w.hash[a:b] == item[a - shift : b - shift], [False]])
                edge = np.flatnonzero(same[1:] != same[:-1])
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if e - s >= min(self.window, len(item)) and self._equal(data, w, a + s, a + e, i, shift):
                        runs[d].append((a + s - lo, a + e - lo))
                        hit[d].add(self.ids[i])
        return [(int(w.first[d + 1] - w.first[d]), runs[d], hit[d]) for d in range(len(runs))]

    def _equal(self, data, w, a, b, i, shift) -> bool:
        return all(data[w.start[p] : w.end[p]].tobytes().lower() == self.raw[i][p - shift] for p in range(a, b))


def merged(runs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((int(a), int(b)) for a, b in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(items: DataFrame, size: int) -> list[list[tuple[str, str]]]:
    out, room = [], 0
    for r in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").where("text is not null").toLocalIterator():
        if not out or room < len(r.text):
            out.append([])
            room = size
        out[-1].append((r.i, r.text))
        room -= len(r.text)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` with __n_words, __spans (array of [from, to) word positions) and __items (ids)."""
    spark = docs.sparkSession
    found = ["__n_words", "__spans", "__items"]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField("__n_words", T.LongType()), T.StructField("__spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("__items", T.ArrayType(T.StringType()))])
    names = docs.columns

    def step(block):
        def run(batches):
            for batch in pieces(batches):
                got = block.value.match(*flat(text_column(batch, "text")))
                before = zip(*[batch.column(c).to_pylist() for c in found[1:]]) if found[1] in batch.schema.names else [((), ())] * len(got)
                spans, ids = [], []
                for (_, runs, hit), (old, items) in zip(got, before):
                    spans.append([list(x) for x in merged([*runs, *old])])
                    ids.append(sorted(hit | set(items)))
                new = [pa.array([n for n, _, _ in got], pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *new], [*names, *found])
        return run

    out = docs
    for block in _blocks(items, block_bytes) or [[]]:
        out = out.mapInArrow(step(spark.sparkContext.broadcast(Block(block, window))), schema)
    return out


def n_hit():
    return F.aggregate("__spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = contamination(docs.select("doc_id", "text"), items)
    return out.select("doc_id", F.col("__n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"), (F.size("__items") > 0).alias("contaminated"))
