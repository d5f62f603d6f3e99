"""Removal of repeated passages, by automata of confirmed phrases.

A window is ``WINDOW`` consecutive words of one document.  The words that a window covers go if the same window also starts in a
document of smaller doc_id; windows are judged on the input.

1. Documents are stored in pieces.  Each window is represented by its winnowed fingerprint, the smallest hash of its ``GRAM``-word
   parts, so equal windows have equal fingerprints.  A fingerprint that several documents hold makes its windows suspects.
2. The suspect passages (the windows of one fingerprint at one place) are gathered by fingerprint, once per piece and not once per document, and
   confirmed word by word: a window's first owner is the smallest doc_id among all documents that hold exactly these words.
3. Each piece compiles its confirmed windows into Aho-Corasick automata over word numbers, in shards of ``SHARD`` phrases, and streams all
   its documents through them, which locates every occurrence; a document loses the words of occurrences whose owner has a smaller id.

A piece is told only of phrases it holds, so automata stay bounded however large the corpus is, and a passage that a third of
all documents share is a row per piece.  Pieces and what they are told meet in tables bucketed by piece.

doc_id must be a whole number.  Null and blank texts have no words.  Rows of one doc_id are documents that do not remove each other's words; rows
of a null doc_id neither lose words nor make others lose them, and repeated rows are all returned.  Texts of any length
are taken as a whole.  An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.llm.common import Bucketed, flat, packed, pieces, saved, text_column, unpacked
from tabspark.llm.tokens import SOLID, grams, words

WINDOW, GRAM = 13, 6
PIECE = 2 << 20  # text bytes of a piece
SHARD = 1 << 16  # phrases of an automaton
CONFIRM_BYTES = 8 << 20  # passages confirmed at a time; those of one fingerprint stay together
NO_ID = np.iinfo(np.int64).max


def stored(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """piece and its rows: doc_id and whole texts, compressed."""

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text", piece):
            body, n_bytes = packed(pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "text": text_column(batch, "text")}))
            yield pa.RecordBatch.from_pydict({"piece": pa.array([task << 32 | n], pa.int64()), "body": pa.array([body], pa.binary()), "n_bytes": pa.array([n_bytes], pa.int64())})
            n += 1

    return docs.select("doc_id", "text").mapInArrow(run, "piece bigint, body binary, n_bytes bigint")


class Piece:
    """Words of a piece's documents, and the place of the fingerprint of each window."""

    def __init__(self, batch: pa.RecordBatch, window: int, gram: int):
        self.ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
        self.texts = text_column(batch, "text")
        self.data, offsets = flat(self.texts)
        self.words = words(self.data, offsets, SOLID)
        self.row = self.words.text_of()
        self.window = window
        n = len(self.row)
        self.gram = grams(self.words.hash, gram)
        if n < window:
            self.starts = self.prints = np.zeros(0, np.int64)
            return
        self.starts = np.flatnonzero(self.row[: n - window + 1] == self.row[window - 1 :])  # first words of windows
        parts = np.lib.stride_tricks.sliding_window_view(self.gram[: n - gram + 1], window - gram + 1)
        self.prints = self.starts + np.concatenate([parts[self.starts[i : i + (1 << 18)]].argmin(axis=1) for i in range(0, len(self.starts), 1 << 18)] or [np.zeros(0, np.int64)])

    def joined(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """Texts of the words first..last, joined by one space."""
        size = self.words.end - self.words.start + 1
        ends = np.concatenate([[0], np.cumsum(size)])
        spaced = np.full(ends[-1], 0x20, np.uint8)
        inside = np.repeat(self.words.start - ends[:-1], size) + np.arange(ends[-1])
        letter = np.ones(ends[-1], bool)
        letter[ends[1:] - 1] = False
        spaced[letter] = self.data[inside[letter]]
        begin, length = ends[first], ends[last + 1] - 1 - ends[first]
        offsets = np.concatenate([[0], np.cumsum(length)])
        body = spaced[np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])


def _each(batch: pa.RecordBatch, window: int, gram: int, *more: str):
    for i in range(batch.num_rows):
        yield batch.column("piece")[i].as_py(), Piece(unpacked(batch.column("body")[i], batch.column("n_bytes")[i].as_py()), window, gram), *[batch.column(c)[i].values for c in more]


def _fingerprints(window: int, gram: int):
    """print, mark: the fingerprints of a piece; mark is the piece, and in its lowest bit whether several rows hold it."""
    def run(batches):
        for batch in batches:
            for piece, p in _each(batch, window, gram):
                at = np.unique(p.prints)
                value, row = p.gram[at].view(np.int64), p.row[at]
                order = np.lexsort((row, value))
                value, row = value[order], row[order]
                head = np.concatenate([[True], value[1:] != value[:-1]])[: len(value)]
                tail = np.concatenate([head[1:], [True]])[: len(value)]
                several = row[head] != row[tail]
                yield pa.RecordBatch.from_pydict({"print": pa.array(value[head]), "mark": pa.array(np.full(len(several), piece * 2) + several)})

    return run


def _suspects(window: int, gram: int):
    """Passages of a piece whose fingerprint recurs: print, piece, place of their first word, number of windows, smallest and largest doc_id, words."""
    def run(batches):
        for batch in batches:
            for piece, p, known in _each(batch, window, gram, "prints"):
                known = np.sort(known.to_numpy())
                value = p.gram[p.prints].view(np.int64)
                found = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
                found &= p.ids[p.row[p.starts]] != NO_ID
                start, print_at = p.starts[found], p.prints[found]
                if not len(start):
                    continue
                head = np.flatnonzero(np.concatenate([[True], (print_at[1:] != print_at[:-1]) | (start[1:] != start[:-1] + 1)]))
                tail = np.concatenate([head[1:], [len(start)]]) - 1
                first, n = start[head], start[tail] - start[head] + 1
                text = p.joined(first, start[tail] + window - 1).dictionary_encode()
                code, owner = text.indices.to_numpy(), p.ids[p.row[first]]
                order = np.lexsort((owner, code))
                one = np.concatenate([[True], np.diff(code[order]) > 0])
                last = np.concatenate([np.flatnonzero(one)[1:], [len(order)]]) - 1
                low, high = order[one], order[last]
                yield pa.RecordBatch.from_pydict({
                    "print": pa.array(value[found][head][low]), "piece": pa.array(np.full(len(low), piece)), "at": pa.array(first[low]),
                    "n": pa.array(n[low]), "low": pa.array(owner[low]), "high": pa.array(owner[high]), "words": text.dictionary.take(pa.array(code[low])).cast(pa.string())})

    return run


def confirm(texts: pa.Array, n: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of passages compared word by word.

    Per window: the passage, its number in it, the smallest doc_id of all passages that hold the same words, and whether another document holds them.
    """
    lists = pc.split_pattern(texts, " ")
    code = lists.values.dictionary_encode().indices.to_numpy()
    first = lists.offsets.to_numpy()[:-1]
    passage = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(passage)) - np.repeat(np.cumsum(n) - n, n)
    at = first[passage] + number
    columns = [code[at + j] for j in range(window)]
    order = np.lexsort(columns)
    same = np.ones(max(len(order) - 1, 0), bool)
    for c in columns:
        same &= c[order[1:]] == c[order[:-1]]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    owner, most = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    if len(order):
        owner[order] = np.minimum.reduceat(low[passage[order]], starts)[group]
        most[order] = np.maximum.reduceat(high[passage[order]], starts)[group]
    return passage, number, owner, most > owner


def _owners(window: int):
    """piece, place and number of windows, owner: confirmed windows that a piece holds in a document other than their owner."""
    def settle(table: pa.Table) -> pa.RecordBatch:
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        passage, number, owner, _ = confirm(table.column("words").combine_chunks(), table.column("n").to_numpy(), low, high, window)
        lost = owner < high[passage]
        passage, number, owner = passage[lost], number[lost], owner[lost]
        head = np.flatnonzero(np.concatenate([[True], (passage[1:] != passage[:-1]) | (number[1:] != number[:-1] + 1) | (owner[1:] != owner[:-1])])) if len(passage) else passage
        n = np.diff(np.concatenate([head, [len(passage)]]))
        return pa.RecordBatch.from_pydict({
            "piece": table.column("piece").combine_chunks().take(pa.array(passage[head])),
            "place": pa.array((table.column("at").to_numpy()[passage[head]] + number[head]) * 256 + n), "owner": pa.array(owner[head])})

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if sum(b.nbytes for b in waiting) >= CONFIRM_BYTES:
                table = pa.Table.from_batches(waiting)
                value = table.column("print").to_numpy()
                cut = int(np.searchsorted(value, value[-1]))  # the last fingerprint may go on
                if cut:
                    yield settle(table.slice(0, cut))
                waiting = table.slice(cut).combine_chunks().to_batches()
        if waiting:
            yield settle(pa.Table.from_batches(waiting))

    return run


def digits(numbers: np.ndarray, most: int) -> np.ndarray:
    """Word numbers as two digits of a base near the root of ``most``, with symbols of their own for each place.

    An automaton searches the children of a state one by one, so few symbols are fast; distinct symbols keep matches on whole words.
    """
    base = int(most**0.5) + 1
    out = np.stack([numbers // base, base + numbers % base], axis=-1)
    return out.reshape(*numbers.shape[:-1], -1)


def automata(patterns: np.ndarray, owners: np.ndarray, shard: int):
    """Aho-Corasick automata over sequences of digits; a match gives its owner."""
    for i in range(0, len(patterns), shard):
        a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, owner in zip(map(tuple, patterns[i : i + shard].tolist()), owners[i : i + shard].tolist()):
            a.add_word(key, owner)
        a.make_automaton()
        yield a


def _removed(window: int, gram: int, shard: int):
    """doc_id, n_words, n_removed and kept text of the rows of pieces; a piece that was told nothing keeps all words."""
    def run(batches):
        for batch in batches:
            for piece, p, places, owners in _each(batch, window, gram, "places", "owners"):
                n = len(p.row)
                gone = np.zeros(n + 1, np.int64)
                if places is not None and len(places):
                    place, owner = places.to_numpy(), owners.to_numpy()
                    run_of = np.repeat(np.arange(len(place)), place % 256)
                    at = (place // 256)[run_of] + np.arange(len(run_of)) - np.repeat(np.cumsum(place % 256) - place % 256, place % 256)
                    number = p.joined(np.arange(n), np.arange(n)).dictionary_encode().indices.to_numpy().astype(np.int64) + 1  # 0 ends a document
                    ends = np.flatnonzero(np.diff(p.row, prepend=p.row[:1])) if n else []
                    stream = np.insert(number, ends, 0)
                    where = np.insert(np.arange(n), ends, -1)
                    most = int(number.max()) + 1
                    haystack = tuple(digits(stream, most).tolist())
                    patterns = digits(number[at[:, None] + np.arange(window)], most)
                    for a in automata(patterns, owner[run_of], shard):
                        hits = np.fromiter((x for hit in a.iter(haystack) for x in hit), np.int64).reshape(-1, 2)
                        last = where[hits[:, 0] // 2]
                        ids = p.ids[p.row[last]]
                        last = last[(ids > hits[:, 1]) & (ids != NO_ID)]
                        np.add.at(gone, last - window + 1, 1)
                        np.add.at(gone, last + 1, -1)
                removed = np.cumsum(gone)[:n] > 0
                row_words = np.bincount(p.row, minlength=len(p.ids))
                lost = np.bincount(p.row[removed], minlength=len(p.ids))
                kept = _kept(p, removed, row_words - lost)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(p.ids, mask=p.ids == NO_ID), "n_words": pa.array(row_words), "n_removed": pa.array(lost),
                    "kept_text": kept.cast(pa.string())})

    return run


def _kept(p: Piece, removed: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    stay = np.flatnonzero(~removed)
    each = p.joined(stay, stay)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), each), pa.scalar(" ", pa.large_string()))


def _passes(docs: DataFrame, window: int, gram: int, piece: int, shard: int) -> tuple[DataFrame, Bucketed]:
    if not 0 < gram <= window <= 128:
        raise ValueError(f"a window of {window} words with parts of {gram}: windows have 1 to 128 words, parts at most as many")
    store = Bucketed(docs.sparkSession, ["piece"])
    store.append(stored(docs, piece))
    prints = store.read().mapInArrow(_fingerprints(window, gram), "print bigint, mark bigint")
    held = F.sum(F.expr("1 + (mark & 1)")).over(Window.partitionBy("print"))
    recurring = prints.withColumn("n", held).where("n > 1").select(F.expr("shiftright(mark, 1)").alias("piece"), "print")
    told = recurring.groupBy("piece").agg(F.collect_list("print").alias("prints"))
    suspects = store.read().join(told, "piece").mapInArrow(_suspects(window, gram), "print bigint, piece bigint, at bigint, n bigint, low bigint, high bigint, words string")
    dealt = suspects.repartition(store.n, "print").sortWithinPartitions("print")
    owned = dealt.mapInArrow(_owners(window), "piece bigint, place bigint, owner bigint")
    owned = saved(owned.groupBy("piece").agg(F.collect_list("place").alias("places"), F.collect_list("owner").alias("owners")))
    out = store.read().join(owned, "piece", "left").mapInArrow(_removed(window, gram, shard), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
    return out, store


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE, shard: int = SHARD) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept_text (the kept words joined by one space)."""
    out, store = _passes(docs, window, gram, piece, shard)
    out = saved(out)
    store.forget()
    return out


def report(docs: DataFrame) -> DataFrame:
    """The same with the hash of the kept text."""
    out, store = _passes(docs, WINDOW, GRAM, PIECE, SHARD)
    out = saved(out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")))
    store.forget()
    return out
