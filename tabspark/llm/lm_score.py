"""Language-model scores by deleted interpolation.

Tokens are words (A-Z lower-cased runs without white space) and one end per text.  A token's probability mixes three
estimates with weights that depend on how often its context occurred:

    l2[b] c(context, token) / c(context) + l1[b] c(token) / N + l0[b] / (V + 1)

The context is the word before (or the start of the text); b is the octave of c(context).  With ``own_contexts`` every
word is a context of its own; without, rarer words than the ``HEAD`` most frequent share one.  The weights maximise, by expectation-maximisation, the
likelihood of the deleted part of the training documents (remainder 1) under counts of the rest; the final
estimates use counts of all training documents.  Unigram and bigram counts cover every token of every training text.

How it runs: unigram counts are one aggregation; the head table is broadcast (a fixed number of words).  Bigram
occurrences are packed into bytes and dealt by a hash of the bigram, so that one task counts a bigram and scores
its occurrences; only partial sums per text travel back.  A bigram with a word outside the head goes where that word's occurrences
are counted; where both words are, to the second one, and the count of the first comes along from the table of unigrams.  Bigrams with more than ``1 / HOT`` of all tokens (fewer than
HOT can exist) are broadcast with their counts and scored where they are read.

Null texts are empty: their only token is the end.  A null doc_id counts as training.  Repeated rows are counted and
scored each.  Without training documents the model is uniform.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import flat, pieces, saved, text_column
from tabspark.llm.supervised import remainder
from tabspark.llm.tokens import SOLID, U, mix, words

FOLDS, HELD, DELETED = 10, 0, 1
HEAD = (1 << 18) - 4  # words with an identifier; two more identifiers are the start and all rarer words
HOT = 2048
SLICE = 2_000_000  # bigram occurrences that one task handles at a time
END = int(mix(np.array([0x5EED], U))[0])
RARE_BUCKET, START_BUCKET, NO_CONTEXT, BUCKETS = 48, 49, 50, 51
STEPS = 4  # histogram bins an octave
PIECE_ROWS = 1 << 12
WORD_BYTES = 1 << 19  # text bytes that are cut into words at a time
HEADS, TAIL, AFTER, BOTH, COUNTS = range(5)  # bigrams: no word outside the head, the second, the first, both; and counts of first words
ROOM = 1_500_000  # distinct entries that a task gathers before it sends them
SHARES = 8  # a task sorts what it holds in so many shares, one after another
BLOCK = 1 << 18  # entries with temporary arrays at a time
ROW_PAIRS = 1 << 15  # bigrams in a row on their way to be counted


@dataclass
class Vocabulary:
    """Head words with their counts, in all training texts [0] and in those not deleted [1]."""

    hashes: np.ndarray  # sorted; the position is the identifier
    counts: np.ndarray  # (2, words)
    total: np.ndarray  # tokens
    distinct: np.ndarray
    texts: np.ndarray

    def __post_init__(self):
        n, bits = len(self.hashes), 21
        self.mask = U((1 << bits) - 1)
        slot = (self.hashes & self.mask).astype(np.int64)
        self.slot_id = np.full(1 << bits, n, np.int32)
        self.slot_id[slot[::-1]] = np.arange(n - 1, -1, -1, dtype=np.int32)
        self.crowded = np.bincount(slot, minlength=1 << bits) > 1
        self.padded = np.append(self.hashes, U(0))

    @property
    def start(self) -> int:
        return len(self.hashes) + 1

    @property
    def rare(self) -> int:
        return len(self.hashes)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Identifier of each word; ``rare`` for those outside the head."""
        slot = (hashes & self.mask).astype(np.int64)
        out = self.slot_id[slot].astype(np.int64)
        wrong = self.padded[out] != hashes
        retry = np.flatnonzero(wrong & self.crowded[slot])
        out[wrong] = self.rare
        if len(retry):
            at = np.minimum(np.searchsorted(self.hashes, hashes[retry]), len(self.hashes) - 1)
            out[retry] = np.where(self.hashes[at] == hashes[retry], at, self.rare)
        return out

    def contexts(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Count and bucket of every context identifier."""
        c = self.counts[part].astype(float)
        end = np.searchsorted(self.hashes, U(END))
        c[end] = 0  # nothing follows the end
        n = np.concatenate([c, [self.total[part] - self.texts[part] - c.sum(), self.texts[part]]])
        bucket = np.minimum(np.log2(np.maximum(n, 1)).astype(int), RARE_BUCKET - 1)
        bucket[-2:] = RARE_BUCKET, START_BUCKET
        bucket[n <= 0] = NO_CONTEXT
        return n, bucket


def _sequence(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts with their ends, and the text of each token."""
    hashes, sizes = [], []
    for part in pieces(iter([batch]), size=WORD_BYTES):
        w = words(*flat(text_column(part, "text")), SOLID)
        hashes.append(np.insert(w.hash, w.first[1:], U(END)))
        sizes.append(np.diff(w.first) + 1)
    return np.concatenate(hashes), np.repeat(np.arange(batch.num_rows), np.concatenate(sizes))


def _small(batches) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for i in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(i, PIECE_ROWS)


def unigrams(docs: DataFrame) -> DataFrame:
    """token (hash), n: its training count, kept: its count in training texts that are not deleted."""
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            keys, numbers = (np.concatenate([h[j] for h in held], axis=-1) for j in (0, 1))
            held.clear()
            for at in _shares(keys, 61):
                values, back = np.unique(keys[at], return_inverse=True)
                sums = [np.bincount(back, x[at], len(values)).astype(np.int64) for x in numbers]
                for i in range(0, len(values), BLOCK):
                    part = slice(i, i + BLOCK)
                    yield pa.RecordBatch.from_pydict({"token": values[part].view(np.int64), "n": sums[0][part], "kept": sums[1][part]})

        def take(batch):
            tokens, text = _sequence(batch)
            rest = batch.column("rest").to_numpy()[text]
            tokens, kept = tokens[rest != HELD], rest[rest != HELD] != DELETED
            values, back = np.unique(tokens, return_inverse=True)
            held.append((values, np.stack([np.bincount(back, minlength=len(values)), np.bincount(back, kept, len(values))]).astype(np.int32)))

        for batch in _small(batches):
            take(batch)
            if sum(len(k) for k, _ in held) > ROOM:
                yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(run, "token bigint, n bigint, kept bigint").groupBy("token").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    s = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "kept", F.expr("int(n > 0)"), F.expr("int(kept > 0)"))]).first()
    # the head is every word from a count on; the octaves' numbers of words tell from which (some hundred rows at most)
    level = F.floor(8 * F.log2("n")).cast("int")
    sizes = counts.where("n > 0").groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect()
    taken, least = 0, None
    for r in sizes:
        if taken + r.k >= head:
            break
        taken, least = taken + r.k, r.level
    top = counts.where(F.lit(False) if least is None else (F.col("n") > 0) & (level >= least)).toPandas()
    hashes = top["token"].to_numpy(np.int64).view(U)
    if U(END) not in hashes:
        own = counts.where(F.col("token") == int(np.array([END], U).view(np.int64)[0])).toPandas()
        n = (int(own.n.iloc[0]), int(own.kept.iloc[0])) if len(own) else (0, 0)
        hashes, values = np.append(hashes, U(END)), np.column_stack([top[["n", "kept"]].to_numpy(np.int64).T.reshape(2, -1), n])
    else:
        values = top[["n", "kept"]].to_numpy(np.int64).T
    order = np.argsort(hashes)
    hashes, values = hashes[order], values[:, order]
    texts = values[:, np.searchsorted(hashes, U(END))]
    return Vocabulary(hashes, values, np.array(s[:2]), np.array(s[2:]), texts)


def _dealt(v: Vocabulary, tokens: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the token and of its context."""
    ids = v.ids(tokens)
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[np.flatnonzero(np.diff(text, prepend=-1))] = v.start
    return ids, before


def _kinds(v: Vocabulary, ids: np.ndarray, before: np.ndarray, own: bool) -> np.ndarray:
    return (ids == v.rare) + np.int8(2) * (own & (before == v.rare))


def _octave(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, np.minimum(np.log2(np.maximum(n, 1)).astype(int), RARE_BUCKET - 1), NO_CONTEXT)


def _find(known: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted word; 0 for those not known."""
    if not len(known):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, values[at], 0)


def _packed(values: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, byte by byte over all of them: the high ones of sorted numbers are alike and travel compressed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(data: list[bytes], width: int) -> np.ndarray:
    out, i = np.zeros((sum(map(len, data)) // width, 8), np.uint8), 0
    for x in data:
        n = len(x) // width
        out[i : i + n, :width] = np.frombuffer(x, np.uint8).reshape(width, n).T
        i += n
    return out.view("<u8").ravel()


def _two(data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second halves of bytes that hold n words and then n numbers of a width."""
    sizes = [len(x) // (8 + width) for x in data]
    first = np.frombuffer(b"".join(x[: 8 * n] for x, n in zip(data, sizes)), U)
    return first, _unpacked([x[8 * n :] for x, n in zip(data, sizes)], width)


def _counted_words(data: list[bytes], part: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, sorted, with their counts: in all training texts (0) or those not deleted (1)."""
    rows = np.frombuffer(b"".join(data), U).reshape(-1, 3)
    words_, at = np.unique(rows[:, 0], return_index=True)
    return words_, rows[at, 1 + part].astype(float)


def _slices(keys: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(len(keys), np.int64)
    for i in range(0, len(keys), BLOCK):
        out[i : i + BLOCK] = mix(keys[i : i + BLOCK] ^ U(0xABCDEF)) % U(n)
    return out


def _shares(keys: np.ndarray, bit: int = 0) -> Iterator[np.ndarray]:
    """Positions of the keys in each of ``SHARES`` shares, by their bits from one on: equal keys are in the same share."""
    share = np.empty(len(keys), np.uint8)
    for i in range(0, len(keys), BLOCK):
        share[i : i + BLOCK] = (keys[i : i + BLOCK] >> keys.dtype.type(bit)) & keys.dtype.type(SHARES - 1)
    for i in range(SHARES):
        yield np.flatnonzero(share == i)


def _alike(keys: np.ndarray, what: np.ndarray) -> np.ndarray:
    """For each entry, the sum of ``what`` over the entries with its key."""
    values, back = np.unique(keys, return_inverse=True)
    return np.bincount(back, what, len(values))[back]


def _groups(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(where[part[0]]), part


def _tail_key(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(tokens + before.astype(U) * U(0x9FB21C651E98DF25))


def _merged(one: np.ndarray, two: np.ndarray | None, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct bigrams (those of the head are one number) with the sums of their numbers."""
    keys, at, back = np.unique(one if two is None else _tail_key(one, two), return_index=True, return_inverse=True)
    return one[at], None if two is None else two[at], *(np.bincount(back, x, len(keys)) for x in numbers)


def _bins(ratio: np.ndarray) -> np.ndarray:
    """0 for no evidence, else quarter octaves from 2 ** -15."""
    return np.where(ratio > 0, np.clip(np.rint(STEPS * np.log2(np.maximum(ratio, 1e-300))) + 60, 1, 255), 0).astype(np.int64)


def first_words(docs: DataFrame, counts: DataFrame, v: Vocabulary, n_slices: int) -> DataFrame:
    """slice, words (hash, count, count not deleted): the first words of bigrams outside the head, for the slices of the second words."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        voc = shared.value
        for batch in _small(batches):
            tokens, text = _sequence(batch)
            ids, before = _dealt(voc, tokens, text)
            at = np.flatnonzero(_kinds(voc, ids, before, True) == BOTH)
            found = np.unique(np.column_stack([tokens[at - 1].view(np.int64), _slices(tokens[at], n_slices)]), axis=0)
            yield pa.RecordBatch.from_pydict({"token": pa.array(found[:, 0], pa.int64()), "slice": pa.array(found[:, 1], pa.int64())})

    def pack(batches):
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy() for c in ("token", "n", "kept")])
            packed = [(s, rows[part].tobytes()) for s, part in _groups(batch.column("slice").to_numpy())]
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s for s, _ in packed], pa.int64()), "words": pa.array([w for _, w in packed], pa.binary())})

    found = docs.mapInArrow(run, "token bigint, slice bigint").distinct()
    return saved(found.join(counts, "token").select("slice", "token", "n", "kept").mapInArrow(pack, "slice bigint, words binary"))


def weights(docs: DataFrame, v: Vocabulary, n_slices: int, most: int = HOT, own: bool = False, firsts: DataFrame | None = None) -> tuple[np.ndarray, dict[int, int]]:
    """Mixture weights (buckets x 3: bigram, unigram, uniform) and the training counts of hot bigrams."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(v)

    def count(batches):
        voc, held = shared.value, {j: [] for j in (HEADS, TAIL, AFTER, BOTH)}

        def send(kind):
            parts, held[kind] = held[kind], []
            if not parts:
                return
            shares = [list(_shares(_slices(p[1], n_slices))) for p in parts]
            for i in range(SHARES):  # some slices at a time
                sums, one, two = (np.concatenate([p[j][..., at[i]] for p, at in zip(parts, shares)], axis=-1) if j < len(parts[0]) else None for j in range(3))
                a, b, k, g = _merged(one, two, *sums)
                for s, part in _groups(_slices(a, n_slices)):
                    for j in range(0, len(part), ROW_PAIRS):
                        x = part[j : j + ROW_PAIRS]
                        pairs = _packed(a[x], 5) if kind == HEADS else a[x].tobytes() + _packed(b[x], 8 if kind == BOTH else 4)
                        yield pa.RecordBatch.from_pydict({"slice": [s], "kind": pa.array([kind], pa.int32()), "pairs": [pairs], "kept": [k[x].astype(np.uint32).tobytes()], "gone": [g[x].astype(np.uint32).tobytes()]})

        def take(batch):
            tokens, text = _sequence(batch)
            ids, before = _dealt(voc, tokens, text)
            rest = batch.column("rest").to_numpy()[text]
            kinds, last = np.where(rest != HELD, _kinds(voc, ids, before, own), -1), np.roll(tokens, 1)
            for kind, parts in held.items():
                k = np.flatnonzero(kinds == kind)
                # a bigram outside the head keeps the word whose slice it goes to, and the other one
                one = last[k] if kind == AFTER else tokens[k]
                two = last[k] if kind == BOTH else ids[k].astype(U) if kind == AFTER else before[k].astype(U)
                if kind == HEADS:
                    one, two = two << U(18) | ids[k].astype(U), None
                gone = rest[k] == DELETED
                one, two, *sums = _merged(one, two, ~gone, gone)
                parts.append((np.stack(sums).astype(np.uint32), one, *(() if two is None else (two,))))

        for batch in _small(batches):
            take(batch)
            if sum(len(p[1]) for p in held[HEADS]) > ROOM:
                yield from send(HEADS)
            if sum(len(p[1]) for kind in (TAIL, AFTER, BOTH) for p in held[kind]) > ROOM:
                for kind in (TAIL, AFTER, BOTH):
                    yield from send(kind)
        for kind in held:
            yield from send(kind)

    def learn(group: pa.Table) -> pa.Table:
        voc = shared.value
        contexts, buckets = voc.contexts(1)
        total, uniform = max(1, voc.total[1]), 1 / (voc.distinct[1] + 1)
        hist, hot = {}, []

        def of(kind):
            t = group.filter(pc.equal(group.column("kind"), kind))
            pairs = t.column("pairs").to_pylist()
            one, two = (_unpacked(pairs, 5), None) if kind == HEADS else _two(pairs, 8 if kind == BOTH else 4)
            return one, two, *(np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32) for c in ("kept", "gone"))

        def note(n, bucket, single, kept, gone):
            cell = (bucket * 256 + _bins(kept / np.maximum(n, 1) / uniform)) * 256 + _bins(single / total / uniform)
            for c, k in zip(*[x.tolist() for x in _summed(cell, gone)]):
                hist[c] = hist.get(c, 0) + k

        keys, _, all_kept, all_gone = of(HEADS)
        for at in _shares(keys):
            key, _, kept, gone = _merged(keys[at], None, all_kept[at], all_gone[at])
            big = kept + gone > voc.total[0] / most
            one, two = (key & U((1 << 18) - 1)).astype(np.int64), (key >> U(18)).astype(np.int64)
            hot += zip((two[big] << 18 | one[big]).tolist(), (kept + gone)[big].astype(int).tolist())
            one, two, kept, gone = (x[gone > 0] for x in (one, two, kept, gone))
            note(contexts[two], buckets[two], voc.counts[1][one], kept, gone)
        del keys, all_kept, all_gone
        outside = {kind: of(kind) for kind in (TAIL, AFTER, BOTH)}
        firsts_of, first_counts = _counted_words(group.filter(pc.equal(group.column("kind"), COUNTS)).column("pairs").to_pylist(), 1)
        for shares in zip(*[_shares(x[0]) for x in outside.values()]):
            mine = {kind: _merged(*(x[at] for x in whole)) for (kind, whole), at in zip(outside.items(), shares)}
            known, of_known = _summed(*(np.concatenate([mine[TAIL][j], mine[BOTH][j]]) for j in (0, 2)))
            for kind, (one, two, kept, gone) in mine.items():
                one, two, kept, gone = (x[gone > 0] for x in (one, two, kept, gone))
                of_one, other = _find(known, of_known, one), two.astype(np.int64)
                if kind == TAIL:
                    note(contexts[other], buckets[other], of_one, kept, gone)
                elif kind == AFTER:
                    note(of_one, _octave(of_one), voc.counts[1][other], kept, gone)
                else:
                    n = _find(firsts_of, first_counts, two)
                    note(n, _octave(n), of_one, kept, gone)
        cells, numbers = [-1 - k for k, _ in hot] + list(hist), [n for _, n in hot] + list(hist.values())
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(numbers, pa.float64())})

    counted = docs.mapInArrow(count, "slice bigint, kind int, pairs binary, kept binary, gone binary")
    if firsts is not None:
        nothing = F.lit(b"")
        counted = counted.unionByName(firsts.select("slice", F.lit(COUNTS).alias("kind"), F.col("words").alias("pairs"), nothing.alias("kept"), nothing.alias("gone")))
    rows = counted.groupBy("slice").applyInArrow(learn, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    hot = {-1 - int(c): int(n) for c, n in zip(rows.cell, rows.n) if c < 0}
    rows = rows[rows.cell >= 0]
    return maximise(rows.cell.to_numpy(np.int64), rows.n.to_numpy(float)), hot


def _summed(keys, values):
    k, back = np.unique(keys, return_inverse=True)
    return k, np.bincount(back, values, len(k))


def maximise(cells: np.ndarray, n: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Expectation-maximisation on the histogram of (bucket, bigram ratio, unigram ratio) of deleted tokens."""
    level = lambda b: np.where(b > 0, 2.0 ** ((b - 60) / STEPS), 0)
    bucket = cells // 65536
    p = np.column_stack([level(cells // 256 % 256), level(cells % 256), np.ones(len(cells))])
    out = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    pooled = out.copy()
    for shape, table in ((np.zeros_like(bucket), pooled), (bucket, out)):
        if table is out:
            out[:] = pooled[0]
        for _ in range(rounds if len(cells) else 0):
            share = p * table[shape]
            share *= (n / share.sum(axis=1))[:, None]
            new = np.stack([np.bincount(shape, share[:, j], BUCKETS) for j in range(3)], axis=1) + 1e-3
            table[:] = np.where(new.sum(axis=1, keepdims=True) > 0.01, new / new.sum(axis=1, keepdims=True), table)
    out[NO_CONTEXT] = [0, out[NO_CONTEXT, 1], out[NO_CONTEXT, 2]]
    return out / out.sum(axis=1, keepdims=True)


def _by_text(sizes: list[np.ndarray], records: tuple[np.ndarray, ...], values: list[np.ndarray], facts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """For each row: its texts, and sums over their tokens of two facts (of the second kind of record) and the values; some rows at a time."""
    ends = [np.concatenate([[0], np.cumsum(n)]) for n in sizes]
    run = sum(ends)[1:] // BLOCK
    cuts, out = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)], []
    for a, b in zip(cuts, cuts[1:]):
        part = [slice(e[a], e[b]) for e in ends]
        cell = np.concatenate([np.repeat(np.arange(a, b), n[a:b]) << 12 | (r[p] & U(4095)).astype(np.int64) for n, r, p in zip(sizes, records, part)])
        cell, back = np.unique(cell, return_inverse=True)
        tails = back[part[0].stop - part[0].start :][: part[1].stop - part[1].start]
        sums = np.column_stack([*(np.bincount(tails, f[part[1]], len(cell)) for f in facts), np.bincount(back, np.concatenate([v[p] for v, p in zip(values, part)]), len(cell))])
        at = np.searchsorted(cell >> 12, np.arange(a, b + 1))
        out += [((cell[i:j] & 4095).astype(np.uint16).tobytes(), sums[i:j].tobytes()) for i, j in zip(at, at[1:])]
    return out


def score(docs: DataFrame, head: int = HEAD, slice_size: int = SLICE, most: int = HOT, own_contexts: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id"), FOLDS), F.lit(FOLDS - 1)).cast("int").alias("rest"))
    counts = saved(unigrams(docs))
    v = vocabulary(counts, head)
    n_slices = max(8, int(v.total[0] * 1.15) // slice_size + 1)
    if own_contexts:
        # training texts without a word outside the head need no counts of such words
        firsts = first_words(docs, counts, v, n_slices) if (v.counts[0] > 0).sum() < v.distinct[0] else None
        mixture, hot = weights(docs, v, n_slices, most, True, firsts)
    else:
        firsts = None
        mixture, hot = weights(docs, v, n_slices, most)
    total, distinct = int(v.total[0]), int(v.distinct[0])
    shared = spark.sparkContext.broadcast((v, mixture, np.array(sorted(hot), U), np.array([hot[k] for k in sorted(hot)], float)))
    floor, uniform = np.log10(total + 0.1 * (distinct + 1)), 1 / (distinct + 1)

    def mixed(n, bucket, pair, single):
        t = shared.value[1][bucket]
        return np.log10(t[:, 0] * pair / np.maximum(n, 1) + t[:, 1] * single / max(1, total) + t[:, 2] * uniform)

    def mixed_heads(contexts, before, pair, ids):
        n, bucket = (x[before] for x in contexts)
        return mixed(n, bucket, pair, shared.value[0].counts[0][ids])

    def base(counts):
        return np.log10(counts + 0.1) - floor

    def deal(batches):
        voc, _, hot_keys, hot_counts = shared.value
        task, contexts = TaskContext.get().partitionId() << 32, voc.contexts(0)
        for number, batch in enumerate(_small(batches)):
            tokens, text = _sequence(batch)
            ids, before = _dealt(voc, tokens, text)
            train = (batch.column("rest").to_numpy() != HELD)[text]
            n, block = batch.num_rows, [task + number]
            tail, kinds, last = ids == voc.rare, _kinds(voc, ids, before, own_contexts), np.roll(tokens, 1)
            keys = before.astype(U) << U(18) | ids.astype(U)
            at = np.minimum(np.searchsorted(hot_keys, keys), max(0, len(hot_keys) - 1))
            warm = (kinds == HEADS) & (hot_keys[at] == keys) if len(hot_keys) else np.zeros(len(keys), bool)
            here = np.zeros(n)
            if warm.any():
                here = np.bincount(text[warm], mixed_heads(contexts, before[warm], hot_counts[at[warm]], ids[warm]), n)
            single = voc.counts[0][ids[~tail]]
            yield pa.RecordBatch.from_pydict({
                "slice": [-1 - number % n_slices], "block": block, "head": [batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy().tobytes()],
                "tail": [np.column_stack([np.bincount(text, minlength=n), np.bincount(text[~tail], single > 0, n), np.bincount(text[~tail], base(single), n), here,
                                          batch.column("rest").to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)]).astype(float).tobytes()], "word": [b""], "first": [b""], "after": [b""]})
            # pair (36 bits), training text or not (1 bit), text (12 bits): 7 bytes
            cold = np.flatnonzero((kinds == HEADS) & ~warm)
            record = keys[cold] << U(13) | train[cold].astype(U) << U(12) | text[cold].astype(U)
            rest, after = np.flatnonzero(tail), np.flatnonzero(kinds == AFTER)
            note, after_note = (x.astype(U) << U(13) | train[k].astype(U) << U(12) | text[k].astype(U) for x, k in ((before[rest], rest), (ids[after], after)))
            head_of = dict(_groups(_slices(keys[cold], n_slices)))
            tail_of = dict(_groups(_slices(tokens[rest], n_slices)))
            after_of = dict(_groups(_slices(last[after], n_slices)))
            del ids, at, before, train, text, keys, tail
            for s in sorted({*head_of, *tail_of, *after_of}):
                a, b, c = head_of.get(s, cold[:0]), tail_of.get(s, rest[:0]), after_of.get(s, after[:0])
                words_ = rest[b]
                yield pa.RecordBatch.from_pydict({"slice": [s], "block": block, "head": [_packed(np.sort(record[a]), 7)], "tail": [_packed(note[b], 4)], "word": [tokens[words_].tobytes()],
                                                  "first": [last[words_][kinds[words_] == BOTH].tobytes()], "after": [last[after][c].tobytes() + _packed(after_note[c], 4)]})

    def rate(group: pa.Table) -> pa.Table:
        voc = shared.value[0]
        if group.column("slice")[0].as_py() < 0:
            return group.select(["block", "head", "tail"])
        block, given = group.column("block").to_numpy(), pc.less(group.column("block"), 0)
        firsts_of, first_counts = _counted_words(group.column("word").filter(given).to_pylist(), 0)
        tokens = np.frombuffer(b"".join(group.column("word").filter(pc.invert(given)).to_pylist()), U)
        firsts = np.frombuffer(b"".join(group.column("first").to_pylist()), U)
        record, note = _unpacked(group.column("head").to_pylist(), 7), _unpacked(group.column("tail").to_pylist(), 4)
        one, after = _two(group.column("after").to_pylist(), 4)
        sizes = [pc.binary_length(group.column(c)).to_numpy().astype(np.int64) // width for c, width in (("head", 7), ("tail", 4), ("after", 12))]
        contexts, values, facts = voc.contexts(0), [np.empty(len(x)) for x in (record, note, after)], np.empty((2, len(note)))
        for at in _shares(record, 13):
            r = record[at]
            pair = _alike(r >> U(13), (r >> U(12)) & U(1))
            values[0][at] = mixed_heads(contexts, (r >> U(31)).astype(np.int64), pair, ((r >> U(13)) & U((1 << 18) - 1)).astype(np.int64))
        other = note >> U(13)
        both = np.flatnonzero(other == U(voc.rare)) if own_contexts else np.zeros(0, np.int64)
        in_head = np.ones(len(note), bool)
        in_head[both], other[both] = False, firsts
        for at, later in zip(_shares(tokens), _shares(one)):  # a word outside the head is counted where it comes second
            train, heads = (note[at] >> U(12)) & U(1), in_head[at]
            known, back = np.unique(tokens[at], return_inverse=True)
            of_known = np.bincount(back, train, len(known))
            single, before = of_known[back], other[at]
            n, bucket = (x[np.where(heads, before, U(0)).astype(np.int64)] for x in contexts)
            n[~heads] = _find(firsts_of, first_counts, before[~heads])
            bucket[~heads] = _octave(n[~heads])
            values[1][at] = mixed(n, bucket, _alike(_tail_key(tokens[at], before), train), single)
            facts[:, at] = single > 0, base(single)
            ids, n = after[later] >> U(13), _find(known, of_known, one[later])
            pair = _alike(_tail_key(one[later], ids), (after[later] >> U(12)) & U(1))
            values[2][later] = mixed(n, _octave(n), pair, voc.counts[0][ids.astype(np.int64)])
        out = _by_text(sizes, (record, note, after), values, facts)
        rows = np.flatnonzero(block >= 0)
        return pa.table({"block": pa.array(block[rows], pa.int64()), **{c: pa.array([out[i][j] for i in rows], pa.binary()) for j, c in enumerate(("head", "tail"))}})

    def gather(group: pa.Table) -> pa.Table:
        heads, tails = group.column("head").to_pylist(), group.column("tail").to_pylist()
        lead = next(i for i, (h, t) in enumerate(zip(heads, tails)) if len(t) == 6 * len(h))  # the row with the texts themselves
        ids, facts = np.frombuffer(heads[lead], np.int64), np.frombuffer(tails[lead], float).reshape(-1, 6)
        sums = facts[:, 1:4].copy()
        for i, (h, t) in enumerate(zip(heads, tails)):
            if i != lead and len(h):
                sums[np.frombuffer(h, np.uint16)] += np.frombuffer(t, float).reshape(-1, 3)
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=facts[:, 5] == 0), "held_out": facts[:, 4] == HELD, "n_tokens": facts[:, 0].astype(np.int64),
                         "n_known": np.rint(sums[:, 0]).astype(np.int64), "base_score": sums[:, 1], "score": sums[:, 2]})

    dealt = docs.mapInArrow(deal, "slice bigint, block bigint, head binary, tail binary, word binary, first binary, after binary")
    if firsts is not None:
        nothing = F.lit(b"")
        dealt = dealt.unionByName(firsts.select("slice", F.lit(-1).cast("long").alias("block"), nothing.alias("head"), nothing.alias("tail"), F.col("words").alias("word"), nothing.alias("first"), nothing.alias("after")))
    rated = dealt.groupBy("slice").applyInArrow(rate, "block bigint, head binary, tail binary")
    out = rated.groupBy("block").applyInArrow(gather, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
