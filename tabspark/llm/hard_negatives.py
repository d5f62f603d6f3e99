"""Hard negatives of an embedding table, by exact integer scores from a residue number system.

Components become integers, ``floor(scale * x)``.  A score is the inner product of two such rows.  It is computed as one
float32 matrix product per small prime: residues are below ``LARGEST_PRIME / 2`` in size and at most ``SPAN`` of them are added up
before the sum is reduced, so every partial sum stays below 2**24, where float32 is exact.  The products modulo
several primes give the signed score by Chinese remaindering in mixed radix.  How many primes are used follows from
the largest row norm of the table, which bounds every score.

Anchors go in blocks of bounded bytes: a block is broadcast and meets all rows twice.  The first pass keeps the ``n_positives``
best other rows of the anchor's label, the second, for each of these, the ``n_negatives`` best rows of other labels whose score
lies in the window the positive sets.  A task keeps a few rows per anchor, so a label or a value that a third of all rows share
makes no difference to where rows go or how many leave a task.

Rows with a null id, a null label, a null vector, or a null or non-finite component take no part; so does an empty vector.  Vectors of different
lengths are compared as if the shorter one went on with zeros.  "Other rows" are rows of another id: repeated rows of an id all take part,
each as an anchor, positive or negative of its own, and equal scores are ordered by id.  A table without anchors gives an empty
result.  Ids and labels are whole numbers.  Further columns are ignored.  If a row's squared norm passes 2**62, scores may not fit 64 bits, and a ValueError says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark.llm.common import saved

LARGEST_PRIME, SPAN = 1021, 64  # 64 * 510 ** 2 < 2 ** 24
ANCHOR_BYTES = 16 << 20  # integer components of the anchors of a block
ROWS, ANCHORS = 2048, 512  # size of the tiles a task computes at a time
ROWS_PER_TASK = 20_000
NONE = np.iinfo(np.int64).min


def primes(bound: int) -> list[int]:
    """The largest primes whose product passes twice ``bound``, with room to spare."""
    found, product, p = [], 1, LARGEST_PRIME
    while product <= 2 * bound + 2:
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
        p -= 1
    return found


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """The residue of smallest size, for float32 integers below 2**24."""
    r = x - np.float32(p) * np.rint(x * np.float32(1 / p))
    half = np.float32(p // 2)
    r[r > half] -= np.float32(p)
    r[r < -half] += np.float32(p)
    return r


def residues(q: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    out = []
    for p in moduli:
        r = q % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(left: list[np.ndarray], right: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact inner products of all rows of two residue matrices (one matrix per prime), as int64."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(moduli):
        a, b = left[k], right[k]
        r = np.zeros((len(a), len(b)), np.float32)
        for i in range(0, a.shape[1], SPAN):
            part = a[:, i : i + SPAN] @ b[:, i : i + SPAN].T
            r = _centred(r + _centred(part, p), p) if i else _centred(part, p)
        for d, m in zip(digits, moduli):  # next digit in mixed radix
            inverse = pow(m, -1, p)
            r = _centred(_centred(r - d, p) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
        digits.append(r)
    total = digits[-1].astype(np.int64)
    for d, m in zip(digits[-2::-1], moduli[-2::-1]):
        total *= m
        total += d.astype(np.int64)
    return total


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an array column as a matrix of integers; short rows end in zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims), np.int64)
    if len(values) == out.size:
        out[:] = values.reshape(out.shape)
    else:
        row = np.repeat(np.arange(len(column)), lengths)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, q (integer components) and norm (their squared sum) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).filter(pc.and_(pc.is_valid(batch.column("vec_id")), pc.and_(pc.is_valid(batch.column("label")), pc.is_valid(batch.column("embedding")))))
            column = rows.column("embedding").combine_chunks()
            lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            first = np.cumsum(lengths) - lengths
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = (lengths > 0) & (wrong[first + lengths] == wrong[first])
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(scale * values)
                square = np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(whole), whole, 0) ** 2)]) if np.abs(whole[np.isfinite(whole)]).max(initial=0) < 2.0**20 else None
            if square is not None:
                norm = square[first + lengths] - square[first]
            else:
                norm = np.array([float(np.sum(whole[f : f + n] ** 2)) for f, n in zip(first, lengths)])
            part = np.repeat(good, lengths)
            kept = np.clip(whole[part], -(2.0**62), 2.0**62).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths[good])]).astype(np.int32)
            table = rows.filter(pa.array(good))
            yield pa.RecordBatch.from_pydict({
                "vec_id": table.column("vec_id").combine_chunks().cast(pa.int64()), "label": table.column("label").combine_chunks().cast(pa.int64()),
                "q": pa.ListArray.from_arrays(pa.array(ends), pa.array(kept)), "norm": pa.array(norm[good], pa.float64())})

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id bigint, label bigint, q array<bigint>, norm double")


class Tops:
    """The k best rows so far of each of n lists."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def add(self, at: slice, s: np.ndarray, ids: np.ndarray) -> None:
        """Offer a tile of scores (lists x rows); cells of NONE are no candidates.  Rows are looked at only where one can enter the list."""
        worst = self.score[at, -1]
        open_lists = np.flatnonzero((s >= worst[:, None]).any(axis=1) & (s.max(axis=1) > NONE)) if s.shape[1] else []
        for j in open_lists:
            row, here = s[j], at.start + j
            limit = max(worst[j], NONE + 1)
            if len(row) > self.k:
                limit = max(limit, np.partition(row, len(row) - self.k)[len(row) - self.k])
            c = np.flatnonzero(row >= limit)
            value, name = np.concatenate([self.score[here], row[c]]), np.concatenate([self.id[here], ids[c]])
            order = np.lexsort((name, ~value))[: self.k]
            self.score[here], self.id[here] = value[order], name[order]

    def batch(self, **keys: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > NONE)
        return pa.RecordBatch.from_pydict({**{k: pa.array(v[i]) for k, v in keys.items()}, "score": pa.array(self.score[i, j]), "vec_id": pa.array(self.id[i, j])})


def _tiles(batches: Iterator[pa.RecordBatch], anchors: np.ndarray, moduli: list[int]):
    """Row ids and labels, the anchors of a tile, and their scores, for all rows of a task against a block of anchors."""
    dims = anchors.shape[1]
    left = residues(anchors, moduli)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            right = residues(matrix(part.column("q"), dims), moduli)
            ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
            for a in range(0, len(anchors), ANCHORS):
                at = slice(a, min(a + ANCHORS, len(anchors)))
                yield ids, labels, at, scores([x[at] for x in left], right, moduli)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column | None = None, scale: int = 256, n_positives: int = 5, n_negatives: int = 3,
                   window: tuple[int, int] = (50, 95), anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """Per anchor and positive up to ``n_negatives`` rows of another label with window[0] * positive <= 100 * negative <= window[1] * positive.

    ``vectors`` has vec_id (whole numbers), label and embedding; ``anchor`` is a condition on vec_id (all rows if not given).
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    rows = saved(quantized(vectors, scale))
    facts = rows.agg(F.max("norm").alias("norm"), F.max(F.size("q")).alias("dims"), F.count(F.lit(1)).alias("n")).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    chosen = rows.where(F.lit(True) if anchor is None else anchor).select("vec_id", "label", "q")
    n_anchors = chosen.count()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    if facts["norm"] >= 2.0**62:
        raise ValueError(f"squared norm {facts['norm']:.3g} of a row at scale {scale}: scores would not fit 64 bits")
    moduli, dims = primes(int(facts["norm"] * (1 + 1e-9)) + 1), facts["dims"]
    n_blocks = -(-n_anchors * 8 * dims // anchor_bytes)
    blocks = saved(chosen.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks))).repartition(n_blocks, "block"))
    parallel = max(spark.sparkContext.defaultParallelism, -(-facts["n"] // ROWS_PER_TASK))
    spread = saved(rows.select("vec_id", "label", "q").repartition(parallel))
    results = []
    for b in range(n_blocks):
        mine = blocks.where(F.col("block") == b).select("vec_id", "label", "q").toArrow().combine_chunks()  # about anchor_bytes
        if mine.num_rows:
            results.append(_block(spread, mine, dims, moduli, n_positives, n_negatives, window))
    return reduce(DataFrame.unionByName, results).select(*[f.split()[0] for f in schema.split(", ")])


def _block(rows: DataFrame, mine: pa.Table, dims: int, moduli: list[int], n_positives: int, n_negatives: int, window: tuple[int, int]) -> DataFrame:
    context = rows.sparkSession.sparkContext
    ids, labels = mine.column("vec_id").to_numpy(), mine.column("label").to_numpy()
    block = context.broadcast((matrix(mine.column("q").combine_chunks(), dims), ids, labels))

    def positives(batches):
        q, anchor_ids, anchor_labels = block.value
        tops = Tops(len(q), n_positives)
        for row_ids, row_labels, at, s in _tiles(batches, q, moduli):
            s[(anchor_labels[at, None] != row_labels) | (anchor_ids[at, None] == row_ids)] = NONE
            tops.add(at, s, row_ids)
        yield tops.batch(anchor=np.arange(len(q)))

    found = _first(rows.mapInArrow(positives, "anchor bigint, score bigint, vec_id bigint"), ["anchor"], n_positives)
    known = found.orderBy("anchor", "rank").toArrow()  # at most n_positives per anchor of the block
    at_anchor, at_score, at_id = (known.column(c).to_numpy() for c in ("anchor", "score", "vec_id"))
    # 50 * positive <= 100 * negative <= 95 * positive, solved for the negative in whole numbers
    low = np.array([-(-window[0] * int(s) // 100) for s in at_score], np.int64)
    high = np.array([window[1] * int(s) // 100 for s in at_score], np.int64)
    bounds = context.broadcast((at_anchor, low, high))

    def negatives(batches):
        q, _, anchor_labels = block.value
        owner, lo, hi = bounds.value
        tops = Tops(len(owner), n_negatives)
        for row_ids, row_labels, at, s in _tiles(batches, q, moduli):
            s[anchor_labels[at, None] == row_labels] = NONE
            a, b = np.searchsorted(owner, [at.start, at.stop])
            if a == b:
                continue
            mine = s[owner[a:b] - at.start]
            mine[(mine > hi[a:b, None]) | (mine < lo[a:b, None])] = NONE
            tops.add(slice(a, b), mine, row_ids)
        yield tops.batch(pair=np.arange(len(owner)))

    won = _first(rows.mapInArrow(negatives, "pair bigint, score bigint, vec_id bigint"), ["pair"], n_negatives)
    pairs = rows.sparkSession.createDataFrame(pa.table({
        "pair": pa.array(np.arange(len(at_id))), "anchor_id": pa.array(ids[at_anchor]), "positive_id": pa.array(at_id), "positive_score": pa.array(at_score)}))
    return saved(won.join(F.broadcast(pairs), "pair").select(  # one row per positive of the block
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def report(vectors: DataFrame) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; rows whose id is divisible by 7 pass for the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)
