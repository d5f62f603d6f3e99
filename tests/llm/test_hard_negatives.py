"""Hard negatives against plain Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int, norm string, q string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows], SCHEMA)


def plain(rows, every, scale=256, n_positives=5, n_negatives=3):
    use = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows
           if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, ya in use:
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(va, v)), i, y) for i, v, y in use if i != a)
        for p, pid, _ in [x for x in s if x[2] == ya][:n_positives]:
            kept = [x for x in s if x[2] != ya and 50 * -p <= 100 * -x[0] <= 95 * -p][:n_negatives]
            out += [(a, pid, r + 1, x[1], -p, -x[0]) for r, x in enumerate(kept)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("bits", [10, 20, 40, 52])
def test_residue_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    top = 1 << (bits // 2)
    a, b = rng.integers(-top, top + 1, (7, 200)), rng.integers(-top, top + 1, (9, 200))
    a[0], b[0], b[1] = top, top, -top
    moduli = hn.primes(200 * top * top)
    assert math.prod(moduli) > 400 * top * top and len(set(moduli)) == len(moduli)
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
    assert hn.scores(hn.residues(a, moduli), hn.residues(b, moduli), moduli).tolist() == want


def test_largest_sums_stay_whole():
    moduli = hn.primes(10)
    a = np.full((1, hn.SPAN), moduli[0] // 2)
    assert hn.SPAN * (hn.LARGEST_PRIME // 2) ** 2 < 2**24
    assert hn.scores(hn.residues(a, hn.primes(int((a * a).sum()))), hn.residues(a, hn.primes(int((a * a).sum()))), hn.primes(int((a * a).sum()))).item() == int((a * a).sum())


def test_against_plain(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) + [1.5, 0, 0, 0, 0, 0]).round(2).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1], i % 2) for i in range(60)]  # ties
    rows += [(400, None, 1), (401, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (402, [math.nan] * 6, 1), (403, [math.inf] * 6, 0), (404, [], 0), (405, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(410, [2.0, 1.0], 0), rows[20], rows[20]]  # a short row, repeated rows of an anchor
    df = frame(spark, rows)
    want = plain(rows, 20)
    assert len(want) > 100
    assert got(hn.hard_negatives(df, F.col("vec_id") % 20 == 0)) == want
    assert got(hn.hard_negatives(df.repartition(7), F.col("vec_id") % 20 == 0, anchor_bytes=200)) == want  # many blocks of anchors


def test_large_components_and_limits(spark):
    rows = [(i, [float((i * 37 % 11 - 3) << 18), float((i * 53 % 13) << 18)], i % 2) for i in range(40)]
    assert got(hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == plain(rows, 10) != []
    with pytest.raises(ValueError, match="64 bits"):
        hn.hard_negatives(frame(spark, [(0, [1e300], 0), (1, [1.0], 0)]))
    assert got(hn.hard_negatives(frame(spark, []))) == []
    assert got(hn.hard_negatives(frame(spark, [(1, [1.0], 0)]), F.col("vec_id") % 2 == 0)) == []
    assert got(hn.hard_negatives(frame(spark, [(2, [1.0], 0)]))) == []


def test_one_label_and_equal_rows(spark):
    rows = [(i, [1.0, 0.5], 0) for i in range(100)] + [(100 + i, [0.7, 0.2], 1) for i in range(30)]
    want = plain(rows, 50)
    assert want and got(hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)) == want
