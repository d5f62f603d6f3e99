import numpy as np
import pandas as pd
import pytest

from tabspark.operators import folds


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    n = 503
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.35, 0, rng.integers(1, 60, n)),
                        "y": (rng.random(n) < 0.3).astype(int), "a": (rng.random(n) < 0.5).astype(int), "b": (rng.random(n) < 0.01).astype(int)})
    return pdf, spark.createDataFrame(pdf)


def assigned(f):
    return f.table.toPandas().sort_values("id").reset_index(drop=True)


def test_simple_cv(frame):
    pdf, df = frame
    s = folds.simple_cv(df, "id", 0.7, 0.2).summary().first()
    assert (s.train + s.val + s.test, s.test) == (503, 51)
    first, again = assigned(folds.simple_cv(df, "id")), assigned(folds.simple_cv(df.repartition(3), "id"))
    assert first.split.equals(again.split) and (first.split == "train").sum() == 402
    assert not first.split.equals(assigned(folds.simple_cv(df, "id", seed=7)).split)
    plain = assigned(folds.simple_cv(df, "id", shuffle=False))
    assert (plain.split[:402] == "train").all()
    for bad in ((0.0, None), (0.8, 0.3), (0.5, 1.0)):
        with pytest.raises(folds.FoldError):
            folds.simple_cv(df, "id", *bad)


def test_k_fold_sizes_and_views(frame):
    pdf, df = frame
    f = folds.k_fold(df, "id", 5)
    assert assigned(f).fold.value_counts().sort_index().tolist() == [101, 101, 101, 100, 100]
    assert f.train(2).count() == 402 and f.test(2).count() == 101
    assert f.splits().count() == 5 * 503
    summary = f.summary().toPandas().sort_values("fold")
    assert summary.train.tolist() == [402, 402, 402, 403, 403]
    with pytest.raises(folds.FoldError):
        folds.k_fold(df, "id", 1)


def test_repeated(frame):
    pdf, df = frame
    f = folds.repeated_k_fold(df, "id", 3, 2)
    table = f.table.toPandas()
    assert len(table) == 2 * 503 and f.n_folds == 6
    wide = table.pivot(index="id", columns="repeat", values="fold")
    assert (wide[0] != wide[1]).any()
    assert f.summary().count() == 6 and f.test(4).count() == len(table[(table.repeat == 1) & (table.fold == 1)])
    s = folds.repeated_stratified_k_fold(df, "id", "y", 4, 2).table.toPandas().merge(pdf[["id", "y"]], on="id")
    counts = s.groupby(["repeat", "fold"]).y.sum()
    assert counts.max() - counts.min() <= 1


def test_stratified(frame):
    pdf, df = frame
    t = assigned(folds.stratified_k_fold(df, "id", "y", 5))
    per_class = t.groupby(["y", "fold"]).size().unstack()
    assert (per_class.max(axis=1) - per_class.min(axis=1) <= 1).all()
    assert sorted(t.fold.value_counts().tolist()) == [100, 100, 101, 101, 101]
    m = assigned(folds.stratified_k_fold(df, "id", ["a", "b", "y"], 5))
    assert len(m) == 503 and sorted(m.fold.value_counts().tolist()) == [100, 100, 101, 101, 101]
    for label in ("a", "b", "y"):
        counts = m.groupby("fold")[label].sum()
        assert (counts - m[label].sum() / 5).abs().max() < 2 and (label == "a" or counts.max() - counts.min() <= 1)
    assert m.equals(assigned(folds.stratified_k_fold(df.repartition(3), "id", ["a", "b", "y"], 5)))


def test_label_sets_are_dealt_as_row_by_row():
    """Dealing a set at once gives the same demands as one row at a time, whatever its size."""
    rng = np.random.default_rng(8)
    for k in (2, 5, 7):
        sets = {tuple(map(int, rng.random(5) < [0.02, 0.1, 0.3, 0.5, 0.8])): int(n) for n in rng.integers(1, 400, 25)}
        out = dict(folds.deal_label_sets(sets, k))
        assert {s: sum(g) for s, g in out.items()} == sets
        for j in range(5):
            total = sum(n for s, n in sets.items() if s[j])
            per_fold = np.sum([g for s, g in out.items() if s[j]], axis=0) if total else np.zeros(k)
            assert np.abs(per_fold - total / k).max() < 4
        rare = min((j for j in range(5) if any(s[j] for s in sets)), key=lambda j: (sum(n for s, n in sets.items() if s[j]), j))
        counts = np.sum([g for s, g in out.items() if s[rare]], axis=0)
        assert counts.max() - counts.min() <= 1


def test_group_folds(frame):
    pdf, df = frame
    t = assigned(folds.group_k_fold(df, "id", "g", 3))
    assert (t.groupby("g").fold.nunique() == 1).all() and len(t) == 503
    # the greedy rule on the plain list of groups gives the same loads
    loads = [0, 0, 0]
    for size in sorted(pdf.g.value_counts(), reverse=True):
        loads[int(np.argmin(loads))] += size
    assert sorted(t.fold.value_counts().tolist()) == sorted(loads)
    with pytest.raises(folds.FoldError):
        folds.group_k_fold(df, "id", "y", 3)
    two = assigned(folds.group_k_fold(df, "id", ["g", "y"], 4))
    assert (two.groupby(["g", "y"]).fold.nunique() == 1).all()


def test_equal_groups_by_arithmetic():
    for loads, size, items in (([5, 0, 12], 3, 50), ([0, 0, 0, 0], 1, 999), ([7, 7], 2, 3)):
        want, state = [0] * len(loads), list(loads)
        for _ in range(items):
            i = int(np.argmin(state))
            state[i] += size
            want[i] += 1
        got = folds._fill_lightest(list(loads), size, items)
        assert sum(got) == items
        assert sorted(l + g * size for l, g in zip(loads, got)) == sorted(state)


@pytest.mark.parametrize("limit", [50_000, 5])
def test_stratified_groups(frame, limit, monkeypatch):
    pdf, df = frame
    monkeypatch.setattr(folds, "SIGNATURES_ON_DRIVER", limit)
    small = df.filter("g > 0")
    t = folds.stratified_group_k_fold(small, "id", "y", "g", 4).table.toPandas()
    assert len(t) == (pdf.g > 0).sum() and (t.groupby("g").fold.nunique() == 1).all() and t.fold.nunique() == 4
    share = t.groupby("fold").y.mean()
    assert (share - t.y.mean()).abs().max() < (0.1 if limit > 5 else 0.25)


def test_leave_one_out(frame):
    pdf, df = frame
    f = folds.leave_one_group_out(df, "id", "y")
    assert f.n_folds == 2 and (assigned(f).y == assigned(f).fold).all()
    loo = folds.leave_one_out(df, "id")
    assert sorted(assigned(loo).fold) == list(range(503)) and loo.n_folds == 503
    with pytest.raises(folds.FoldError):
        folds.leave_one_out(df.limit(1), "id")
