"""Language model against a dictionary model; classifiers on planted words and held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabspark.llm import lm_score, quality, toxicity
from tabspark.llm.tokens import U

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


@pytest.mark.parametrize("head,hot", [(1 << 12, 1), (30, 64)])
def test_language_model(spark, monkeypatch, head, hot):
    r = random.Random(7)
    # frequencies differ, so the head does not depend on how ties are broken
    vocabulary = [f"V{i}" for i in range(80)]
    rows = [(i, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(80)], k=r.randint(0, 60)))) for i in range(150)]
    rows += [(900, None), (901, " \n\t"), (None, "v1 v2 new"), (3, "v1 v1 v1"), (902, "never seen " * 3)]
    learned, inner = {}, lm_score.weights

    def keep(docs, v, n, most):
        learned["v"], learned["w"] = v, inner(docs, v, n, most)
        return learned["w"]

    monkeypatch.setattr(lm_score, "weights", keep)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, slice string").repartition(4)
    got = sorted((tuple(x) for x in lm_score.score(docs, head, 300, hot).collect()), key=str)
    mixture, found_hot = learned["w"]
    assert (len(found_hot) > 0) == (hot == 64)
    rest = [9 if i is None else zlib.crc32(str(i).encode()) % 10 for i, _ in rows]
    texts = [tokens(t) for _, t in rows]
    single, pair, context = Counter(), Counter(), Counter()
    for f, w in zip(rest, texts):
        if f:
            single.update(w)
    n, v = sum(single.values()), len(single)
    known = set(learned["v"].hashes.tolist())

    def name(w):
        import pyarrow as pa

        from tabspark.llm.common import flat
        from tabspark.llm.tokens import SOLID, words

        data, offsets = flat(pa.array([w], pa.large_string()))
        return w if int(words(data, offsets, SOLID).hash[0]) in known else "<rare>"

    names = {w: name(w) for t in texts for w in t if w is not None}
    for f, w in zip(rest, texts):
        before = "<start>"
        for x in w:
            if f:
                pair[before, x] += 1
                context[before] += 1
            before = names.get(x)
    want = []
    for (i, _), f, w in zip(rows, rest, texts):
        score, before = 0.0, "<start>"
        for x in w:
            c = context[before]
            bucket = lm_score.NO_CONTEXT if not c else {"<start>": lm_score.START_BUCKET, "<rare>": lm_score.RARE_BUCKET}.get(before, int(math.log2(max(c, 1))))
            l2, l1, l0 = mixture[bucket]
            score += math.log10(l2 * pair[before, x] / max(c, 1) + l1 * single[x] / n + l0 / (v + 1))
            before = names.get(x)
        base = sum(math.log10((single[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((i, f == 0, len(w), sum(single[x] > 0 for x in w), n, base, score))
    for a, b in zip(got, sorted(want, key=str)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])
    assert np.allclose(mixture.sum(axis=1), 1) and len(got) == len(rows)


@pytest.mark.parametrize("hot", [1, 64])
def test_language_model_does_not_depend_on_the_size_of_the_head(spark, hot):
    """Words outside the head are contexts of their own, in training texts and in held-out ones, also side by side."""
    r = random.Random(8)
    names = [f"W{i}" for i in range(90)]
    rows = [(i, " ".join(r.choices(names, [1 / (k + 1) for k in range(90)], k=r.randint(0, 60)))) for i in range(200)]
    rows += [(900, None), (None, "w1 w2 new"), (3, "w80 w81 w80 w81"), (902, "never seen w85 never seen w85 w86")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    whole, small, none = (sorted((tuple(x) for x in lm_score.score(docs, head, 300, hot, own_contexts=True).collect()), key=str) for head in (1 << 12, 30, 1))
    assert len(whole) == len(rows)
    for a, b, c in zip(whole, small, none):
        assert a[:5] == b[:5] == c[:5] and a[5:] == pytest.approx(b[5:]) and a[5:] == pytest.approx(c[5:])


def test_language_model_sorts_a_slice_in_shares(spark, monkeypatch, tmp_path):
    """A task holds its records and their values, not several sorted copies of all of them."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    inner, folder = PandasGroupedOpsMixin.applyInArrow, str(tmp_path)

    def measured(self, task, schema):
        def run(group):
            import os
            import tracemalloc

            tracemalloc.start()
            try:
                out = task(group)
                with open(os.path.join(folder, task.__name__), "a") as f:
                    f.write(f"{tracemalloc.get_traced_memory()[1]}\n")
            finally:
                tracemalloc.stop()
            return out

        run.__annotations__ = dict(task.__annotations__)
        return inner(self, run, schema)

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", measured)
    docs = spark.range(3000, numPartitions=4).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 800), x -> concat('w', pmod(xxhash64(id, x), 20000)))) AS text")
    assert lm_score.score(docs, own_contexts=True).count() == 3000
    records = 3000 * 801 / 8
    for name, most in (("learn", 50), ("rate", 80)):
        assert max(map(int, (tmp_path / name).read_text().split())) / records < most, name


def test_language_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm_score.score(empty).count() == 0


def test_expectation_maximisation_finds_the_mixture():
    """Half of the tokens are explained by the bigram only, half by the unigram only."""
    strong, weak = 60 + 4 * 10, 60
    cells = np.array([(3 * 256 + strong) * 256 + 0, (3 * 256 + 0) * 256 + strong])
    out = lm_score.maximise(cells, np.array([500.0, 500.0]))
    assert abs(out[3, 0] - 0.5) < 0.02 and abs(out[3, 1] - 0.5) < 0.02 and weak < strong


def test_vocabulary_ids():
    hashes = np.sort(np.random.default_rng(1).integers(1, 1 << 63, 5000).astype(np.uint64))
    hashes[0] = U(lm_score.END)
    hashes = np.unique(hashes)
    v = lm_score.Vocabulary(hashes, np.ones((2, len(hashes)), np.int64), np.array([9, 9]), np.array([5, 5]), np.array([1, 1]))
    assert (v.ids(hashes) == np.arange(len(hashes))).all() and (v.ids(hashes + U(1)) == v.rare).all()


def brute_marginals(e, moves):
    """Sum over all state sequences."""
    n = len(e)
    total, on = 0.0, np.zeros(n)
    for code in range(1 << n):
        states = [code >> i & 1 for i in range(n)]
        weight, before = 1.0, 0
        for s, x in zip(states, e):
            weight *= moves[before, s] * (math.exp(x) if s else 1)
            before = s
        total += weight
        on += weight * np.array(states)
    return on / total


def test_forward_backward(monkeypatch):
    monkeypatch.setattr(toxicity, "SEGMENT", 4)
    rng = np.random.default_rng(2)
    moves = np.array([[1.0, 0.3], [0.6, 2.0]])
    sizes = [0, 1, 3, 4, 5, 9, 0]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e = rng.normal(size=first[-1])
    p, moved = toxicity.marginals(e, first, moves)
    for a, b in zip(first, first[1:]):
        assert np.allclose(p[a:b], brute_marginals(e[a:b], moves))
    assert moved.sum() == pytest.approx(len(e)) and moved[:, 1].sum() == pytest.approx(p.sum())


def labelled(spark, n=400):
    r = random.Random(9)
    rows, marks = [], []
    for i in range(n):
        w = [f"w{r.randrange(200)}" for _ in range(r.randint(5, 60))]
        bad, junk = r.random() < 0.3, r.random() < 0.3
        if bad:
            for _ in range(r.randint(2, 4)):
                w.insert(r.randrange(len(w)), r.choice(["Nastyword", "vilething", "grimstem" + str(r.randrange(50))]))
        rows.append((i, " ".join(f"{x}%%%" if junk else x for x in w), "s"))
        marks.append((i, int(not junk), int(bad)))
    rows += [(n, None, "s"), (n + 1, "", "s"), (None, "plain words", "s"), (0, rows[0][1], "s"), (n + 2, "Nastyword vilething", "s")]
    marks += [(None, 1, 1), (1, None, None), (5000, 1, 0)]
    return (spark.createDataFrame(rows, "doc_id bigint, text string, label string").repartition(3),
            spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), {i: (q, t) for i, q, t in marks if t is not None})


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    out = toxicity.toxicity(docs, labels).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "label", "__score", "__spans"} and len(out) == docs.count()
    for r in out:
        assert 0 <= r["__score"] <= 1
        words = [r.text[a:b].lower() for a, b in r["__spans"]]
        assert all(w in ("nastyword", "vilething") or w.startswith("grimstem") for w in words)
    held = [r for r in toxicity.report(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.95
    rest = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert rest[402].predicted == 1 and rest[400].predicted == rest[401].predicted == 0
    clean = toxicity.report(docs, labels.where("toxic = 0"))
    assert {r.score for r in clean.collect()} == {0.0}
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    out = quality.report(docs, labels).collect()
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(out) == docs.count() and len(held) > 50
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in held]) > 0.95
    assert {r.score for r in quality.report(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.report(docs.limit(0), labels).count() == 0


def test_hinge_separates():
    rng = np.random.default_rng(4)
    rows = [np.concatenate([[i % 2], 2 + rng.choice(20, 3, replace=False)]) for i in range(100)]
    y = np.array([1 if r[0] else -1 for r in rows])
    w, b = quality.hinge(rows, np.ones(22), y)
    assert all(np.sign(w[r].sum() + b) == s for r, s in zip(rows, y))
