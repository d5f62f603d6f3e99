"""Removal of repeated passages against plain word windows."""

import random
import re

import pyarrow as pa
import pytest

from tabspark.llm import substring_dedup as sd

SCHEMA = "doc_id bigint, text string, piece string, words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def plain(rows, window=13):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    owner = {}
    for i, w in split:
        if i is not None:
            for p in range(len(w) - window + 1):
                g = tuple(w[p : p + window])
                owner[g] = min(owner.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and owner[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ä", "naïve", " x", "日本", "W1"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(12, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, max(0, len(s) - 14))
            at = rng.randint(0, len(w))
            w[at:at] = s[a : a + rng.randint(12, 60)]
        rows.append((rng.randint(0, 10**12) if i % 10 else i % 30, "".join(x + rng.choice([" ", "\n", "\t ", "  "]) for x in w)))
    return rows


@pytest.mark.parametrize("window,gram,piece,shard", [(13, 6, 700, 1 << 16), (4, 2, 3000, 7), (13, 13, 1 << 20, 50)])
def test_equals_plain_windows(spark, window, gram, piece, shard):
    rows = corpus()
    want = plain(rows, window)
    assert sum(r[2] for r in want) > 300 and any(not r[2] for r in want)
    assert got(sd.remove_repeats(frame(spark, rows).repartition(5), window, gram, piece, shard)) == want


def test_special_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    loop = "again " * 5000
    rows = [(5, text), (5, text), (7, text), (7, text), (None, text), (3, None), (2, ""), (4, " \n\t"), (9, "short one"), (10, loop), (11, loop + "end"), (1, "x" * 50_000 + " " + text[:80]), (-4, text[10:])]
    want = plain(rows)
    assert {r[2] for r in want} > {0, 5001 - 1}
    assert got(sd.remove_repeats(frame(spark, rows))) == want
    assert got(sd.remove_repeats(frame(spark, []))) == []
    assert got(sd.remove_repeats(frame(spark, [(1, None)]))) == [(1, 0, 0, "")]
    with pytest.raises(ValueError):
        sd.remove_repeats(frame(spark, rows), window=5, gram=6)


def test_windows_are_judged_on_the_input(spark):
    """A passage that its owner loses to a third document is still an owner's."""
    a, b = [f"a{i}" for i in range(13)], [f"b{i}" for i in range(13)]
    rows = [(1, " ".join(a)), (2, " ".join(a + b)), (3, " ".join(a[6:] + b))]
    assert got(sd.remove_repeats(frame(spark, rows))) == plain(rows)


def test_words_are_confirmed_not_hashes():
    """Passages are compared by their words: equal windows only."""
    texts = pa.array(["a b c d", "a b c e", "b c d", "b c d"])
    passage, number, owner, shared = sd.confirm(texts, *(__import__("numpy").array(x) for x in ([2, 2, 1, 1], [4, 3, 9, 2], [4, 3, 9, 2])), 3)
    assert list(zip(passage.tolist(), number.tolist(), owner.tolist(), shared.tolist())) == [(0, 0, 3, True), (0, 1, 2, True), (1, 0, 3, True), (1, 1, 3, False), (2, 0, 2, True), (3, 0, 2, True)]
