"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tabspark.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, piece string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", "y") for i, (t, g) in enumerate(rows)], SCHEMA)


def plain(rows, max_words=3, min_count=10, cover=50, top=2000):
    f, out = defaultdict(Counter), []
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for part in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", part)
            for m in range(1, max_words + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        wanted = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in wanted.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in wanted.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(30)] + ["Ünder", "l'été", "THE", "of"]
    weights = [1 / (i + 1) for i in range(len(names))]
    fixed = ["new york city hall", "alpha beta gamma", "of the of the of the"]
    rows = []
    for _ in range(n):
        w = rng.choices(names, weights, k=rng.randint(0, 25))
        if rng.random() < 0.3:
            w.insert(rng.randint(0, len(w)), rng.choice(fixed))
        rows.append(("".join(x + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", " \r\n "]) for x in w), rng.choice(["en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("shards,piece", [(1, 400), (3, 300)])
def test_equals_plain_counting(spark, shards, piece):
    rows = corpus()
    want = plain(rows)
    assert len(want) > 30 and any(r[2].count(" ") == 2 for r in want)
    assert got(phrases.collocations(frame(spark, rows).repartition(4), shards=shards, piece=piece)) == want


def test_longer_phrases_and_limits(spark):
    rows = corpus(5, 250) + [("a b c d e " * 4, "en")] * 6
    want = plain(rows, 4, 6, 70, 9)
    assert any(r[2].count(" ") == 3 for r in want)
    assert got(phrases.collocations(frame(spark, rows), 4, 6, 70, 9, shards=2, piece=500)) == want
    with pytest.raises(ValueError):
        phrases.collocations(frame(spark, rows), min_count=0)


def test_late_phrases_go_round_once(spark):
    """A phrase that becomes frequent in the last shard is still counted in the first."""
    rows = [("rare pair x", "en")] * 4 + [("filler words here now", "en")] * 40 + [("rare pair x", "en")] * 9
    want = plain(rows)
    assert [r for r in want if r[2] == "rare pair x"]
    assert got(phrases.collocations(frame(spark, rows).coalesce(1), shards=4, piece=60)) == want


def test_empty_null_and_long(spark):
    assert got(phrases.collocations(frame(spark, []))) == []
    assert got(phrases.collocations(frame(spark, [(None, "en"), ("", None), (" .,;\n", "en")]))) == []
    rows = [("word " * 30_000 + "end", None), (None, "en"), ("x" * 200_000 + " y", "en"), ("one two. " * 9, "en")] + [("ties a. ties b. b ties", "de")] * 10
    assert got(phrases.collocations(frame(spark, rows))) == plain(rows)
