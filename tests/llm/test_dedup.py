"""Exact, line and near dedup, and decontamination, against brute force."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabspark.llm import decontamination, exact_dedup, line_dedup, near_dedup
from tabspark.llm.common import attach

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id bigint, text string, key string, block int, size int, component string, id int, node int"


def docs_of(spark, rows, parts=3):
    """Documents with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "k", 1, 2, "c", 3, 4) for i, t in rows], SCHEMA).repartition(parts)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Éa", "ß"]
    make = lambda k: " ".join(r.choice(words) for _ in range(k))
    common = "A Shared line!"
    rows = []
    for i in range(n):
        rows.append((i, "\n".join(make(r.randint(3, 40)) for _ in range(r.randint(1, 5)))))
    rows += [(n + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(8)]
    rows += [(n + 20 + i, f"{make(30)}\n {common.lower() if i % 2 else common}\t\n{make(5)}\n\n{common}") for i in range(12)]
    rows += [(200, None), (201, ""), (202, "   "), (203, "one two"), (204, "ONE two"), (205, "x" * 50_000), (None, rows[0][1]), (5, rows[5][1])]
    return rows


def test_attach_spreads_hot_keys_and_keeps_all_rows(spark):
    rows = spark.range(3000).select((F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 700)).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    out = attach(rows.unionByName(spark.sql("SELECT CAST(NULL AS bigint) k, -1L id")), groups, "k", "n").toPandas()
    want = rows.toPandas().groupby("k").id.agg(["count", "max"])
    assert len(out) == 3001 and out[out.id == -1].n.isna().all()
    known = out[out.id >= 0]
    assert (known.n.to_numpy() == want.loc[known.k, "count"].to_numpy()).all() and (known.top.to_numpy() == want.loc[known.k, "max"].to_numpy()).all()


@pytest.mark.parametrize("chunk_hash", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])
def test_exact_dedup(spark, chunk_hash):
    rows = corpus() + [(300, "long. " * 3000), (301, "LONG. " * 3000), (302, "long. " * 2999 + "Long! ")]
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(docs_of(spark, rows), chunk_hash).collect()}
    norm = [(i, (t or "").translate(LOWER)) for i, t in rows]
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        r = got[i, hashlib.sha256(t.encode()).hexdigest()]
        keep = max((j for j in same if j is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), i == keep)
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def brute_lines(rows, min_docs):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    seen = {}
    for n, (_, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            seen.setdefault(k, set()).add(n)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or len(seen[key(x)]) < min_docs]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [2, 10])
def test_line_dedup(spark, min_docs):
    rows = corpus()
    docs = docs_of(spark, rows)
    got = sorted((tuple(r) for r in line_dedup.line_report(docs, min_docs).collect()), key=str)
    assert got == brute_lines(rows, min_docs)
    for more in ({"set_bytes": 0}, {"max_bits": 1 << 10}):  # joins instead of a broadcast; a filter that is full
        out = line_dedup.drop_repeated_lines(docs, min_docs, **more)
        assert out.columns[: len(docs.columns)] == docs.columns
        again = out.select("doc_id", "__n_lines", "__n_dropped", F.sha2("text", 256)).collect()
        assert sorted((tuple(r) for r in again), key=str) == brute_lines(rows, min_docs)
    assert line_dedup.line_report(docs_of(spark, [])).count() == 0


def test_first_occurrence_keeps_its_lines(spark):
    rows = [(3, "same\nc"), (1, "Same \na"), (2, "same\nb"), (4, "d")]
    out = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs_of(spark, rows), 2, keep_first=True).collect()}
    assert out == {1: "Same \na", 2: "b", 3: "c", 4: "d"}


@pytest.mark.parametrize("set_bytes", [0, 1 << 20])
def test_first_occurrence_by_broadcast_and_by_join(spark, set_bytes):
    rows = corpus() + [(i, "twin line\nother twin line") for i in range(300, 312)]
    out = line_dedup.drop_repeated_lines(docs_of(spark, rows), 2, keep_first=True, set_bytes=set_bytes).collect()
    keys = lambda t: {k for x in (t or "").split("\n") if (k := x.strip(" \t\n\x0b\x0c\r").translate(LOWER))}
    assert len(out) == len(rows) and set().union(*[keys(r.text) for r in out]) == set().union(*[keys(t) for _, t in rows])
    assert all(n == 1 for n in Counter(k for r in out for k in keys(r.text)).values())
    assert {r.doc_id: r.text for r in out if r.doc_id and r.doc_id >= 300} == {300: "twin line\nother twin line"} | {i: "" for i in range(301, 312)}


def test_pipeline_stages_leave_one_whole_document_of_many_copies(spark):
    r = random.Random(9)
    line = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(40))
    text, other = "\n".join(line() for _ in range(5)), [line() for _ in range(5)]
    rows = [(100 + i, text) for i in range(12)] + [(200 + i, "\n".join([*other, f"own{i} " + line()])) for i in range(11)]
    rows += [(300, None), (301, ""), (302, " \n ")]
    docs = docs_of(spark, rows).withColumn("n_chars", F.lit(1).cast("bigint"))
    out = {x.doc_id: x for x in corpus_pipeline.dedup_near(spark, corpus_pipeline.dedup_lines(spark, docs, ""), "").collect()}
    assert [i for i in out if 100 <= i < 200] == [100] and out[100].text == text and out[100].n_chars == len(text)
    assert out[200].text == rows[12][1] and all(out[200 + i].text == rows[12 + i][1].split("\n")[-1] for i in range(1, 11))
    assert set(out) == {100, 300, 301, 302} | {200 + i for i in range(11)}


def test_second_filter_has_every_repeated_key():
    import numpy as np

    once, values = np.zeros(1 << 12, np.uint8), np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    line_dedup._add(once, line_dedup._bits(values, 1 << 15))
    assert line_dedup._has(once, line_dedup._bits(values, 1 << 15)).all()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if same_id or None not in (rows[a][0], rows[b][0]) and both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if top(b) == top(a)]
        out.append((i, len(sets[a]), None if i is None else min(ids)))
    return sorted(out, key=str)


def edited(r, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_near_dedup(spark):
    r = random.Random(3)
    rows = [(i, t) for i, t in corpus(2, 40) if (i, t) != (5, None)]
    base = " ".join(f"b{r.randrange(5000)}" for _ in range(400))
    rows += [(1000 + i, edited(r, base, r.choice([0, 1, 3, 6, 8]))) for i in range(80)]
    chain = base.upper()
    for i in range(12):  # neighbours are similar, the ends are not
        chain = edited(r, chain, 3)
        rows.append((2000 + i, chain))
    rows.append((1000, "quite another text under an old number"))
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.near_dedup(docs_of(spark, rows)).collect()), key=str)
    assert got == brute_components(rows)


@pytest.mark.parametrize("depth,bundle", [(2, 6), (0, 12), (4, 1000)])
def test_near_dedup_large_nodes(spark, depth, bundle):
    """Bundles of a few members: nodes are cut into blocks, branch and meet their outsiders."""
    r = random.Random(5)
    shared = " ".join(f"s{i}" for i in range(120))
    rows = [(i, shared + " " + " ".join(f"u{i}_{j}" for j in range(60))) for i in range(40)]
    rows += [(100 + i, edited(r, rows[i % 5][1], 2)) for i in range(30)]
    docs = docs_of(spark, rows)
    rows_, classes = near_dedup.links(docs, 85, trees=8, depth=depth, leaf=4, bundle_rows=bundle)
    got = rows_.join(classes, "digest", "left").select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_components(rows)


def test_bundle_counts_and_links_like_plain_sets(monkeypatch):
    import numpy as np

    r = random.Random(8)
    sets = [sorted(r.sample(range(60), r.randint(1, 40))) for _ in range(30)]
    sets += [sorted(set(sets[i % 30]) ^ {100 + i}) for i in range(40)]
    arrays = [np.array(s, np.uint64) for s in sets]
    plain = [[len(set(a) & set(b)) for b in sets] for a in sets]
    counted = near_dedup._shared(arrays)
    assert all(counted[i][j] == plain[i][j] for i in range(70) for j in range(70) if i != j)
    assert near_dedup._shared(arrays[:9], arrays[9:]).tolist() == [p[9:] for p in plain[:9]]
    want = list(range(70))
    for i in range(70):
        for j in range(70):
            if i != j and 100 * plain[i][j] >= 80 * (len(sets[i]) + len(sets[j]) - plain[i][j]):
                want = [min(want[i], want[j]) if k in (want[i], want[j]) else k for k in want]
    for tile in (100, 16):
        monkeypatch.setattr(near_dedup, "TILE", tile)
        bundle = near_dedup._Bundle(np.arange(70), arrays, 80)
        bundle.dense(np.arange(70))
        assert bundle.label.tolist() == want
        a, b = bundle.merged()
        assert dict(zip(a.tolist(), b.tolist())) == {k: w for k, w in enumerate(want) if k != w}


def test_near_dedup_edges(spark):
    assert near_dedup.near_dedup(docs_of(spark, [])).count() == 0
    out = near_dedup.keep_one(docs_of(spark, [(1, None), (2, ""), (3, "a b"), (4, "A  b\n"), (None, "a b")]))
    assert sorted(str(x.doc_id) for x in out.collect()) == ["1", "2", "3", "None"] and out.columns == SCHEMA.replace(",", "").split()[::2]


def test_pipeline_stage_links_from_four_fifths_on(spark):
    w = [f"w{i}" for i in range(150)]
    near, far = list(w), list(w)
    for i in (20, 70, 120):
        near[i] = f"n{i}"  # 131 of 161 shingles: 0.81
    for i in (20, 60, 100, 130):
        far[i] = f"f{i}"  # 126 of 166: 0.76
    docs = docs_of(spark, [(i, " ".join(x)) for i, x in enumerate([w, near, far], 1)])
    assert sorted(x.doc_id for x in corpus_pipeline.dedup_near(spark, docs, "").collect()) == [1, 3]
    assert [x.kept for x in near_dedup.near_dedup(docs).orderBy("doc_id").collect()] == [True, True, True]  # op10 stays at 85


def brute_hits(rows, items, window=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for i, t in rows:
        w, hit, ids = low(t), set(), set()
        for k, x in items:
            v = low(x)
            n = min(len(v), window)
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p : p + n]) in grams:
                    hit.update(range(p, p + n))
                    ids.add("null" if k is None else str(k))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark):
    r = random.Random(4)
    word = lambda: r.choice(["aa", "bb", "cc", "Été", "d1"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 9, 10, 11, 25, 60, 1])] + [(50, None), (51, "..."), (None, "zz yy xx"), (3, "Other words of item number three, twelve of them in a row.")]
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 80)))) for i in range(60)]
    rows += [(100 + i, "q - ".join(["w w", (items[i][1] or "").upper(), "end"])) for i in range(len(items))] + [(200, None), (201, ""), (None, "zz yy xx"), (100, "again")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.report(docs_of(spark, rows), bench)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_hits(rows, items)
    # blocks of one item each give the same spans
    one, many = (decontamination.contamination(docs_of(spark, rows), bench, block_bytes=b).select("doc_id", "__n_words", "__spans", "__items").collect() for b in (1 << 20, 60))
    assert sorted(map(str, one)) == sorted(map(str, many))
    empty = decontamination.report(docs_of(spark, rows[:3]), bench.limit(0)).collect()
    assert not any(x.contaminated for x in empty) and decontamination.report(docs_of(spark, []), bench).count() == 0


def test_every_long_span_has_a_fingerprint():
    import numpy as np

    from tabspark.llm.tokens import mix

    h = mix(np.arange(1, 400, dtype=np.uint64))
    for length in range(1, 11):
        k, per = decontamination._sizes(length)
        at, _ = decontamination.winnow(h, np.array([0, len(h)]), k, per)
        assert all(((at >= s) & (at + k <= s + length)).any() for s in range(len(h) - length + 1))


def test_tokens_cut_texts_like_the_expression():
    from tabspark.llm.common import flat
    from tabspark.llm.tokens import ALNUM, SOLID, words

    texts = ["A bc, d", "", "é€ x\n", "x", "ends9", "9starts ÀB"]
    data, offsets = flat(pa.array(texts, pa.large_string()))
    for kind, pattern in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (SOLID, r"[^\x20\x09-\x0D]+")):
        w = words(data, offsets, kind)
        for n, t in enumerate(texts):
            got = [bytes(data[s:e]).lower().decode() for s, e in zip(w.start[w.first[n] : w.first[n + 1]], w.end[w.first[n] : w.first[n + 1]])]
            assert got == re.findall(pattern, t.translate(LOWER))
