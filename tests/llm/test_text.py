"""HTML extraction, license automata, SentencePiece, and the pipeline."""

import os
import re

import numpy as np
import pytest

import corpus_pipeline
from tabspark.llm import html_extract, license_scan, sentencepiece_codec


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string, host string").repartition(2)
    return {r.page_id: r for r in html_extract.extract(df).collect()}


def test_html_rules(spark):
    cases = [
        ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=x>menu</a></nav><article><h1>A &amp; B</h1><p>one\n two <b>bold</b><br>three<p>four</article><footer>f</footer>", "A & B\n\none two bold three\n\nfour"),
        ("<article><p>kept<div class='ad'>buy</div><p>too<section id=comments><p>troll</section></article>", "kept\n\ntoo"),
        ("<body><div class=\"site-header\">x</div><div><p>Plain &lt;text&gt; &#233;&nbsp;y</p><ul><li>a<li>b</ul></div><aside>no</aside><form><p>mail</p></form></body>", "Plain <text> é\xa0y\n\na\n\nb"),
        ("<main><p>cut off <i>here</i> and <a hre", "cut off here and"),
        ("<article><p>x<!-- <p>hidden</p> -->y</p><div class='cookie-notice'>ok?</div><table><tr><td>1</td><td>2</td></tr></table></article>", "xy\n\n1 2"),
        ("<div><a href=1>only</a> <a href=2>links</a></div>", ""),
        (None, ""), ("", ""), ("no markup at all", "no markup at all"), ("<" * 2000 + "p>deep", None), ("<div>" * 3000 + "deep", "deep"),
    ]
    got = texts_of(spark, [(f"http://h{i}.example/", h) for i, (h, _) in enumerate(cases)])
    for i, (_, want) in enumerate(cases):
        if want is not None:
            assert got[i].text == want, i
        assert got[i].n_chars == len(got[i].text)


def test_html_template_of_a_host(spark):
    page = lambda i: f"<body><div><p>Read more on our site</p></div><div><h2>Title {i}</h2><p>Body of story {i} " + "word " * i + "</p></div><div><p>All rights reserved</p></div></body>"
    pages = [("http://one.example/a", page(i)) for i in range(8)] + [("http://few.example/a", page(1)), ("http://copy.example/", page(3))] + [("http://copy.example/", page(3))] * 6 + [(None, page(2))]
    got = texts_of(spark, pages)
    for i in range(8):
        assert got[i].text == " ".join(f"Title {i}\n\nBody of story {i} {'word ' * i}".split(" ")).strip()
    assert got[8].text.startswith("Read more") and got[9].text.startswith("Read more") and len(got) == len(pages)
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")
    joined = {r.page_id: r.text for r in html_extract.extract(df, set_bytes=0).collect()}
    assert joined == {i: r.text for i, r in got.items()}
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_hosts_are_the_same_in_broadcast_and_join(spark):
    """Urls that a strict parser refuses or finds no host in."""
    page = lambda i: f"<body><div><p>Read more here</p></div><div><p>Body of story {i}</p></div></body>"
    heads = ["http://my_site.example/a", "http://UP.example:80/a b|c", None, "http://[bad/x", "no url at all"]
    pages = [(u if u is None else f"{u}{i}", page(i)) for u in heads for i in range(6)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string").repartition(3)
    for more in ({}, {"set_bytes": 0}):
        got = {r.page_id: r.text for r in html_extract.extract(df, **more).collect()}
        # the last three kinds have no host: together they are one
        assert got == {i: f"Body of story {i % 6}" for i in range(len(pages))}


def test_simple_tree_matching():
    tree, reference = "body(nav,div(p),p)", "body(nav,div(h1,p),aside,p)"
    sigs, _, _ = html_extract.parse_tree(reference)
    got = html_extract.align(tree, reference)
    assert [sigs[i] if i >= 0 else None for i in got] == ["body", "nav", "div", "p", "p"] and got[-1] == len(sigs) - 1
    assert html_extract.align("body(x)", "body(y)") == [0, -1] and html_extract.align("a", "b") == [-1]


def accepts(template, text):
    import pyarrow as pa

    from tabspark.llm.common import flat
    from tabspark.llm.tokens import ALNUM, words

    s = license_scan.Scanner([("l", 1.0, template)])
    data, offsets = flat(pa.array([text], pa.large_string()))
    return sorted(x[1:] for x in s.places(data, offsets, words(data, offsets, ALNUM))[0])


def test_automata():
    t = "<<optional>>The<</optional>> Alpha License <<optional>>version <<var 1-1>> <<optional>>or later<</optional>><</optional>> holds"
    assert accepts(t, "see The ALPHA license, holds") == [(1, 5)] and accepts(t, "alpha license version 2 or later holds.") == [(0, 7)]
    assert accepts(t, "alpha license version 2 holds alpha license holds") == [(0, 5), (5, 8)]
    assert accepts(t, "alpha license version or later holds") == [] and accepts(t, "alpha public license holds") == []
    v = "granted by <<var 1-3>> to all"
    assert [accepts(v, f"granted by {' '.join('x' * n)} to all") for n in range(5)] == [[], [(0, 5)], [(0, 6)], [(0, 7)], []]
    with pytest.raises(ValueError):
        license_scan.compile_template("l", 1.0, "<<var 0-3>>")


def test_license_report(spark):
    full = license_scan.PERMISSION.replace("<<optional>>", "").replace("<</optional>>", "").replace("<<var 0-20>>", "2020 Me").replace("<<var 1-20>>", "THE AUTHORS")
    rows = [(1, "Released under the MIT License. under the mit license"), (2, full), (3, full.replace("without restriction", "with restriction")), (4, "Licensed under CC BY-NC 4.0."),
            (5, None), (6, ""), (7, "licensed under the Apache License, Version 2.0; apache license version 2"), (8, "a " * 50_000 + "cc by nc"), (8, "nothing")]
    got = license_scan.report(spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id bigint, text string, base_labels string")).collect()
    by = {(r.doc_id, r.labels): r for r in got}
    assert len(got) == len(rows)
    assert (by[1, "mit"].n_base, by[1, "mit"].first_word, by[1, "mit"].last_word) == (2, 1, 5)
    assert by[2, "mit"].score == 1.0 and by[2, "mit"].n_base == 0 and by[3, ""].score == 0.0
    assert by[4, "cc-by,cc-by-nc"].base_labels == "cc-by-nc" and by[5, ""].n_words == by[6, ""].n_words == 0
    assert by[7, "apache-2,apache-2.0"].n_base == 2 and by[8, "cc-by-nc"].first_word == 50_000 and by[5, ""].first_word is None


MODEL = sentencepiece_codec.MODEL
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="vocabulary file is not here")
TEXTS = ["Is the cat, of the", "", " ", "a", "  a  b ", "x\n\ny\t é€😀z", "ÿ" * 50, " lead", "trail ", "Größe été\nnew line 123", "w" * 3000, "tab\tand   runs     of blanks"]


@needs_model
def test_viterbi_equals_a_unigram_library():
    import sentencepiece
    from tokenizers import Tokenizer, models

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    outside = lambda i: lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)
    unigram = Tokenizer(models.Unigram([(lib.id_to_piece(i), -1e12 if outside(i) else lib.get_score(i)) for i in range(lib.get_piece_size())], 0, True))
    m = sentencepiece_codec.load()
    for text, got in zip(TEXTS, m.encode(TEXTS, {})):
        want = unigram.encode("▁" + text.replace(" ", "▁")).ids if text else []
        assert got.tolist() == want and m.decode(got, np.array([0, len(got)])) == [text] == [lib.decode(got.tolist())]


def test_double_array_finds_exactly_its_words():
    words = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zz", b"ba"]
    base, check, value = sentencepiece_codec.double_array(words, list(range(len(words))))
    for probe in [*words, b"", b"c", b"abcd", b"z", b"\xff", b"aa", b"\x00"]:
        state = 0
        for c in probe:
            child = base[state] + c + 1
            state = child if check[child] == state else -1
            if state < 0:
                break
        found = value[state] if state >= 0 else -1
        assert found == (words.index(probe) if probe in words else -1)


@needs_model
def test_codec_on_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, TEXTS[0]])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(docs))
    assert out.columns[:3] == docs.columns
    for r in out.collect():
        assert r["__decoded"] == r.text and (r["__ids"] is None) == (r.text is None)
    report = sentencepiece_codec.report(docs).collect()
    assert all(r.round_trip for r in report) and {r.n_tokens for r in report if r.doc_id in (1, 12)} == {0}
    assert sentencepiece_codec.report(docs.limit(0)).count() == 0


@needs_model
def test_pipeline_stages(spark, tmp_path):
    """Each stage on planted cases; the result holds exactly the documents that should be left."""
    r = np.random.default_rng(6)
    text = lambda n: " ".join(f"w{k}" for k in r.integers(0, 4000, n))
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        rows.append((i, text(60) + (" Slurword slurword slurword" if bad else ""), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    passage, near = text(14), text(200)
    rows += [(500, text(40) + " " + passage + " end", "en", "s", 1), (600, near, "en", "s", 1), (601, near + " more", "en", "s", 1), (602, near, "en", "s", 1), (700, None, "en", "s", 1)]
    rows += [(800 + i, text(30) + "\nOne common line\n" + text(5), "en", "s", 1) for i in range(12)]
    clash = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'x' AS n_tokens", "'x' AS decoded")
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {i for i in range(240) if i % 6} | {600, 700} | {800 + i for i in range(12)}
    assert set(out) == want and all(x.round_trip for x in out.values())
    assert [i for i in range(12) if "common line" in out[800 + i].text] == [0] and out[600].text == near  # the first document keeps the line
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    assert re.fullmatch(r"w\d+( w\d+)*", out[1].text)
