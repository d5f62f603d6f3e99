"""Phrase collocations by dynamic itemset counting.

The corpus is stored once as encoded pieces (a local vocabulary and a stream of word codes) dealt to ``SHARDS`` shards.
Steps visit the shards in turn, round and round.  A step counts every length that is active: words in the first round, and a
longer phrase from the step on in which both its parts (all words but the last, all but the first) have been seen
``min_count`` times.  It is then counted for one full cycle of shards, so its count is exact, whichever step it began in, and the steps end
when every active phrase has gone round.  With s shards and phrases of up to m words that takes at most m * (s - 1) + 1 steps of one
shard each: less than one pass of the corpus per length.

A piece never sees the corpus' set of active phrases.  It sends the phrases that it holds, with the place of one
occurrence, and is told the numbers of those that have become frequent; counts lie in tables bucketed by
phrase, pieces in a table bucketed by piece, so that repeated rounds shuffle only what is new.

Case A-Z is lowered.  Null texts are empty, a null language counts as ``und``.  Rows are never merged: repeated rows count repeatedly.
Texts of any length are split by bytes in whole columns; a text is never cut, so a piece holds at least one.  An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.llm.common import Bucketed, attach, flat, pieces, saved, text_column
from tabspark.llm.tokens import words

SHARDS = 2  # fewest steps in all; more shards start long phrases earlier
PIECE = 8 << 20  # text bytes of a piece
SEPARATOR = np.array([b in b".,;:!?\n\x0b\x0c\r" for b in range(256)])
WORD = ~SEPARATOR & np.array([b not in b" \t" for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
REACH = 64  # steps that fit the packed field


def _packed(a: np.ndarray | bytes) -> bytes:
    return pa.compress(a.tobytes() if isinstance(a, np.ndarray) else a, "zstd", asbytes=True)


def encoded(docs: DataFrame, shards: int, piece: int = PIECE) -> DataFrame:
    """piece, shard, languages, vocabulary (language number and word) and stream (word codes; -1 before every segment)."""

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text", piece):
            data, offsets = flat(text_column(batch, "text"))
            w, text = words(data, offsets, WORD), None
            if not len(w.start):
                continue
            text = w.text_of()
            breaks = np.concatenate([[0], np.cumsum(SEPARATOR[data], dtype=np.int64)])
            fresh = np.ones(len(w.start), bool)
            fresh[1:] = (breaks[w.start[1:]] != breaks[w.end[:-1]]) | (text[1:] != text[:-1])
            size = w.end - w.start
            ends = np.concatenate([[0], np.cumsum(size)])
            letters = LOWER[data[np.repeat(w.start - ends[:-1], size) + np.arange(ends[-1])]]
            every = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
            lang = batch.column("lang").cast(pa.string()).fill_null("und").dictionary_encode()
            width = len(every.dictionary)
            both = lang.indices.to_numpy()[text].astype(np.int64) * width + every.indices.to_numpy()
            known, code = np.unique(both, return_inverse=True)
            stream = np.full(len(code) + int(fresh.sum()), -1, np.int32)
            stream[np.arange(len(code)) + np.cumsum(fresh)] = code
            vocabulary = "\n".join(every.dictionary.take(pa.array(known % width)).to_pylist()).encode()  # no word holds a line feed
            yield pa.RecordBatch.from_pydict({
                "piece": pa.array([task << 32 | n], pa.int64()), "shard": pa.array([(task + n) % shards], pa.int32()),
                "langs": pa.array([lang.dictionary.to_pylist()], pa.list_(pa.string())), "lang_of": pa.array([_packed((known // width).astype(np.int32))], pa.binary()),
                "words": pa.array([_packed(vocabulary)], pa.binary()), "n_bytes": pa.array([len(vocabulary)], pa.int64()), "n_words": pa.array([len(known)], pa.int64()),
                "stream": pa.array([_packed(stream)], pa.binary()), "n_stream": pa.array([len(stream)], pa.int64())})
            n += 1

    return docs.select("text", "lang").mapInArrow(run, "piece bigint, shard int, langs array<string>, lang_of binary, words binary, n_bytes bigint, n_words bigint, stream binary, n_stream bigint")


def _stream(row: dict) -> np.ndarray:
    return np.frombuffer(pa.decompress(row["stream"], row["n_stream"] * 4, "zstd"), np.int32).astype(np.int64)


def _count_words(batches):
    """lang, word, piece, place (local code and count) of the words of each piece."""
    for batch in batches:
        for row in batch.to_pylist():
            stream, langs = _stream(row), pa.array(row["langs"], pa.string())
            lang_of = np.frombuffer(pa.decompress(row["lang_of"], row["n_words"] * 4, "zstd"), np.int32)
            vocabulary = pa.decompress(row["words"], row["n_bytes"], "zstd").to_pybytes().decode().split("\n")
            n = np.bincount(stream[stream >= 0], minlength=len(lang_of))
            yield pa.RecordBatch.from_pydict({
                "lang": langs.take(pa.array(lang_of)), "word": pa.array(vocabulary, pa.string()),
                "piece": pa.array(np.full(len(n), row["piece"])), "place": pa.array(np.arange(len(n)) << 32 | n)})


def local_codes(stream: np.ndarray, length: int) -> np.ndarray:
    """Per place a number of the ``length`` words from there on, equal for equal words; -1 where a segment ends before."""
    code, width = stream, int(stream.max(initial=0)) + 1
    for j in range(1, length):
        if j > 1:
            _, code = np.unique(code, return_inverse=True)
            code = code - 1 if dead.any() else code  # -1 sorts first
        dead = (code[:-1] < 0) | (stream[j:] < 0)
        code = np.where(dead, -1, code[:-1] * width + stream[j:])
    return code


def _count_phrases(length: int, step: int, shards: int):
    """left, right, piece, place of the phrases of ``length`` words that are active in a step.

    left and right are the numbers of a phrase's two parts, which the piece was told with a place where each occurs.
    """
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).drop_columns(["ids", "places"]).to_pylist()[0]
                ids, places = (batch.column(c)[i].values.to_numpy() for c in ("ids", "places"))
                code = local_codes(_stream(row), length - 1)
                at, reach = places // REACH, places % REACH
                own = at if length == 2 else code[at]  # words are told by their code itself
                order = np.argsort(own)
                own, ids, reach = own[order], ids[order], reach[order]
                found = np.minimum(np.searchsorted(own, code), len(own) - 1)
                found[own[found] != code] = -1
                left, right = found[:-1], found[1:]
                begun = np.maximum(reach[left], reach[right])
                here = np.flatnonzero((left >= 0) & (right >= 0) & (begun <= step) & (step < begun + shards))
                key, first, n = np.unique(left[here] * len(own) + right[here], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "left": pa.array(ids[key // len(own)]), "right": pa.array(ids[key % len(own)]),
                    "piece": pa.array(np.full(len(key), row["piece"])), "place": pa.array(here[first] << 32 | n)})

    return run


N = f"cast(place & {(1 << 32) - 1}L as bigint)"  # the count in a place


def _reached(table: Bucketed, known: DataFrame | None, step: int, base: int, min_count: int) -> tuple[DataFrame | None, int]:
    """All frequent phrases of a length: key, f (count so far), id, reach (the step they became frequent in); and the next free number.

    Phrases that are new are numbered on from ``base``.
    """
    total = table.read().groupBy(*table.key).agg(F.sum(F.expr(N)).alias("f")).where(F.col("f") >= min_count)
    if known is not None:
        total = total.join(known.drop("f"), table.key, "left")
    else:
        total = total.withColumns({"id": F.lit(None).cast("bigint"), "reach": F.lit(None).cast("int")})
    found = saved(total.withColumn("task", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    new = found.where("id IS NULL").agg(F.max("task").alias("task"), F.max("k").alias("k")).first()
    if new["k"] is not None:
        tasks = new["task"] + 1
        number = (F.col("k") * tasks + F.col("task") + base).cast("bigint")
        found, base = found.withColumn("id", F.coalesce("id", number)).withColumn("reach", F.coalesce("reach", F.lit(step))), base + (new["k"] + 1) * tasks
    return found.drop("task", "k"), base


def _told(table: Bucketed, reached: DataFrame, step: int, shards: int) -> DataFrame:
    """Per piece of the step's shard: the numbers of its frequent phrases, each with its place and the step it became frequent in."""
    rows = table.read().where(F.col("step") % shards == step % shards).select(*table.key, "piece", F.shiftright("place", 32).alias("at"))
    found = rows.join(reached.drop("f").hint("shuffle_hash"), table.key)  # the phrases of a bucket in memory, its rows as they come
    found = found.select("piece", "id", (F.col("at") * REACH + F.col("reach")).alias("place"))
    return found.groupBy("piece").agg(F.collect_list("id").alias("ids"), F.collect_list("place").alias("places"))


def count_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10, shards: int = SHARDS, piece: int = PIECE) -> tuple[list[DataFrame], DataFrame]:
    """Per length a table of its frequent phrases, and the number of all words per language.

    A table has id, lang, phrase, last (its last word), f, the counts of its first 1, 2, ... words (heads), of its last 1, 2, ...
    (tails), and left and right: the ids of its two parts.
    """
    if max_words * (shards - 1) + 1 > REACH or min_count < 1 or shards < 1:
        raise ValueError(f"max_words={max_words} and shards={shards} take more than {REACH} steps, or min_count={min_count} or shards is below 1")
    spark = docs.sparkSession
    store = Bucketed(spark, ["piece"], "shard")
    store.append(encoded(docs, shards, piece))
    counts = [Bucketed(spark, ["lang", "word"] if m == 1 else ["left", "right"], "step") for m in range(1, max_words + 1)]
    reached: list[DataFrame | None] = [None] * max_words
    latest, base, step = [-1] * max_words, 0, 0  # latest: the last step in which a phrase of this length became frequent
    while step < shards or any(step < latest[m - 1] + shards for m in range(1, max_words) if latest[m - 1] >= 0):
        part = store.read().where(F.col("shard") == step % shards)
        for m, table in enumerate(counts):
            if m == 0:
                if step >= shards:
                    continue
                found = part.mapInArrow(_count_words, "lang string, word string, piece bigint, place bigint")
            else:
                if latest[m - 1] < 0 or step >= latest[m - 1] + shards:
                    continue
                told = _told(counts[m - 1], reached[m - 1], step, shards)
                rows = part.select("piece", "stream", "n_stream").join(told, "piece")
                found = rows.mapInArrow(_count_phrases(m + 1, step, shards), "left bigint, right bigint, piece bigint, place bigint")
            table.append(found.withColumn("step", F.lit(step)))
            if m + 1 < max_words:  # nothing waits for the longest phrases
                reached[m], after = _reached(table, reached[m], step, base, min_count)
                if after > base:
                    latest[m], base = step, after
        step += 1
    if counts[-1].made:
        reached[-1], _ = _reached(counts[-1], None, step, base, min_count)
    sizes = saved(counts[0].read().groupBy("lang").agg(F.sum(F.expr(N)).alias("n")))
    out: list[DataFrame] = []
    for total in reached:
        if total is None:
            break
        if not out:
            full = total.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"),
                                F.lit(None).cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("right"))
        else:
            first = out[-1].select(F.col("id").alias("left"), "lang", "phrase", "heads")
            second = out[-1].select(F.col("id").alias("right"), "last", "tails")
            full = total.join(first, "left").join(second, "right").select(
                "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"), "left", "right")
        out.append(saved(full))
    for table in [store, *counts]:
        table.forget()
    return out, sizes


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, cover: int = 50, top: int = 2000, shards: int = SHARDS, piece: int = PIECE) -> DataFrame:
    """Per language the ``top`` phrases of 2 to ``max_words`` words: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the counts of the phrase and of the two parts of its lowest-scoring cut, n that of all words; the score is
    floor(10^6 * a * a / (l * r)).  A phrase goes if a longer one around it has ``cover`` percent of its count or more.
    Counts below 10^15 are exact.
    """
    levels, sizes = count_phrases(docs, max_words, min_count, shards, piece)
    parts = []
    for m in range(2, len(levels) + 1):
        cut = (f"array_min(transform(sequence(1, {m - 1}), k -> named_struct('score', (cast(1000000 as decimal(7,0)) * cast(f as decimal(15,0)) * cast(f as decimal(15,0))) div "
               f"(cast(element_at(heads, k) as decimal(18,0)) * cast(element_at(tails, {m} - k) as decimal(18,0))), 'k', k, 'l', element_at(heads, k), 'r', element_at(tails, {m} - k))))")
        part = levels[m - 1]
        if m < len(levels):
            # every phrase around this one lies around one of one more word, which is at least as frequent
            longer = levels[m].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("around")).groupBy("id").agg(F.max("around").alias("around"))
            part = part.join(longer, "id", "left").where(F.coalesce(100 * F.col("around") < cover * F.col("f"), F.lit(True)))
        parts.append(part.select("lang", "phrase", F.col("f").alias("a"), F.expr(cut).alias("cut")))
    schema = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    every = saved(reduce(DataFrame.unionByName, parts)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return attach(best, sizes, "lang", "n").select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])


def report(docs: DataFrame) -> DataFrame:
    return collocations(docs)
