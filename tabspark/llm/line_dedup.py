"""Repeated lines across documents: two Bloom filters find the suspects, only these are counted exactly.

The first filter holds line hashes met once, the second those met again.  Builders fill both for their part
of the corpus; merging keeps ``twice | twice' | (once & once')``, so a line of two documents is always in
the second filter.  Lines outside it are unique and never leave their task.  The filters have
``min(max_bits, 12 bits a line)`` bits each: a full filter lets more lines through to the exact count and
changes no result.

Null is the text of one empty line.  Lines whose stripped key is empty always stay.  A document counts once
for a line however often it repeats it; repeated rows of a doc_id are separate documents.  Columns beside
``text`` pass through; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.llm.common import attach, pieces, saved, text_column

BLANK = b" \t\n\x0b\x0c\r"
PROBES = 4
BLOCK = 1 << 16  # bytes of a filter that travel as one row
SET_BYTES = 16 << 20  # repeated keys up to this size are broadcast; more go through joins


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes.lower changes A-Z only


def _keys(text: str) -> set[bytes]:
    found = {line_key(x) for x in text.encode().split(b"\n")}
    found.discard(b"")
    return found


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(j) * step * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size) for j in range(PROBES)])


def _has(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce((bitmap[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1, axis=0).astype(bool)


def _add(bitmap: np.ndarray, bits: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (bits >> np.uint64(3)).ravel(), np.uint8(1) << (bits & np.uint64(7)).astype(np.uint8).ravel())


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64)


def repeated_filter(docs: DataFrame, max_bits: int = 1 << 28) -> np.ndarray:
    """The second filter: every line key of two or more rows is in it (and few others)."""
    lines = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    size = BLOCK * 8
    while size < min(max_bits, 12 * lines):
        size *= 2

    def build(batches):
        once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        for batch in pieces(batches):
            hashes = [_hashes(_keys(t)) for t in text_column(batch, "text").to_pylist()]
            if not hashes:
                continue
            values, counts = np.unique(np.concatenate(hashes), return_counts=True)
            bits = _bits(values, size)
            again = (counts > 1) | _has(once, bits)
            _add(twice, bits[:, again])
            _add(once, bits[:, ~again])
            _add(once, bits[:, again])
        for i in range(0, size // 8, BLOCK):
            a, b = once[i : i + BLOCK], twice[i : i + BLOCK]
            if a.any():
                yield pa.RecordBatch.from_pydict({"block": [i // BLOCK], "once": [a.tobytes()], "twice": [b.tobytes()]})

    def merge(block: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(BLOCK, np.uint8), np.zeros(BLOCK, np.uint8)
        for a, b in zip(block["once"], block["twice"]):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            twice |= b | (once & a)
            once |= a
        return pd.DataFrame({"block": [block["block"].iloc[0]], "twice": [twice.tobytes()]})

    # few builders: each sends a whole filter, whatever the number of input splits
    parts = docs.select("text").coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(build, "block bigint, once binary, twice binary")
    out = np.zeros(size // 8, np.uint8)
    for block, data in parts.groupBy("block").applyInPandas(merge, "block bigint, twice binary").toLocalIterator():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(data, np.uint8)
    return out


def repeated_lines(docs: DataFrame, min_docs: int = 2, max_bits: int = 1 << 28, first: bool = False) -> DataFrame:
    """key (binary) and n_docs of every line key of at least ``min_docs`` rows; exact.  ``first``: also __first, the __row of its smallest doc_id."""
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs, max_bits))
    place = ["doc_id", "__row"] if first else []

    def suspects(batches):
        seen = bitmap.value
        for batch in pieces(batches):
            found = [_keys(t) for t in text_column(batch, "text").to_pylist()]
            keys = [k for x in found for k in x]
            if keys:
                hit = np.flatnonzero(_has(seen, _bits(_hashes(keys), len(seen) * 8)))
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])[hit])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in place], pa.array([keys[i] for i in hit], pa.binary())], [*place, "key"])

    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in place], T.StructField("key", T.BinaryType())])
    found = docs.select(*place, "text").mapInArrow(suspects, schema)
    more = [F.min(F.struct(*place))["__row"].alias("__first")] if first else []
    return found.groupBy("key").agg(F.count("*").alias("n_docs"), *more).where(F.col("n_docs") >= min_docs)


def _cut(texts: list[str], dropped) -> dict[str, list]:
    """dropped(i, key): whether text i loses the lines of that key."""
    out: dict[str, list] = {"text": [], "n_lines": [], "n_dropped": []}
    for i, t in enumerate(texts):
        lines = t.encode().split(b"\n")
        stay = [x for x in lines if not ((k := line_key(x)) and dropped(i, k))]
        out["text"].append(b"\n".join(stay).decode())
        out["n_lines"].append(len(lines))
        out["n_dropped"].append(len(lines) - len(stay))
    return out


def _mapped(docs: DataFrame, decide, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``text`` cut and the columns __n_lines, __n_dropped; decide(batch) gives dropped(i, key)."""
    keep = [f for f in docs.schema.fields if f.name not in drop]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in keep] + [T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])

    def run(batches):
        for batch in pieces(batches):
            new = _cut(text_column(batch, "text").to_pylist(), decide(batch))
            columns = [pa.array(new["text"], batch.schema.field("text").type) if f.name == "text" else batch.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(new["n_lines"], pa.int64()), pa.array(new["n_dropped"], pa.int64())], [*[f.name for f in keep], "__n_lines", "__n_dropped"])

    return docs.mapInArrow(run, schema)


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, max_bits: int = 1 << 28, set_bytes: int = SET_BYTES) -> DataFrame:
    """Documents without the lines that at least ``min_docs`` of them share, with __n_lines and __n_dropped.

    ``keep_first``: the document with the smallest doc_id keeps its lines of a key; others lose them.
    """
    spark = docs.sparkSession
    numbered = saved(docs.withColumn("__row", F.monotonically_increasing_id())) if keep_first else docs
    common = saved(repeated_lines(numbered, min_docs, max_bits, keep_first))
    size = common.select(F.sum(F.length("key") + 64)).first()[0] or 0
    if size <= set_bytes:
        known = spark.sparkContext.broadcast({bytes(r.key): r["__first"] if keep_first else None for r in common.toLocalIterator()})

        def listed(batch):
            keys = known.value
            if not keep_first:
                return lambda i, k: k in keys
            rows = batch.column("__row").to_pylist()
            return lambda i, k: keys.get(k, rows[i]) != rows[i]

        return _mapped(numbered, listed, drop=("__row",) if keep_first else ())
    # many keys: meet their documents in a join, then each document its list of keys
    def occurrences(batches):
        for batch in pieces(batches):
            rows = [(d, k) for d, t in zip(batch.column("__row").to_pylist(), text_column(batch, "text").to_pylist()) for k in _keys(t)]
            yield pa.RecordBatch.from_pydict({"__row": pa.array([r[0] for r in rows], pa.int64()), "key": pa.array([r[1] for r in rows], pa.binary())})

    if not keep_first:
        numbered = saved(docs.withColumn("__row", F.monotonically_increasing_id()))
    met = attach(numbered.select("__row", "text").mapInArrow(occurrences, "__row bigint, key binary"), common, "key", "n_docs").where("n_docs is not null")
    if keep_first:
        met = met.where(F.col("__row") != F.col("__first"))
    lists = met.groupBy("__row").agg(F.collect_list("key").alias("__keys"))

    def own(batch):
        keys = [frozenset(x or ()) for x in batch.column("__keys").to_pylist()]
        return lambda i, k: k in keys[i]

    return _mapped(numbered.join(lists, "__row", "left"), own, drop=("__row", "__keys"))


def line_report(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays."""
    out = drop_repeated_lines(docs.select("doc_id", "text"), min_docs)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
