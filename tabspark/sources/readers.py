"""Tables from files: delimited text, Parquet, JSON documents, and tidying after load."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.columns import aggregate_once, as_list, col, nan_to_null

# array-valued keys looked for in a response object, in this order (fixed values)
RECORD_KEYS = ("data", "results", "items", "rows", "records", "content")


def load_csv(spark: SparkSession, path: str | list[str], delimiter: str = ",", encoding: str = "utf-8",
             schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Delimited text with a header.  Pass ``schema`` for large inputs: inference is one more scan."""
    reader = spark.read.options(**{"header": True, "sep": delimiter, "encoding": encoding, **options})
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def load_parquet(spark: SparkSession, path: str | list[str], columns: str | list[str] | None = None,
                 where: Column | str | None = None) -> DataFrame:
    """Parquet with column pruning; ``where`` is applied below the NaN clean-up so that it reaches the scan."""
    df = spark.read.parquet(*as_list(path))
    if where is not None:
        df = df.filter(where)
    if columns is not None:
        df = df.select(*[col(c) for c in as_list(columns)])
    return nan_to_null(df)


def load_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return nan_to_null((reader.schema(schema) if schema is not None else reader).json(path))


def _tsv(spark: SparkSession, path, **options) -> DataFrame:
    return load_csv(spark, path, **{"delimiter": "\t", **options})


READERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": load_csv,
    ".tsv": _tsv,
    ".txt": load_csv,
    ".parquet": load_parquet,
    ".pq": load_parquet,
    ".json": load_json,
    ".jsonl": load_json,
}


def load_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pick the reader by suffix; globs work, and so do directories named with a suffix."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported file type {suffix!r} of {path}; supported: {sorted(READERS)}")
    return READERS[suffix](spark, path, **options)


def custom_load(spark: SparkSession, fn: Callable[[SparkSession], DataFrame]) -> DataFrame:
    return _must_be_table(fn(spark), fn)


def custom_clean(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return _must_be_table(fn(df), fn)


def _must_be_table(out, fn) -> DataFrame:
    if not isinstance(out, DataFrame):
        raise TypeError(f"{getattr(fn, '__name__', fn)} must return a Spark DataFrame, got {type(out).__name__}")
    return out


def tidy_on_load(df: DataFrame) -> DataFrame:
    """Drop all-null rows, then all-null columns and, with more than one row, constant columns.

    A column is constant when min = max, which one scan without a shuffle can tell.
    """
    df = nan_to_null(df).dropna(how="all")
    comparable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    facts = aggregate_once(df, {
        ("rows", ""): F.count(F.lit(1)),
        **{("n", c): F.count(col(c)) for c in df.columns},
        **{("same", c): F.min(col(c)).eqNullSafe(F.max(col(c))) for c in comparable},
    })
    many = facts["rows", ""] > 1
    keep = [c for c in df.columns if facts["n", c] > 0 and not (many and facts.get(("same", c), False))]
    return df.select(*[col(c) for c in keep])


def load_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and columns before and after tidying."""
    left = before.agg(F.count(F.lit(1)).alias("rows_before"))
    right = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return left.join(right).select(  # one row on each side
        "rows_before", "rows_after",
        F.lit(len(before.columns)).cast("long").alias("columns_before"),
        F.lit(len(after.columns)).cast("long").alias("columns_after"),
        F.array_sort(F.array(*[F.lit(c) for c in before.columns if c not in after.columns]).cast("array<string>")).alias("dropped"),
    )


def json_records(df: DataFrame, payload: str, schema: T.StructType | str, keep: list[str] | None = None) -> DataFrame:
    """Response documents (one JSON text per row) to record rows of ``schema``.

    A top-level list gives its elements; an object gives the first list found under RECORD_KEYS, or
    else itself as one record.  A scalar document is an error.
    """
    record = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<")[:-1]
    kept = [col(k) for k in keep or []]
    listing = _listings(df, payload, kept)
    return listing.select(*kept, F.inline(F.from_json("__list", f"array<struct<{record}>>")))


def _listings(df: DataFrame, payload: str, kept: list[Column]) -> DataFrame:
    """Documents with ``__list``, the JSON list of their records; each text is parsed once."""
    parsed = df.filter(col(payload).isNotNull()).select(*kept, col(payload).alias("__text"), F.try_parse_json(col(payload)).alias("__doc"))

    def inner(path):
        return F.try_variant_get("__doc", path, "variant")

    def is_list(value):
        return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))

    found = F.when(is_list(F.col("__doc")), F.to_json("__doc"))
    for k in RECORD_KEYS:
        found = found.when(is_list(inner(f"$.{k}")), F.to_json(inner(f"$.{k}")))
    found = found.when(F.schema_of_variant("__doc").startswith("OBJECT"), F.concat(F.lit("["), F.to_json("__doc"), F.lit("]")))
    problem = F.raise_error(F.concat(F.lit("JSON document is malformed, or neither a list nor an object: "), F.substring("__text", 1, 80))).cast("string")
    return parsed.select(*kept, found.otherwise(problem).alias("__list"))


def infer_record_schema(df: DataFrame, payload: str) -> str:
    """Record schema over all documents, inferred on the cluster; mixed types are read as text."""
    elements = _listings(df, payload, []).select(F.explode(F.from_json("__list", "array<variant>")).alias("v"))
    found = elements.agg(F.schema_of_variant_agg("v")).first()[0]
    if not found.startswith("OBJECT<"):
        raise ValueError(f"records are not objects of known fields but {found}")
    found = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", found)
    found = re.sub(r"\b(?:VOID|VARIANT)\b", "STRING", found).replace("OBJECT<>", "STRING").replace("OBJECT<", "STRUCT<")
    return found[len("STRUCT<") : -1]


def load_json_responses(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Landed response files, one document per file, to record rows."""
    documents = spark.read.text(path, wholetext=True)
    return json_records(documents, "value", schema or infer_record_schema(documents, "value"))


# digest functions by algorithm name (fixed values)
_DIGESTS = {
    "sha256": lambda c: F.sha2(c, 256),
    "md5": F.md5,
    "sha1": F.sha1,
}


WHOLE_BYTES = 64 << 20  # larger files are not held as one value
LOCAL = "file:/"  # files that executors open by themselves
PIECE = 4 << 20
PACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst")  # Spark's text reader would unpack these
BOM = b"\xef\xbb\xbf"  # left out by the text reader at the start of a file


def content_hash(spark: SparkSession, path: str, algorithm: str = "sha256", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, algorithm, hash, size_bytes) per file; files are hashed in parallel, one row each.

    Local files are read by the task of each as a stream, of which it holds ``PIECE`` bytes.  Of other file systems, files up to
    ``whole_bytes`` are one value; larger ones are read in pieces by many tasks and then pass, in order, through one task that holds a
    piece at a time: a digest has no parts that could be worked out side by side.  (Larger files with the suffix of a packed one stay
    one value there, up to 2 GB.)
    """
    if algorithm not in _DIGESTS:
        raise ValueError(f"unsupported hash algorithm {algorithm!r}; supported: {sorted(_DIGESTS)}")
    files = spark.read.format("binaryFile").load(path)
    local = F.col("path").startswith(LOCAL)
    found = _local_hash(files.filter(local), algorithm)
    remote = files.filter(~local)
    if remote.select("path").isEmpty():
        return found
    found = found.unionByName(_whole_hash(remote.filter(F.col("length") <= whole_bytes), algorithm))
    for r in remote.filter(F.col("length") > whole_bytes).select("path", "length").collect():  # files over 64 MB
        one = re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"])
        packed = one.lower().endswith(PACKED)
        found = found.unionByName(_whole_hash(spark.read.format("binaryFile").load(one), algorithm) if packed else _streamed_hash(spark, one, r["path"], r["length"], algorithm))
    return found


def _local_hash(files: DataFrame, algorithm: str) -> DataFrame:
    def run(batches):
        piece = memoryview(bytearray(PIECE))
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                h, size = hashlib.new(algorithm), 0
                with open("/" + path[len("file:"):].lstrip("/"), "rb", buffering=0) as f:
                    while n := f.readinto(piece):
                        h.update(piece[:n])
                        size += n
                if size != length:
                    raise ValueError(f"{path}: {size} of {length} bytes were read")
                yield pa.RecordBatch.from_pydict({"path": [path], "algorithm": [algorithm], "hash": [h.hexdigest()], "size_bytes": [length]})

    return files.select("path", "length").mapInArrow(run, "path string, algorithm string, hash string, size_bytes bigint")


def _whole_hash(files: DataFrame, algorithm: str) -> DataFrame:
    return files.select("path", F.lit(algorithm).alias("algorithm"), digest(F.col("content"), algorithm).alias("hash"), F.col("length").alias("size_bytes"))


def _streamed_hash(spark: SparkSession, pattern: str, path: str, length: int, algorithm: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(pattern)
    lines = lines.select(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))

    def run(batches):
        plain, marked, size = hashlib.new(algorithm), hashlib.new(algorithm, BOM), -1
        for batch in batches:
            data = (b"\n" if size >= 0 else b"") + b"\n".join(batch.column("value").to_pylist()) if batch.num_rows else b""
            for h in (plain, marked):
                h.update(data)
            size += len(data) + (size < 0 and batch.num_rows > 0)
        left = length - size
        if left not in (0, 1, len(BOM), len(BOM) + 1):
            raise ValueError(f"{path}: {size} of {length} bytes were read")
        chosen = marked if left >= len(BOM) else plain
        if left % len(BOM):  # the last line has an end
            chosen.update(b"\n")
        yield pa.RecordBatch.from_pydict({"path": [path], "algorithm": [algorithm], "hash": [chosen.hexdigest()], "size_bytes": [length]})

    return lines.repartition(1).sortWithinPartitions("start", "at").select("value").mapInArrow(run, "path string, algorithm string, hash string, size_bytes bigint")


def digest(value: Column, algorithm: str) -> Column:
    if algorithm not in _DIGESTS:
        raise ValueError(f"unsupported hash algorithm {algorithm!r}; supported: {sorted(_DIGESTS)}")
    return _DIGESTS[algorithm](value)
