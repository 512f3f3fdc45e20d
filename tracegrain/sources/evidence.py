"""Evidence files: their hashes, and their lines, whatever their names say about compression."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of compressed files.
MAGIC = {"gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00"}
_OPEN = {"gzip": lambda b: gzip.GzipFile(fileobj=b), "bzip2": bz2.BZ2File, "xz": lzma.LZMAFile}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, sha256, md5, compression) of every file below path that isn't empty."""
    out = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lit(None).cast("string")
    for k, magic in MAGIC.items():
        kind = F.when(F.hex(F.substring("content", 1, len(magic))) == magic.hex().upper(), k).otherwise(kind)
    return out.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), kind.alias("compression"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, line): bytes that are no UTF-8 become U+FFFD; a corrupt archive ends where it breaks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                kind = next((k for k, m in MAGIC.items() if data.startswith(m)), None)
                stream, got, n = (_OPEN[kind](io.BytesIO(data)) if kind else io.BytesIO(data)), [], 0
                try:
                    for line in stream:
                        got.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                        if len(got) == 10_000:
                            yield _rows(name, n, got)
                            n, got = n + len(got), []
                except (OSError, EOFError, lzma.LZMAError):
                    pass
                if got:
                    yield _rows(name, n, got)

    out = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return out.mapInArrow(read, "path string, line_number int, line string")


def _rows(name: str, n: int, got: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(got)), pa.array(range(n + 1, n + 1 + len(got)), pa.int32()), pa.array(got)], ["path", "line_number", "line"])


def rotation(name):
    """Of a file name column: (base, index), of base.1.gz, base-20240101 and the like."""
    m = lambda g: F.regexp_extract(name, r"^(.+?)[.-](\d{1,3}|\d{8})(?:\.(?:gz|bz2|xz))?$", g)
    plain = F.regexp_replace(name, r"\.(gz|bz2|xz)$", "")
    return F.struct(F.when(m(1) != "", m(1)).otherwise(plain).alias("base"), F.when(m(2) != "", m(2).cast("int")).otherwise(F.when(plain != name, 0)).alias("index"))


def digest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(digest, n_rows): a SHA-256 that stands for the set of rows, whatever their order.

    Each row's SHA-256 (of key, tab, value) is cut into six numbers, 48 bits each and the last 16; these are summed by the first byte of the
    key's SHA-256, and the parts' sums and counts are digested in the parts' order. Nothing is gathered but the parts.
    """
    key, value = F.col(key).cast("string"), F.col(value).cast("string")
    part = rows.select(F.sha2(key, 256).substr(1, 2).alias("p"), F.sha2(F.concat_ws("\t", key, value), 256).alias("d"))
    numbers = [F.sum(F.conv(F.substring("d", at, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{at}") for at in range(1, 65, 12)]
    by_part = part.groupBy("p").agg(*numbers, F.count(F.lit(1)).alias("n"))
    line = F.concat_ws(":", "p", *(F.col(f"s{at}").cast("string") for at in range(1, 65, 12)), F.col("n").cast("string"))
    return by_part.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ","), 256).alias("digest"), F.sum("n").alias("n_rows"))


def verify(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(path, outcome): ok, modified, missing or new, by the files' hashes."""
    a, b = recorded.select("path", F.col("sha256").alias("was")), current.select("path", F.col("sha256").alias("now"))
    outcome = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("was") == F.col("now"), "ok").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", outcome.alias("outcome"))
