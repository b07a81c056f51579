"""Helpers shared by the training-data operators: words, row keys, durable cuts."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, over lower-cased UTF-8 bytes: every byte of a non-ASCII character is at least 0x80, so
#: bytes and code points give the same words.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z (``bytes.lower`` touches ASCII only)."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """Texts of an Arrow string column as bytes, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is made only for a local master."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodeseek-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut", by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder (a folder a value of `by`) and read it again: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a cut that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame, n_rows: int, most: int = 50_000) -> DataFrame:
    """Mark df for broadcast if its counted rows are few enough; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if n_rows <= most else df


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 256):
                yield step(batch.slice(at, 256))

    return df.mapInArrow(run, schema)


def fraction_of(column: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the value and the salt alone: 52 bits of MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(column.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def blocks(total_bytes: int, bound: int) -> int:
    return max(1, math.ceil(total_bytes / bound))


def match_spans(text: Column, pattern: str | Column, group: int | None = None, some: bool = False) -> Column:
    """Matches of a Java regex (a text, or a column of them) as array<struct<s, e, m>>: code points, end exclusive, leftmost and non-overlapping.

    Spark has no function for match positions; the pieces between matches and the matches themselves give
    them as running lengths. m is the given group (the whole match by default). No match may be empty. With some=True most texts are
    expected to match, and none is looked at first.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = hits if group is None else F.regexp_extract_all(text, pattern, F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    rows = F.arrays_zip(gaps.alias("g"), F.transform(hits, lambda x: F.length(x)).alias("n"), groups.alias("m"))
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    found = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.coalesce(x["n"], F.lit(0))).alias("at"),
            F.when(x["n"].isNull(), acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["n"]).alias("e"), x["m"].alias("m")))))
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return found if some else F.when(F.regexp_like(text, pattern), found).otherwise(none)


def spans_text(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of array<struct<s, k, e>> (k: index of kinds), sorted by start, then k, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat(F.element_at(names, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def kinded(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
