"""Continuous indexing: a file stream feeds the incremental index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources.files import relative_path

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of files as they appear."""
    raw = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(root)
    return raw.select(relative_path(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("content"))


def index_stream(engine: Engine, files: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Index each micro-batch. A batch that is run again finds its hashes stored and is skipped, so the index is updated once."""

    def step(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            engine.index(batch)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
