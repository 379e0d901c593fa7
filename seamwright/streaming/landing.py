"""Sources as a stream: files that land below a folder are parsed batch by batch, and kept as a table.

A landing folder holds one folder for each snapshot, as `landing/<snapshot>/src/a.ts`. Imports are followed within
a batch, so a snapshot should land whole (moved into place), with no limit on files a trigger that would split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files

_SIDES = {"client": files.client_calls, "server": files.server_handlers}


def stream_files(spark: SparkSession, landing: str) -> DataFrame:
    """Streaming rows snapshot, path (below the snapshot), lang, text of source files as they land; files that lie right in landing belong to no snapshot and are left out."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = files.named_files(raw.option("recursiveFileLookup", True).option("pathGlobFilter", files.SOURCES).load(landing), landing)
    return found.where(F.contains("path", F.lit("/"))).select(F.substring_index("path", "/", 1).alias("snapshot"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), "lang", "text")


def keep_parsed(spark: SparkSession, landing: str, side: str, table: str, checkpoint: str) -> StreamingQuery:
    """Parse what has landed and not been parsed yet (side: client or server) into the Parquet folder `table`, then stop.

    A batch writes its own partition and replaces it if it runs again after a failure, so that each file counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        _SIDES[side](batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream_files(spark, landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
