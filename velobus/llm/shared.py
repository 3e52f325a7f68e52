"""What several operators need: checkpoints on the shared folder, and argument checks."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velobus.session import stored_copy, work_dir


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share."""
    return work_dir(spark, purpose)


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, written once to the shared folder and cut off from its history.

    Every later reader finds the files there, so a lost executor costs no earlier stage.
    """
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark, "checkpoints"))
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """As checkpointed(), but as Parquet: for intermediate results that may be small.

    Their size is known to the planner, and a scan packs small files into few tasks, so that the
    shuffles of a few thousand rows do not cost as many files as the session has partitions.
    """
    return stored_copy(frame, "step")


def in_written_order(frame: DataFrame, name: str) -> DataFrame:
    """A frame read from Parquet with the place of each row, from 0 in the order it was written.

    Files count by the number of the partition that wrote them; the driver sees one row per file.
    """
    frame = frame.withColumns({"_file": F.col("_metadata.file_name"), "_index": F.col("_metadata.row_index")})
    ends = frame.groupBy("_file").agg(F.max("_index").alias("last")).collect()
    number = re.compile(r"part-(\d+)")
    first, begins = 0, []
    for r in sorted(ends, key=lambda r: (int(n[1]) if (n := number.match(r["_file"])) else -1, r["_file"])):
        begins.append((r["_file"], first))
        first += r["last"] + 1
    begins = frame.sparkSession.createDataFrame(begins, "_file string, _begin long")
    return frame.join(F.broadcast(begins), "_file").withColumn(name, F.col("_begin") + F.col("_index")).drop("_file", "_begin", "_index")


def only(frame: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; whatever else the frame has is left."""
    return frame.select(*[F.col(given) if given == name else F.col(f"`{given}`").alias(name) for name, given in columns.items()])


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
