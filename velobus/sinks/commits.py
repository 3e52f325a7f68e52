"""Commit records: small files that are created once and tell readers what counts.

A writer puts its output into a folder no one knows of and then creates one record that names it.
Whatever was written without a record, by an attempt that failed or by a second writer, is never
read. Records are claimed by creating a file that must not exist, which HDFS and local file systems
decide atomically; on an object store the file system in use has to offer the same.
"""

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text; false if it is there already."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(context._jsc.hadoopConfiguration())
    try:
        out = system.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def commit(spark: SparkSession, folder: str, name: str, record: dict) -> bool:
    """Make a record visible under its name; false if the name is taken."""
    return create_once(spark, f"{folder}/{name}.json", json.dumps(record, sort_keys=True))


def records(spark: SparkSession, folder: str) -> dict[str, dict]:
    """All records by name, one small row each. A record cut off while it was written counts as
    absent; so does a folder that was never written."""
    try:
        rows = spark.read.option("wholetext", True).text(folder).selectExpr("value", "_metadata.file_name AS name").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    found = {}
    for row in rows:
        try:
            found[row["name"].removesuffix(".json")] = json.loads(row["value"])
        except json.JSONDecodeError:
            continue
    return found


def attempt_folder(path: str, run: str, batch_id: int) -> str:
    """A folder for one attempt at one batch of one run, new at every call."""
    return f"{path}/run={run}/batch_id={batch_id}/attempt={uuid.uuid4().hex}"


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that owns a checkpoint folder; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def read_folders(spark: SparkSession, base: str, folders: Sequence[str], schema: str, kind: str = "parquet") -> DataFrame:
    """The rows of some folders below a base, empty for none."""
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).format(kind).load(list(folders))
