"""A table of keyed rows that is changed by appending: deltas, merged when read, folded into a base."""

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velobus.sinks import commits


class KeyedTable:
    """Rows by key below one root; the newest delta that holds a key gives its row.

    A writer puts a delta into a folder of its own and then claims the next number for it. Two
    writers can't get the same number, and neither loses its rows: the slower one takes the next.
    compact() writes the merged table as a new base; deltas claimed meanwhile still come after it.
    Readers always see a whole state, that of the records they found.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: Sequence[str]):
        self.spark, self.schema, self.key = spark, schema, list(key)
        self.data, self.claims = f"{root.rstrip('/')}/data", f"{root.rstrip('/')}/claims"

    def _records(self) -> list[tuple[int, dict]]:
        return sorted((int(name), r) for name, r in commits.records(self.spark, self.claims).items())

    def _claim(self, record: dict) -> int:
        number = max((n for n, _ in self._records()), default=0) + 1
        while not commits.commit(self.spark, self.claims, f"{number:012d}", record):
            number += 1
        return number

    def append(self, frame: DataFrame) -> int:
        """Add rows, new or changed; of rows with one key in one frame the greatest counts."""
        part = uuid.uuid4().hex
        columns = self.spark.createDataFrame([], self.schema).columns
        frame.select(*columns).write.parquet(f"{self.data}/part={part}")
        return self._claim({"part": part, "covers": None})

    def version(self) -> int:
        """The number of the newest record, 0 for an empty table."""
        return max((n for n, _ in self._records()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest row of every key, or the table as it was at a version."""
        known = [(n, r) for n, r in self._records() if version is None or n <= version]
        base = max(((r["covers"], n, r) for n, r in known if r["covers"] is not None), default=None, key=lambda b: b[:2])
        covered = base[0] if base else 0
        live = [(n, r["part"]) for n, r in known if r["covers"] is None and n > covered]
        live += [(covered, base[2]["part"])] if base else []
        folders = [f"{self.data}/part={part}" for _, part in live]
        rows = commits.read_folders(self.spark, self.data, folders, f"{self.schema}, part STRING")
        columns = [c for c in rows.columns if c != "part"]
        if len(live) <= 1 and (base or not live):
            return rows.select(*columns)  # a base has one row per key
        order = self.spark.createDataFrame([(part, n) for n, part in live], "part STRING, _n BIGINT")
        whole = F.struct(*columns)
        newest = rows.join(F.broadcast(order), "part").groupBy(*[F.col(k).alias(f"_{k}") for k in self.key])
        return newest.agg(F.max_by(whole, F.struct("_n", whole)).alias("_row")).select("_row.*")

    def compact(self) -> int:
        """Fold everything up to now into a new base."""
        version = self.version()
        part = uuid.uuid4().hex
        self.read(version).write.parquet(f"{self.data}/part={part}")
        return self._claim({"part": part, "covers": version})
