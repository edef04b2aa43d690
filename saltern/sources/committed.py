"""A table written in commits: rows are seen once the manifest names them, and a resumed run makes only what is missing."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommittedTable:
    """``data/part=<id>/<date>=...`` below ``path``, and a manifest with a row for each part and date.

    A commit writes its rows to a part of its own and then one small file of manifest rows. A write that is killed before
    leaves files that no reader looks at. One writer at a time; readers may read meanwhile.
    """

    def __init__(self, spark: SparkSession, path: str, date: str = "date"):
        self.spark, self.path, self.date = spark, path.rstrip("/"), date

    def manifest(self) -> DataFrame:
        """part, date, n: the committed dates and their numbers of rows."""
        try:
            return self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], f"part string, `{self.date}` date, n long")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The dates of ``wanted`` that are not committed."""
        return wanted.select(F.col(self.date).cast("date").alias(self.date)).distinct().join(self.manifest(), self.date, "left_anti")

    def commit(self, rows: DataFrame) -> int:
        """Write the rows of dates that are not committed yet and return their number; rows without a date go."""
        done = self.manifest().select(self.date).distinct()
        new = rows.where(F.col(self.date).isNotNull()).withColumn(self.date, F.col(self.date).cast("date")).join(done, self.date, "left_anti")
        part = uuid.uuid4().hex
        at = f"{self.path}/data/part={part}"
        new.repartition(self.date).write.partitionBy(self.date).parquet(at)
        written = self._read([part], new)
        counts = written.groupBy(self.date).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), self.date, "n").coalesce(1)
        counts.write.mode("append").parquet(f"{self.path}/manifest")
        return self.manifest().where(F.col("part") == part).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _read(self, parts: list[str], like: DataFrame) -> DataFrame:
        read = self.spark.read.schema(like.schema).option("basePath", f"{self.path}/data")
        return read.parquet(*[f"{self.path}/data/part={p}" for p in parts]).select(*like.columns)

    def read(self, schema: str) -> DataFrame:
        """The committed rows; ``schema`` is that of the rows that were written."""
        like = self.spark.createDataFrame([], schema)
        parts = [r["part"] for r in self.manifest().where("n > 0").select("part").distinct().collect()]  # one row a commit
        return self._read(sorted(parts), like) if parts else like


def cached(spark: SparkSession, path: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gave for these parameters: written on the first call, read on later ones.

    The name is a digest of the parameters, so a change of any builds anew. A build that fails or is killed leaves no
    entry, as the entry is written last.
    """
    said = json.dumps(params, sort_keys=True, default=str)
    key = hashlib.sha256(said.encode()).hexdigest()
    entries = f"{path.rstrip('/')}/entries"
    try:
        held = spark.read.schema("key string, params string, at string").parquet(entries).where(F.col("key") == key).orderBy("at").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = None
    if held is None:
        at = f"{path.rstrip('/')}/rows/{key}-{uuid.uuid4().hex}"
        build().write.parquet(at)
        spark.createDataFrame([(key, said, at)], "key string, params string, at string").coalesce(1).write.mode("append").parquet(entries)
        return spark.read.parquet(at)
    return spark.read.parquet(held["at"])
