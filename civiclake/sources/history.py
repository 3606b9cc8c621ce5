"""A bronze history with dated snapshots: an earlier state is read from the snapshot before it and the days after that."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclake.operators.current import latest_per_key


class History:
    """Rows lie under ``root/bronze/landed=<day>`` by the day of ``stamp``; ``root/snapshots/on=<day>`` holds the newest row of
    each key as that day ended."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], stamp: str, ties: Sequence[str | Column] = ()) -> None:
        self.spark, self.root, self.keys, self.stamp, self.ties = spark, root.rstrip("/"), list(keys), stamp, list(ties)

    def append(self, df: DataFrame) -> None:
        df.withColumn("landed", F.col(self.stamp).cast("date")).write.mode("append").partitionBy("landed").parquet(f"{self.root}/bronze")

    def snapshots(self) -> list[date]:
        """Days with a complete snapshot."""
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/snapshots/on=*/_SUCCESS")
        found = done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
        return sorted(date.fromisoformat(f.getPath().getParent().getName()[3:]) for f in found or [])

    def _since(self, day: date, inclusive: bool) -> tuple[DataFrame, DataFrame | None]:
        """Bronze rows up to ``day`` that no earlier snapshot holds, and that snapshot."""
        bronze = self.spark.read.parquet(f"{self.root}/bronze").where(F.col("landed") <= F.lit(day))
        before = [s for s in self.snapshots() if s < day or inclusive and s == day]
        if not before:
            return bronze, None
        return bronze.where(F.col("landed") > F.lit(before[-1])), self.spark.read.parquet(f"{self.root}/snapshots/on={before[-1]}")

    def _state(self, later: DataFrame, snapshot: DataFrame | None) -> DataFrame:
        rows = later.drop("landed")
        return latest_per_key(rows if snapshot is None else snapshot.unionByName(rows, allowMissingColumns=True), self.keys, [self.stamp], self.ties)

    def snapshot(self, day: date) -> None:
        """Writes the state at the end of ``day``, from the snapshot before it and the days since."""
        self._state(*self._since(day, inclusive=False)).write.mode("overwrite").parquet(f"{self.root}/snapshots/on={day}")

    def as_of(self, moment: datetime) -> DataFrame:
        """The newest row of each key stamped up to ``moment``. Days before the snapshot and after the moment are not opened."""
        later, snapshot = self._since(moment.date(), inclusive=False)
        return self._state(later.where(F.col(self.stamp) <= F.lit(moment)), snapshot)
