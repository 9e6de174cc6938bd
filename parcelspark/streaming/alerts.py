"""The alert lifecycle as a stream sink (V6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelspark.operators.state import run_alerts

ALERTS = "natural_key string, alert_type string, severity string, status string, created_at timestamp, change string"


class AlertStore:
    """Snapshots ``<folder>/v=<n>``; each run writes the next, so a run that fails leaves the last whole.

    ``apply`` serves as ``foreachBatch``: the batch id is the version, and a
    batch that is delivered again rewrites its own version from the one before.
    A version whose predecessor is missing, or whose successor is there already
    (another stream's folder), is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def snapshot(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], ALERTS)
        return self.spark.read.schema(ALERTS).parquet(f"{self.folder}/v={version}")

    def _has(self, version: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v={version}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def apply(self, candidates: DataFrame, version: int, at: str = "1970-01-01") -> None:
        if version > 0 and not self._has(version - 1):
            raise ValueError(f"no version {version - 1} in {self.folder}")
        if self._has(version + 1):
            raise ValueError(f"version {version + 1} is already in {self.folder}")
        old = self.snapshot(version - 1).drop("change")
        run_alerts(old, candidates.dropDuplicates(["natural_key"]), at).write.mode("overwrite").parquet(f"{self.folder}/v={version}")
