"""Writers: CSV exports, appended logs, and snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the rent-roll export, in order (K3).
RENT_ROLL = ("lease_id", "filename", "tenant", "landlord", "property_address", "rent", "sqft", "psf", "cam", "deposit", "escalation_pct", "start_date", "end_date", "months_left", "renewal_options", "termination_options", "notice_days", "is_rent_roll")


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; on a local master a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in a scratch folder, for what is costly and read more than once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_files(lines: DataFrame, path: str) -> None:
    """One text file for each ``name``, its ``line`` values in the order of ``place``."""
    lines.repartition("name").sortWithinPartitions("name", "place").select("name", "line").write.partitionBy("name").text(path)


def months_left(as_of: str) -> F.Column:
    """Calendar months to the end, one less where its day comes earlier; NULL without an end."""
    today, end = F.lit(as_of).cast("date"), F.col("end_date")
    return (F.year(end) - F.year(today)) * 12 + F.month(end) - F.month(today) - (F.dayofmonth(end) < F.dayofmonth(today)).cast("int")


def rent_roll(leases: DataFrame, as_of: str) -> DataFrame:
    """The export's rows; two decimals for money per foot."""
    return leases.withColumn("months_left", months_left(as_of)).withColumn("psf", F.round("psf", 2)).select(*RENT_ROLL)


def rent_roll_totals(leases: DataFrame) -> DataFrame:
    """Totals under the export (A26): area, rent, and rent per foot over leases that have both."""
    both = F.col("rent").isNotNull() & (F.col("sqft") > 0)
    per = F.try_divide(F.sum(F.when(both, F.col("rent"))).cast("double"), F.sum(F.when(both, F.col("sqft"))))
    return leases.groupBy("team_id").agg(F.count("*").alias("leases"), F.sum("sqft").alias("total_sqft"), F.sum("rent").cast("double").alias("total_rent"), F.round(per, 2).alias("weighted_psf"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One folder of CSV parts with headers; NULL is an empty cell (K3, K10).  Parts stay as the data is dealt."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log partitioned by day."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)
