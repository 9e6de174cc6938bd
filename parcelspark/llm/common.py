"""Small helpers that the operators of this package share."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch handed to Python.  Texts can be long
#: (megabytes), so the default of 10,000 rows is too many for a bounded worker.
ARROW_ROWS = 256
ARROW_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session; call before building a Python stage.

    Spark reads these settings when a plan runs, not when it is built, and has no
    setting for a single stage; so they stay set.  Results do not depend on them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor can reach.

    The setting is read from the session.  Where it is unset, a local master gets
    a temporary folder; on a cluster that is an error, as executors would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


_MADE: list[str] = []


def mark() -> int:
    """To be handed to ``release``."""
    return len(_MADE)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete what was written to folders of ``shared_dir`` since ``mark``, but for the last ``keep`` of them.

    Only for tables that no later action reads: a DataFrame that is still to be
    computed needs its own.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    end = len(_MADE) - keep
    for path in _MADE[since:end]:
        at = hadoop.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del _MADE[since:end]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage with files that outlive any executor, and keeps column
    types.  Used where a costly stage feeds several consumers.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """``mapInArrow`` over ``columns`` only, one call of ``make()`` per task.

    ``make()`` returns a function from the columns (each a Python list) to a
    dict of output columns.  Anything costly that it loads is loaded once a
    task; rows arrive in small batches, so memory does not grow with a partition.
    """
    small_batches(df.sparkSession)
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def bytes_of(column) -> F.Column:
    """UTF-8 length of a text column; null counts as empty."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public tokenizer file; ``folder`` overrides the installed one."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: A key is hot if it is on more than one of this many rows, so at most this many keys are.
HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, merge: bool = False) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row for each ``key``; ``weight``: its rows), null where it has none.

    Hot keys are broadcast: at most ``HOT``, whatever the size of the tables.  The
    others join as the planner decides from the size of ``table``; where it
    shuffles, rows of hot keys and of null keys, which match nothing there, are
    dealt out by a second key, so no key takes more than its share of a task.
    With ``merge`` they join by sorting at every size, so work grows evenly.
    """
    values = [c for c in table.columns if c not in (key, weight)]
    mine = {c: f"__{uuid.uuid4().hex}" for c in ("hot", "key", "deal", "salt", *values)}
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) * HOT > total).select(F.col(key).alias(mine["hot"]), *[F.col(c).alias(f"{mine[c]}h") for c in values])
    rest = table.where(F.col(weight) * HOT <= total).select(F.col(key).alias(mine["key"]), F.lit(0).alias(mine["salt"]), *[F.col(c).alias(f"{mine[c]}r") for c in values])
    out = rows.join(F.broadcast(hot), F.col(key) == F.col(mine["hot"]), "left")
    rest = rest.hint("merge") if merge else rest
    spread = 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))
    out = out.withColumn(mine["deal"], F.when(F.col(mine["hot"]).isNotNull() | F.col(key).isNull(), spread).otherwise(0).cast("int"))
    out = out.join(rest, (F.col(key) == F.col(mine["key"])) & (F.col(mine["deal"]) == F.col(mine["salt"])), "left")
    return out.select(*rows.columns, *[F.coalesce(f"{mine[c]}h", f"{mine[c]}r").alias(c) for c in values])


#: Bitmaps of 32,768 bits that ``maybe_in`` sends to each task: 8 MB.
BITMAPS = 2048


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame, flag: str | None = None) -> DataFrame:
    """``rows`` without most of those whose ``key`` (a hash, long) is not in the one column of ``wanted``.

    A filter before a shuffle: one bit for each hash modulo ``BITMAPS * 32768``,
    broadcast.  Its size does not depend on the data; with more keys than bits it
    only lets more rows pass.  With ``flag`` all rows stay, and it says which pass.
    """
    bucket, bits, place = (f"__{uuid.uuid4().hex}" for _ in range(3))
    spread = F.pmod(F.xxhash64(key), F.lit(BITMAPS * 32768))
    keys = wanted.toDF(key).select(F.floor(spread / 32768).cast("int").alias(bucket), F.pmod(spread, F.lit(32768)).alias(place))
    maps = cut(keys.groupBy(bucket).agg(F.bitmap_construct_agg(place).alias(bits)))
    marked = rows.withColumn(bucket, F.floor(spread / 32768).cast("int")).join(F.broadcast(maps), bucket, "left" if flag else "inner")
    at = F.pmod(spread, F.lit(32768)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, at % 8) == 1
    return marked.select(*rows.columns, F.coalesce(found, F.lit(False)).alias(flag)) if flag else marked.where(found).select(*rows.columns)


def without(docs: DataFrame, key: F.Column, bad: DataFrame, anti: bool = True) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in the one column of ``bad`` (or is, with ``anti=False``).

    ``bad`` has a row for each such row of ``docs``, so that keys of many rows are
    known (``lookup``).  Columns stay as they are, whatever their names.
    """
    name, rows, flag = (f"__{uuid.uuid4().hex}" for _ in range(3))
    found = cut(bad.toDF(name).groupBy(name).agg(F.count("*").alias(rows)).withColumn(flag, F.lit(True)))
    marked = lookup(docs.withColumn(name, key), found, name, rows)
    return marked.where(F.col(flag).isNull() if anti else F.col(flag)).select(*docs.columns)
