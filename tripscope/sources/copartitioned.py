"""Relations stored by trip id, so that joins and groupings on it need no shuffle.

All relations are written into the same number of buckets of the trip id. A query that joins any of them on it, or groups by it, reads
matching buckets in one task each. The shuffle is paid once, when a relation is published, and not by every query again. Rows without an
id never join; they would all fall into one bucket and are kept beside it in a plain table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "trip_id"


def publish(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """Writes a relation as tables ``name`` (bucketed) and ``name_no_id``; the bucketed one."""
    has_id = df.filter(F.col(KEY).isNotNull())
    has_id.repartition(buckets, KEY).write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY).format("parquet").saveAsTable(name)
    df.filter(F.col(KEY).isNull()).write.mode("overwrite").format("parquet").saveAsTable(f"{name}_no_id")
    return df.sparkSession.table(name)


def with_id(spark: SparkSession, name: str) -> DataFrame:
    """The rows that joins on the id need."""
    return spark.table(name)


def every_row(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).unionByName(spark.table(f"{name}_no_id"))
