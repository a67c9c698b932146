"""State as plain Parquet partitioned by key bucket, and an append-only audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripscope.session import ensure_checkpoint_dir


def merged(stored: DataFrame, fresh: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """Stored rows with the fresh ones put over them by key. A fresh row replaces the whole stored row.

    With a ``version`` column, a fresh row older than the stored one is late and changes nothing; a null version is the oldest.
    """
    cols = stored.columns
    new = fresh.select(F.col(key), F.struct(*[c for c in cols if c != key]).alias("__new"))
    both = stored.select(F.col(key), F.struct(*[c for c in cols if c != key]).alias("__old")).join(new, key, "full_outer")
    newer = F.coalesce("__new", "__old")
    if version is not None:
        late = F.col("__old").isNotNull() & F.coalesce(F.col(f"__old.{version}") > F.col(f"__new.{version}"), F.col(f"__new.{version}").isNull() & F.col(f"__old.{version}").isNotNull())
        newer = F.when(late, F.col("__old")).otherwise(newer)
    return both.select(key, newer.alias("__row")).select(key, "__row.*").select(*cols)


#: Key buckets of a state table; an upsert rewrites those that its keys fall into.
BUCKETS = 64


def upsert(fresh: DataFrame, path: str, key: str, version: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Puts rows over those of the same key in a Parquet table partitioned by key bucket; the buckets that were rewritten.

    Only buckets that the fresh keys fall into are read and overwritten. A put that was cut short is put again: it leads to the same table,
    whatever part of it had been done.
    """
    spark = fresh.sparkSession
    ensure_checkpoint_dir(spark)
    # Of rows with one key the newest counts, without versions the greatest.
    rest = [c for c in fresh.columns if c != key]
    placed = latest_per_key(fresh, key, version) if version else fresh.groupBy(key).agg(F.max(F.struct(*rest)).alias("__row")).select(key, "__row.*")
    placed = placed.select(*fresh.columns).withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).checkpoint()
    touched = sorted(r["key_bucket"] for r in placed.select("key_bucket").distinct().collect())
    if not touched:
        return []
    rows = placed
    if _exists(spark, path):
        stored = spark.read.parquet(path).filter(F.col("key_bucket").isin(touched)).select(*placed.columns)
        # Checkpointed, since the files it reads are about to be replaced.
        rows = merged(stored, placed, key, version).checkpoint()
    rows.repartition("key_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_bucket").parquet(path)
    return touched


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as it stands, or None before the first put."""
    return spark.read.parquet(path).drop("key_bucket") if _exists(spark, path) else None


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


AUDIT_SCHEMA = "seq bigint, run_id string, stage string, at string, detail string"


def append_audit(entries: DataFrame, path: str) -> None:
    """Adds audit entries; earlier ones are never rewritten."""
    entries.select("seq", "run_id", "stage", "at", "detail").write.mode("append").json(path)


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def audit_for_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path).filter(F.col("run_id") == run_id)


def audit_tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The latest ``n`` entries."""
    return spark.read.schema(AUDIT_SCHEMA).json(path).orderBy(F.col("at").desc(), F.col("seq").desc()).limit(n)


def latest_per_key(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key: what a batch of repeated puts comes down to."""
    cols = [c for c in rows.columns if c != key]
    known = F.struct(F.col(version).isNotNull(), F.col(version))  # rows without a version come last, but are not lost
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), known).alias("__row")).select(key, "__row.*")
