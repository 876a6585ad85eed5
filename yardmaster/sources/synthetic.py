"""A synthetic pool from hashes of row numbers: the same at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(seed: int, what: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(n))


def slots(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    cpus = F.element_at(F.array(*map(F.lit, (1, 2, 4, 8, 16))), (_pick(seed, "cpus", 5) + 1).cast("int")).cast("long")
    return spark.range(n).select(
        F.col("id").alias("ScanIndex"), F.format_string("slot1@ep%06d", "id").alias("Name"), F.format_string("<10.0.%d.%d:9618>", (F.col("id") / 250).cast("long"), F.col("id") % 250).alias("MyAddress"),
        cpus.alias("Cpus"), (cpus * 2048).alias("Memory"), cpus.cast("double").alias("SlotWeight"), F.lit("LINUX").alias("OpSys"),
        F.when(_pick(seed, "arch", 8) == 0, "aarch64").otherwise("X86_64").alias("Arch"), F.when(_pick(seed, "state", 10) < 3, "Claimed").otherwise("Unclaimed").alias("State"), (_pick(seed, "p", 4) == 0).alias("PartitionableSlot"),
    )


def requests(spark: SparkSession, n: int, submitters: int = 50, shapes: int = 8, seed: int = 1) -> DataFrame:
    shape = _pick(seed, "shape", shapes)
    return spark.range(n).select(
        F.col("id").alias("request_id"), F.format_string("user%03d@pool", _pick(seed, "user", submitters)).alias("Owner"), shape.alias("AutoClusterId"),
        (shape % 4 + 1).alias("RequestCpus"), ((shape + 1) * 512).alias("RequestMemory"), F.lit("X86_64").alias("DesiredArch"), F.lit(1).cast("long").alias("Count"),
    )
