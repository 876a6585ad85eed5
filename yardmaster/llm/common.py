"""What the corpus operators share: durable intermediate tables, batches, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by local sessions that name no shared folder (tests, notebooks).
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session without one gets a new folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-")
    return _own_dir[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, rows: int | None = None, each: int = 100_000) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lineage ends there.

    A lost executor then costs a re-read, not a recomputation, and what follows
    may scan the table several times. Where about how many `rows` there are is known,
    a table that `each` rows a file would make under a sixteenth of the shuffle partitions
    is dealt to so many files, after all else is done: on local disks a file costs three processes of
    its own (chmod), and in the moment one is started the executor's memory counts twice. With
    less to gain it isn't, since the dealing is a shuffle more on disk.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        files = max(spark.sparkContext.defaultParallelism, -(-rows // each))
        df = df.repartition(files) if 16 * files <= int(spark.conf.get("spark.sql.shuffle.partitions")) else df
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Keep Arrow batches small in rows and bytes, so long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def texts(batch, column: str = "text") -> list[str]:
    """The column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def utf8(batch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes, null as the empty text."""
    return [t or b"" for t in batch.column(column).cast("binary").to_pylist()]


def unused(df_columns: list[str], *names: str) -> list[str]:
    """Each name, with underscores in front until no column is called so."""
    taken, out = {c.lower() for c in df_columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def connected_components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, root) of every node of `edges` (a, b), about `rows`; root is the smallest node it reaches.

    Alternating large-star and small-star rounds: edges are rewired to the
    smallest neighbour until nothing changes. Each round is two aggregations and
    joins keyed by node, its result a written table. A round's minimum is a
    partial aggregate and the join after it has one row a node on its other side,
    so a node with very many neighbours is split by the skew join.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wired = both.join(low, "a")
        if large:  # neighbours above a are hung under the minimum
            return wired.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # edges point from a to a smaller b: a and all of these are hung under the minimum
        return wired.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))

    def clean(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    edges = stash(clean(edges.select("a", "b")), "edges", rows)
    seen = mark(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        edges = stash(clean(star(clean(star(edges, True)), False)), "edges", seen[0])
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
