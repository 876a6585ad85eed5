"""Corpus cleaning in five stages, each written as Parquet and read by the next.

A stage takes what its predecessor kept and returns the columns of documents; the
last returns packed pieces. Rows without doc_id pass the stages that decide by
doc_id. Other columns than doc_id and text, n_chars apart, pass unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yardmaster.llm import lines, packing, quality, simhash, winnowing
from yardmaster.llm.common import stash, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more)."""
    (score,) = unused(docs.columns, "score")
    context, net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs, context, net, score).filter(F.col(score) >= 0.3).select(docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs, and of single lines of five words or more, are cut; documents of
    which nothing is left go."""
    n_lines, n_removed = unused(docs.columns, "n_lines", "n_removed")
    cut = lines.without_repeated_lines(docs, n_lines=n_lines, n_removed=n_removed, alone=5)
    left = cut.filter((F.col(n_removed) == 0) | (F.col("text") != ""))
    length = {"n_chars": F.when(F.col(n_removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return left.withColumns(length).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id. SimHash fingerprints link; a comparison
    of the sets of five-word shingles (similarity of 0.8 or more) follows and links what they miss."""
    groups = simhash.near_copies(docs)
    (first,) = unused(docs.columns, "first")
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi")
    copy = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    rows = rows.withColumn(first, copy).filter(F.col(first) == 1).select(docs.columns)
    return rows.unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    (th,) = unused(docs.columns, "th")
    own = docs.withColumn(th, F.xxhash64("text"))
    hits = winnowing.hits_of(own.select("doc_id", F.col(th).alias("th"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = hits.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"))
    return own.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col(th) == F.col("hit_th")), "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents packed in sequences of 4096 tokens along the curve."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages learn, hash and pack by library: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
