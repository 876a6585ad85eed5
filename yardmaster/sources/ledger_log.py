"""Ledger logs: JSON lines of single changes, and journal text with numbered operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder

LINE = "op string, tbl int, key string, attr string, kind string, i long, f double, s string, n long"


def append_log(changes: DataFrame, path: str) -> None:
    """One JSON line a change; `n` orders them."""
    changes.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Changes; a line that isn't one is an error."""
    return spark.read.schema(LINE).option("mode", "FAILFAST").json(path)


def replayed(log: DataFrame) -> DataFrame:
    """(tbl, key, attr, value): each attribute's last value set after the record's last deletion."""
    dead = log.filter("op = 'del'").groupBy("tbl", "key").agg(F.max("n").alias("dead"))
    sets = log.filter("op = 'set'").join(dead, ["tbl", "key"], "left").filter("dead is null or n > dead")
    value = F.coalesce(F.col("i").cast("string"), F.col("f").cast("string"), F.col("s"))
    return sets.groupBy("tbl", "key", "attr").agg(F.max_by(value, "n").alias("value"))


def records(values: DataFrame, attributes: list[str], keys: tuple[str, ...] = ("tbl", "key")) -> DataFrame:
    """A row for each record, a column for each of `attributes`."""
    return values.groupBy(*keys).pivot("attr", attributes).agg(F.first("value"))


def number(value: Column, to: str) -> Column:
    """A stored number as `to`; either kind reads as the other, a real cut to an integer."""
    return value.try_cast("double").cast("long") if to == "long" else value.try_cast("double")


#: Operation numbers of the journal.
NEW, DESTROY, SET, DELETE, BEGIN, END, HISTORY = 101, 102, 103, 104, 105, 106, 107


def journal_value(text: Column) -> Column:
    """A value as the ledger keeps it: unquoted text, true and false as 1 and 0, nothing for undefined and error."""
    low = F.lower(F.trim(text))
    unquoted = F.regexp_replace(F.regexp_extract(F.trim(text), '^"(.*)"$', 1), r"\\(.)", "$1")
    return F.when(low.isin("undefined", "error"), None).when(low == "true", "1").when(low == "false", "0").when(F.trim(text).rlike('^".*"$'), unquoted).otherwise(F.trim(text))


def import_journal(lines: DataFrame) -> DataFrame:
    """Changes (op, tbl, key, attr, s, n) of journal `lines` (n, line): up to the first bad line, without
    transactions that don't end.

    Lines are ranged by their number; the control lines next to a line are found
    within its range, and across ranges in a table of one row a range.
    """
    op = F.regexp_extract("line", r"^(\d+)(?:\s|$)", 1).try_cast("int")
    parsed = lines.select("n", op.alias("o"), F.split("line", r"\s+", 4).alias("p"))
    want = F.when(F.col("o").isin(BEGIN, END), 1).when(F.col("o") == DESTROY, 2).when(F.col("o") == DELETE, 3).when(F.col("o") == SET, 4).when(F.col("o").isin(NEW, HISTORY), 2)
    checked = parsed.withColumn("bad", want.isNull() | (F.size("p") < want))
    cut = checked.agg(F.min(F.when(F.col("bad"), F.col("n"))).alias("cut")).first()[0]
    good = checked if cut is None else checked.filter(F.col("n") < cut)
    # a transaction is what lies between a begin and the next control line, if that is an end
    ranged = good.repartitionByRange("n").withColumn("part", F.spark_partition_id())
    path = shared_folder(lines.sparkSession, "journal")
    ranged.write.parquet(path)
    ranged = lines.sparkSession.read.schema(ranged.schema).parquet(path)
    control = F.when(F.col("o").isin(BEGIN, END), F.col("o"))
    before, after = Window.partitionBy("part").orderBy("n"), Window.partitionBy("part").orderBy(F.desc("n"))
    ends = ranged.filter(F.col("o").isin(BEGIN, END)).groupBy("part").agg(F.min_by("o", "n").alias("first"), F.max_by("o", "n").alias("last"))
    # a row for each range that has control lines: what stands before and after it
    across = Window.orderBy("part")
    ranges = ranged.select("part").distinct().join(ends, "part", "left")
    ranges = ranges.select("part", F.last("last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("behind"), F.first("first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("ahead"))
    placed = ranged.withColumns({"behind_": F.last(control, ignorenulls=True).over(before), "ahead_": F.last(control, ignorenulls=True).over(after)}).join(F.broadcast(ranges), "part")
    is_open = (F.coalesce("behind_", "behind") == BEGIN) & ~F.coalesce(F.coalesce("ahead_", "ahead") == END, F.lit(False))
    kept = placed.filter(~F.col("o").isin(BEGIN, END) & ~F.coalesce(is_open, F.lit(False)))
    name = F.col("p")[1]
    table = F.when(name.startswith("Customer."), 1).when(name.startswith("Resource."), 2).otherwise(0)
    key = F.regexp_replace(name, r"^(Customer|Resource)\.", "")
    kind = F.when(F.col("o") == SET, "set").when(F.col("o") == DESTROY, "del").when(F.col("o") == DELETE, "unset")
    out = kept.select(kind.alias("op"), table.alias("tbl"), key.alias("key"), F.get("p", F.lit(2)).alias("attr"), F.when(F.col("o") == SET, journal_value(F.get("p", F.lit(3)))).alias("s"), "n")
    return out.filter("op is not null and (op <> 'set' or s is not null)")


def journal_records(changes: DataFrame) -> DataFrame:
    """(tbl, key, attr, value) that stand at the journal's end."""
    dead = changes.filter("op = 'del'").groupBy("tbl", "key").agg(F.max("n").alias("dead"))
    last = changes.filter("op <> 'del'").groupBy("tbl", "key", "attr").agg(F.max_by(F.struct("op", "s"), "n").alias("x"), F.max("n").alias("n"))
    return last.join(dead, ["tbl", "key"], "left").filter("(dead is null or n > dead) and x.op = 'set'").select("tbl", "key", "attr", F.col("x.s").alias("value"))
