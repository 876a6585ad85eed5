"""Ads as text: one `Attribute = value` a line, blank lines between ads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.names import PRIVATE, ad_key

LINE = r"^\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.*?)\s*$"


def read_ad_text(spark: SparkSession, path: str) -> DataFrame:
    """A row (text) for each block of a file of ads."""
    return spark.read.option("lineSep", "\n\n").text(path).select(F.trim("value").alias("text")).filter("text != ''")


def attributes(text: Column) -> Column:
    """map<lower-case name, value text>; the first of repeated names counts."""
    line = lambda x: F.struct(F.lower(F.regexp_extract(x, LINE, 1)).alias("k"), F.regexp_extract(x, LINE, 2).alias("v"))
    pairs = F.filter(F.transform(F.split(text, r"\r?\n"), line), lambda p: p["k"] != "")
    # transform over the one list names it: what it holds is parsed once, however often it is looked at
    return F.transform(F.array(pairs), _first_of_each)[0]


def _first_of_each(pairs: Column) -> Column:
    keys = F.array_distinct(pairs["k"])
    first = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(pairs["v"], F.array_position(pairs["k"], k).cast("int"))))
    return F.when(F.size(keys) == F.size(pairs), F.map_from_entries(pairs)).otherwise(first)


def with_attributes(ads: DataFrame, text: str = "text", out: str = "attrs") -> DataFrame:
    """`ads` with a column of `attributes`. The explode of one element keeps it a column: else each look at it in
    a filter or projection would parse the text again. Small files are read by few tasks, so rows are dealt first."""
    return ads.repartition(ads.sparkSession.sparkContext.defaultParallelism).select("*", F.explode(F.array(attributes(F.col(text)))).alias(out))


def text_value(attrs: Column, name: str) -> Column:
    """A string attribute without its quotes; null if absent."""
    raw = F.try_element_at(attrs, F.lit(name.lower()))
    return F.when(raw.rlike('^".*"$'), F.regexp_replace(F.substr(raw, F.lit(2), F.length(raw) - 2), r"\\(.)", "$1")).otherwise(raw)


def integer_in_text(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?im)^\s*{name}\s*=\s*(-?\d+)\s*$", 1).try_cast("long")


def name_in_text(text: Column) -> Column:
    """The first Name line's value, case counting, blanks before it or not; quotes trimmed."""
    return F.regexp_replace(F.regexp_extract(text, r"(?m)^[^\S\n]*Name[^\S\n]*=[^\S\n]*(.*?)\s*$", 1), '^"|"$', "")


def key_in_text(text: Column, table: str) -> Column:
    """The ad's key, from the few lines of its text that make it; the first of repeated ones counts."""

    def get(name: str) -> Column:
        raw = F.regexp_extract(text, rf"(?im)^[^\S\n]*{name}[^\S\n]*=[^\S\n]*(.*?)\s*$", 1)
        return F.regexp_replace(raw, '^"(.*)"$', "$1")

    return ad_key(table, get)


def stamped(text: Column, now: int) -> Column:
    return F.concat(F.rtrim(text), F.lit(f"\nLastHeardFrom = {now}\n"))


def copied_lines(text: Column, *names: str) -> Column:
    """The first line of each named attribute, as it stands."""
    lines = F.split(text, r"\r?\n")
    named = lambda n: F.filter(lines, lambda x: F.lower(F.regexp_extract(x, LINE, 1)) == n.lower())
    picked = [F.get(named(n), F.lit(0)) for n in names]
    return F.array_join(F.array_compact(F.array(*picked)), "\n")


def sanitized(text: Column, most: int = 8192) -> Column:
    """For logs: private values hidden, long text cut with a mark."""
    secret = "|".join([*PRIVATE, *([rf"{re.escape(names.PRIVATE_PREFIX)}\w*"] if names.PRIVATE_PREFIX else [])])
    hidden = F.regexp_replace(text, rf"(?im)^(\s*(?:{secret})\s*=).*$", '$1 "<redacted>"')
    return F.when(F.length(hidden) > most, F.concat(F.substr(hidden, F.lit(1), F.lit(most)), F.lit("...(truncated)"))).otherwise(hidden)


def written(df: DataFrame, columns: list[str] | None = None) -> Column:
    """An ad's text from a row's columns that aren't null."""
    kinds = dict(df.dtypes)

    def value(c: str) -> Column:
        return F.concat(F.lit('"'), F.regexp_replace(F.col(c), r'([\\"])', r"\\$1"), F.lit('"')) if kinds[c] == "string" else F.col(c).cast("string")

    return F.concat_ws("\n", *(F.concat(F.lit(f"{c} = "), value(c)) for c in columns or df.columns))


def parsed_updates(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good ads (text, attrs, name) and bad texts: those without a name. A bad ad doesn't stop the others."""
    ads = with_attributes(raw.select("text"))
    ads = ads.withColumn("name", F.coalesce(F.nullif(text_value(F.col("attrs"), "name"), F.lit("")), F.nullif(text_value(F.col("attrs"), "machine"), F.lit(""))))
    return ads.filter("name is not null"), ads.filter("name is null").select("text")


def table_of(attrs: Column, private: bool = False) -> Column:
    """The table an ad belongs to, by its type; null, so passed over, where the type is unknown. All ads of a
    private source are machines' private ones."""
    if private:
        return F.lit("machine_private")
    tables = F.create_map(*(x for k, v in TABLES.items() for x in (F.lit(k.lower()), F.lit(v))))
    return F.try_element_at(tables, F.lower(text_value(attrs, "mytype")))


#: Ad types and the tables they go to.
TABLES = {
    "Machine": "machine",
    "Scheduler": "scheduler",
    "DaemonMaster": "master",
    "Submitter": "submitter",
    "Collector": "collector",
    "Negotiator": "negotiator",
    "License": "license",
    "Storage": "storage",
    "CkptServer": "checkpoint_server",
    "Accounting": "accounting",
    "Grid": "grid",
    "HAD": "availability",
    "Generic": "generic",
}
