"""The keyed ad store: upserts, constraint queries, redaction, deletes and expiry.

A table is a DataFrame of ads; every operation gives a new one. Rows are found by
`key`; `LastHeardFrom` is the time an ad was received.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.expressions import Compiler, attributes
from ..functions.names import PRIVATE, is_private

DEFAULT_LIFETIME = 900


def received(updates: DataFrame, now: int) -> DataFrame:
    """Ads as the store keeps them: stamped with the time it heard of them."""
    return updates.withColumn("LastHeardFrom", F.lit(now).cast("long"))


def latest(updates: DataFrame, key: str | list[str] = "key", order: list[str] | None = None) -> DataFrame:
    """The last update of each key; `order` ends in a unique column. An arg-max with a partial aggregate, which
    Spark sorts by key, since rows have no fixed width."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in updates.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*(order or ["LastHeardFrom", "seq"])))
    return updates.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(last.alias("ad")).select(*keys, "ad.*")


def upsert(table: DataFrame, updates: DataFrame, key: str = "key", order: list[str] | None = None) -> DataFrame:
    """`table` with each key's last update in its row's place: arrival order wins."""
    new = latest(updates, key, order)
    kept = table.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def newest_version(updates: DataFrame, key: str = "key", start: str = "DaemonStartTime", sequence: str = "UpdateSequenceNumber", tie: str = "seq") -> DataFrame:
    """Of conflicting updates the one with the newest (start, sequence). One with both beats those
    without; among equals the first to arrive stays."""
    known = F.col(start).isNotNull() & F.col(sequence).isNotNull()
    version = F.struct(known.alias("known"), F.when(known, F.col(start)).alias("start"), F.when(known, F.col(sequence)).alias("sequence"), (-F.col(tie)).alias("first"))
    return latest(updates.withColumn("_version", version), key, ["_version"]).drop("_version")


def private_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if is_private(c)]


def redacted(ads: DataFrame) -> DataFrame:
    return ads.drop(*private_columns(ads.columns))


def redacted_map(attrs: Column) -> Column:
    prefixed = lambda k: F.lower(k).startswith(names.PRIVATE_PREFIX.lower()) if names.PRIVATE_PREFIX else F.lit(False)
    return F.map_filter(attrs, lambda k, _: ~(F.lower(k).isin(*PRIVATE) | prefixed(k)))


def projection_list(text: str | None) -> list[str]:
    return [x for x in re.split(r"[,\s]+", text or "") if x]


def project(ads: DataFrame, names: list[str]) -> DataFrame:
    """The named attributes that there are, whatever their case; types lead, and none named means all."""
    if not names:
        return ads
    asked = {n.lower() for n in names} | {"mytype", "targettype"}
    return ads.select(*(c for c in ads.columns if c.lower() in asked))


def projected_map(attrs: Column, names: list[str]) -> Column:
    asked = [*(n.lower() for n in names), "mytype", "targettype"]
    return attrs if not names else F.map_filter(attrs, lambda k, _: F.lower(k).isin(*asked))


@dataclass(frozen=True)
class Query:
    """A query's constraint, projection and limit; `parse` reads them from a query ad."""

    constraint: str = ""
    projection: tuple[str, ...] = ()
    limit: int = 0

    @staticmethod
    def parse(ad: Mapping[str, object], target: str = "") -> Query:
        low = {k.lower(): v for k, v in ad.items()}

        def get(name: str):
            return low.get(f"{target}{name}".lower(), low.get(name.lower()))

        names = get("Projection") or get("ProjectionAttributes") or ""
        limit = get("LimitResults")
        return Query(str(get("Requirements") or ""), tuple(projection_list(str(names))), limit if isinstance(limit, int) and limit > 0 else 0)


def matching(ads: DataFrame, constraint: str | None, now: int | None = None) -> DataFrame:
    """Ads for which the constraint is true. The predicate is a column, so it reaches the scan."""
    return ads.filter(Compiler(attributes(ads), now=now).condition(constraint))


def run_query(ads: DataFrame, query: Query, private: bool = False, order: list[str] | None = None) -> DataFrame:
    """Filter, limit, projection; private attributes never leave but from the private table."""
    found = matching(ads, query.constraint)
    if query.limit:
        found = (found.orderBy(*order) if order else found).limit(query.limit)
    found = project(found, list(query.projection))
    return found if private else redacted(found)


def any_ads(tables: Mapping[str, DataFrame], private: tuple[str, ...] = ("machine_private",)) -> DataFrame:
    """All public tables' ads."""
    out = None
    for name, table in tables.items():
        if name not in private:
            out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return redacted(out)


def multi_query(tables: Mapping[str, DataFrame], ad: Mapping[str, object], order: Mapping[str, list[str]] | None = None) -> DataFrame:
    """A query of several targets, each with its own or the common constraint, projection and limit.
    Unknown targets are passed over."""
    out, low = None, {k.lower(): v for k, v in tables.items()}
    targets = projection_list(str(next((v for k, v in ad.items() if k.lower() == "targettype"), "")))
    for i, target in enumerate(targets):
        if target.lower() in low:
            part = run_query(low[target.lower()], Query.parse(ad, target), order=(order or {}).get(target)).withColumn("target", F.lit(i))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def expired(ads: DataFrame, now: int, lifetime: str = "AdLifetime", default: int = DEFAULT_LIFETIME) -> Column:
    own = F.coalesce(F.col(lifetime), F.lit(default)) if lifetime in ads.columns else F.lit(default)
    return F.coalesce(F.lit(now) - F.col("LastHeardFrom") > own, F.lit(False))


def expire(ads: DataFrame, now: int, lifetime: str = "AdLifetime") -> DataFrame:
    """Ads not past their lifetime; those never heard of don't expire."""
    return ads.filter(~expired(ads, now, lifetime))


def invalidate_keys(ads: DataFrame, keys: DataFrame, shadow: DataFrame | None = None, key: str = "key"):
    """Without the ads of these keys, nor their private shadows."""
    left = ads.join(keys, key, "left_anti")
    return left if shadow is None else (left, shadow.join(keys, key, "left_anti"))


def invalidate_where(ads: DataFrame, constraint: str, shadow: DataFrame | None = None, key: str = "key"):
    """Without the ads for which the constraint is true, nor their private shadows."""
    test = Compiler(attributes(ads)).predicate(constraint)
    left = ads.filter(~test)
    return left if shadow is None else (left, shadow.join(ads.filter(test).select(key), key, "left_anti"))


def with_private(public: DataFrame, private: DataFrame, key: str = "key") -> DataFrame:
    """Private ads as they are stored: under the public ad's key, whose name, address and type lead."""
    lead = [c for c in public.columns if c.lower() in ("name", "myaddress", "mytype")]
    rest = [c for c in private.columns if c.lower() not in ("name", "myaddress", "mytype") and c != key]
    return private.select(key, *rest).join(public.select(key, *lead), key).select(key, *lead, *rest)


def point_get(ads: DataFrame, key: str) -> DataFrame:
    return ads.filter(F.col("key") == key)


def storage_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Ads and bytes of each table."""
    out = None
    for name, table in tables.items():
        size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in table.columns), F.lit(0))
        one = table.agg(F.count("*").alias("ads"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")).select(F.lit(name).alias("ad_type"), "ads", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


def write_table(ads: DataFrame, path: str, sort: tuple[str, ...] = ("State",)) -> None:
    """Parquet that prunes well: rows sorted on what constraints name most."""
    by = [c for c in sort if c in ads.columns]
    (ads.sortWithinPartitions(*by) if by else ads).write.mode("overwrite").option("compression", "zstd").parquet(path)


def ranked(ads: DataFrame, partition: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    return ads.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
