"""Columns over names, keys and limits that the pool's tables share."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT_GROUP = "<none>"
DEFAULT_LIMIT = 2308032.0
#: Attributes that never leave the store, by lower-case name.
PRIVATE = ("capability", "childclaimids", "claimid", "claimidlist", "claimids", "transferkey")
#: Names that begin so, in any case, don't leave it either. Deployments give the prefix of their ads; none by default.
PRIVATE_PREFIX = os.environ.get("AD_PRIVATE_PREFIX", "")


def is_private(name: str, prefix: str | None = None) -> bool:
    prefix = PRIVATE_PREFIX if prefix is None else prefix
    return name.lower() in PRIVATE or bool(prefix) and name.lower().startswith(prefix.lower())


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(""))


def ad_key(table: str, get: Callable[[str], Column]) -> Column:
    """Primary key of an ad of `table`: name, a zero character, address; null without Name and Machine.

    `get` gives an attribute as text, null where the ad lacks it. A machine's slot
    number and a submitter's scheduler name extend the name, and their addresses
    have a second source; masters have none.
    """
    name, extra, address = F.coalesce(blank_to_null(get("Name")), blank_to_null(get("Machine"))), F.lit(""), [blank_to_null(get("MyAddress"))]
    if table in ("machine", "machine_private"):
        extra = F.coalesce(F.concat(F.lit(":"), blank_to_null(get("SlotID"))), F.lit(""))
        address.append(blank_to_null(get("StartdIpAddr")))
    elif table in ("scheduler", "submitter"):
        extra = F.coalesce(get("ScheddName"), F.lit(""))
        address.append(blank_to_null(get("ScheddIpAddr")))
    elif table == "master":
        address = []
    return F.concat(name, extra, F.lit("\0"), F.coalesce(*address, F.lit("")))


def key_of(table: str, columns: list[str]) -> Column:
    """`ad_key` of a row with these columns."""
    have = {c.lower(): c for c in columns}
    return ad_key(table, lambda n: F.col(have[n.lower()]).cast("string") if n.lower() in have else F.lit(None).cast("string"))


def charged_group(user) -> Column:
    """The group a submitter is charged to: what stands before the last dot ahead of @."""
    found = F.regexp_extract(_col(user), r"^(.*)\.[^.]*@[^@]*$", 1)
    return F.when(found == "", ROOT_GROUP).otherwise(found)


def ancestors(group) -> Column:
    """The group's own name and that of each group above it: a.b.c, a.b, a."""
    parts = F.split(_col(group), r"\.")
    return F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))


def domain_of(user) -> Column:
    return F.when(F.instr(_col(user), "@") > 0, F.substring_index(_col(user), "@", -1)).otherwise("")


def resource_name(name, address) -> Column:
    return F.concat(_col(name), F.lit("@"), F.coalesce(_col(address), F.lit("")))


def limit_tokens(text) -> Column:
    """array<struct<name, weight>> of a list such as "gpu:2, license"; invalid names are left out."""

    def one(token: Column) -> Column:
        weight = F.regexp_extract(token, ":(.*)$", 1).try_cast("double")
        return F.struct(F.lower(F.trim(F.regexp_replace(token, ":.*$", ""))).alias("name"), F.when(weight > 0, weight).otherwise(1.0).alias("weight"))

    tokens = F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"[,\s]+"), lambda t: t != "")
    return F.filter(F.transform(tokens, one), lambda s: s["name"].rlike(r"^[a-z_]\w*(\.[a-z_]\w*)?$"))


def limit_max(name, config: dict[str, float]) -> Column:
    """The configured maximum: NAME_LIMIT, else the default of its prefix, else the default."""
    known = {k.lower(): float(v) for k, v in config.items()}
    table = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.lit(v)))) if known else F.create_map().cast("map<string,double>")
    prefix = F.when(F.instr(_col(name), ".") > 0, F.substring_index(_col(name), ".", 1))
    return F.coalesce(
        F.try_element_at(table, F.concat(F.lower(_col(name)), F.lit("_limit"))),
        F.try_element_at(table, F.concat(F.lit("concurrency_limit_default_"), F.lower(prefix))),
        F.try_element_at(table, F.lit("concurrency_limit_default")),
        F.lit(DEFAULT_LIMIT),
    )


def remote_user(*candidates) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*(blank_to_null(c) for c in candidates))


def slot_weight(weight, cpus, weighted: bool = True) -> Column:
    """Cost of a match: the weight if not negative, else the CPUs, else 1."""
    if not weighted:
        return F.lit(1.0)
    w, c = _col(weight).cast("double"), _col(cpus).cast("double")
    return F.when(w >= 0, w).when(c >= 0, c).otherwise(1.0)


def claim_id(claim, capability, listed) -> Column:
    return F.coalesce(blank_to_null(claim), blank_to_null(capability), blank_to_null(F.split(F.trim(_col(listed)), r"[,\s]+")[0]))


def addresses(text) -> Column:
    """The addresses of a list parted by commas or spaces, those in angle brackets whole."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"(<[^>]*>|[^,\s<]+)"), F.lit(1))


def round_half_up(x) -> Column:
    return F.floor(_col(x) + 0.5).cast("double")


def close_to(a, b, absolute: float = 1e-9, relative: float = 1e-9) -> Column:
    a, b = _col(a), _col(b)
    return F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))


def starvation(usage, allowance) -> Column:
    return F.when(_col(allowance) > 0, _col(usage) / _col(allowance)).otherwise(3.4028234663852886e38)
