"""The usage ledger: decayed priorities, usage by claims, quotas' demand and reports.

`customers` has a row for each submitter (its name holds @) or group; `resources`
one for each live claim. Amounts that are summed are rounded to 1e-6 first, so sums
don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import ancestors, charged_group, domain_of, limit_tokens

MIN_PRIORITY, DEFAULT_FACTOR, NICE_FACTOR, REMOTE_FACTOR, HALF_LIFE = 0.5, 1000.0, 1e10, 1e7, 86400.0


def exact_sum(x) -> Column:
    return F.sum((F.col(x) if isinstance(x, str) else x).cast("decimal(28,6)")).cast("double")


def _zero(c: str, default=0.0) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def decay_tick(customers: DataFrame, now: int, last_update: int, half_life: float = HALF_LIFE) -> DataFrame:
    """Priorities aged by half-life, usage accumulated, idle and forgotten customers purged.

    Without a last update, or with a clock gone back, nothing changes.
    """
    dt = now - last_update
    if not last_update or dt <= 0:
        return customers
    aging = 0.5 ** (dt / half_life)
    real = F.greatest(_zero("Priority"), F.lit(MIN_PRIORITY))
    recent = _zero("ResourcesUsed", 0) + _zero("UnchargedTime", 0) / dt
    weighted = F.when(_zero("HierWeightedResourcesUsed") > 0, F.col("HierWeightedResourcesUsed")).otherwise(_zero("WeightedResourcesUsed") + _zero("WeightedUnchargedTime") / dt)
    aged = real * aging + weighted * (1 - aging)
    accumulated = _zero("AccumulatedUsage") + _zero("ResourcesUsed", 0) * dt + _zero("UnchargedTime", 0)
    w_accumulated = F.coalesce("WeightedAccumulatedUsage", _zero("AccumulatedUsage")) + _zero("WeightedResourcesUsed") * dt + _zero("WeightedUnchargedTime")
    gone = (aged < MIN_PRIORITY) & (_zero("ResourcesUsed", 0) == 0) & (accumulated == 0) & F.col("PriorityFactor").isNull()
    begin = F.when((accumulated > 0) & (_zero("BeginUsageTime", 0) == 0), F.lit(now)).otherwise(_zero("BeginUsageTime", 0))
    last = F.when(recent > 0, F.lit(now)).otherwise(_zero("LastUsageTime", 0))
    new = {
        "Priority": F.greatest(aged, F.lit(MIN_PRIORITY)),
        "AccumulatedUsage": accumulated,
        "WeightedAccumulatedUsage": w_accumulated,
        "UnchargedTime": F.lit(0).cast("long"),
        "WeightedUnchargedTime": F.lit(0.0),
        "BeginUsageTime": begin.cast("long"),
        "LastUsageTime": last.cast("long"),
    }
    return customers.filter(~F.coalesce(gone, F.lit(False))).select(*(new.get(c, F.col(c)).alias(c) for c in customers.columns))


def priority_factor(name, stored, local_domain: str, group_factors: dict[str, float] | None = None, nice: str = "nice-user.") -> Column:
    """Stored if at least 1, else nice users', the group's, a remote domain's, the default one."""
    name, stored = F.col(name) if isinstance(name, str) else name, F.col(stored) if isinstance(stored, str) else stored
    out = F.when(stored >= 1, stored).when(F.lower(name).startswith(nice), NICE_FACTOR)
    for group, factor in (group_factors or {}).items():
        if factor:
            out = out.when(F.lower(charged_group(name)) == group.lower(), max(1.0, factor))
    return out.when((domain_of(name) != "") & (F.lower(domain_of(name)) != local_domain.lower()), REMOTE_FACTOR).otherwise(DEFAULT_FACTOR)


def effective_priority(priority, factor) -> Column:
    p = F.col(priority) if isinstance(priority, str) else priority
    return F.greatest(F.coalesce(p, F.lit(MIN_PRIORITY)), F.lit(MIN_PRIORITY)) * (F.col(factor) if isinstance(factor, str) else factor)


def submitter_limits(submitters: DataFrame, slot_total: float, quota: float = float("inf"), group_usage: float | None = None, preemption: bool = True, floor_round: bool = False) -> DataFrame:
    """Share, limit, unclaimed limit and ceiling headroom of each submitter (name, prio, usage, floor, ceiling).

    The normal factor counts each name once though it may have ads in several places.
    """
    most = submitters.agg(F.max("prio")).first()[0] or MIN_PRIORITY
    normal = submitters.dropDuplicates(["name"]).agg(exact_sum(F.lit(float(most)) / F.col("prio"))).first()[0] or 1.0
    share = F.lit(float(most)) / (F.col("prio") * F.lit(float(normal)))
    limit = F.greatest(F.lit(0.0), share * min(slot_total, quota) - F.col("usage"))
    free = limit if group_usage is None else F.least(limit, F.lit(max(0.0, quota - group_usage)))
    full = limit if preemption else free
    if floor_round:
        full, free = F.least(full, F.col("floor")), F.least(free, F.col("floor"))
    headroom = F.when(F.coalesce(F.col("ceiling"), F.lit(-1)) < 0, float("inf")).otherwise(F.greatest(F.lit(0.0), F.col("ceiling") - F.col("usage")))
    return submitters.select("*", share.alias("share"), full.alias("submitter_limit"), free.alias("unclaimed_limit"), headroom.alias("headroom"))


def pie_left(limits: DataFrame) -> DataFrame:
    return limits.agg(exact_sum("submitter_limit").alias("pie_left"))


def usage_by_user(resources: DataFrame, user: str = "RemoteUser") -> DataFrame:
    """Claims and weight of each submitter."""
    return resources.filter(F.instr(user, "@") > 0).groupBy(F.col(user).alias("name")).agg(F.count("*").alias("ResourcesUsed"), exact_sum(F.coalesce("SlotWeight", F.lit(1.0))).alias("WeightedResourcesUsed"))


def group_rollup(resources: DataFrame, user: str = "RemoteUser") -> DataFrame:
    """Weight charged to each group, and to it with all groups below."""
    charged = usage_by_user(resources, user).withColumn("group", charged_group("name"))
    own = charged.groupBy("group").agg(exact_sum("WeightedResourcesUsed").alias("weighted"))
    up = own.select(F.explode(ancestors("group")).alias("name"), "group", "weighted")
    return up.groupBy("name").agg(exact_sum(F.when(F.col("group") == F.col("name"), F.col("weighted")).otherwise(0.0)).alias("weighted"), exact_sum("weighted").alias("hier_weighted"))


def still_claimed(slots: DataFrame, customer: Column, out: str = "held") -> DataFrame:
    """Whether each slot is claimed, or being preempted, and by `customer`."""
    state, holder = F.coalesce(F.lower("State"), F.lit("")), F.coalesce("RemoteUser", F.lit(""))
    return slots.withColumn(out, state.isin("claimed", "preempting") & (holder == customer))


def strict_caps(used: DataFrame, caps: DataFrame, slots: float) -> DataFrame:
    """(node, slots): what each group of `used` (node, used) may still take of `slots` under the groups above
    it, and itself, that accept no surplus: `caps` (group, cap) has these."""
    above = used.select("node", "used", F.explode(ancestors("node")).alias("group"))
    below = above.groupBy("group").agg(exact_sum("used").alias("subtree"))
    left = above.join(below, "group").join(caps, "group")
    return left.groupBy("node").agg(F.least(F.lit(slots), F.min(F.greatest(F.lit(0.0), F.col("cap") - F.col("subtree")))).alias("slots"))


def live_resources(resources: DataFrame, slots: DataFrame) -> DataFrame:
    """Claims whose slot is still claimed by the same customer; the others are stale."""
    held = slots.filter(F.lower("State").isin("claimed", "preempting")).select(F.col("key"), F.col("RemoteUser").alias("holder"))
    return resources.join(held, (resources["key"] == held["key"]) & (resources["RemoteUser"] == held["holder"]), "left_semi")


def rebuilt_usage(customers: DataFrame, resources: DataFrame) -> DataFrame:
    """Each cycle the weighted usage is rebuilt from live claims."""
    now = usage_by_user(resources).select("name", F.col("WeightedResourcesUsed").alias("now"))
    out = customers.join(now, "name", "left")
    return out.withColumn("WeightedResourcesUsed", _zero("now")).drop("now")


def limit_counts(resources: DataFrame, text: str = "MatchedConcurrencyLimits") -> DataFrame:
    tokens = resources.select(F.explode(limit_tokens(text)).alias("t"))
    return tokens.groupBy(F.col("t.name").alias("name")).agg(exact_sum("t.weight").alias("in_use"))


def charge_matches(customers: DataFrame, started: DataFrame, ended: DataFrame, last_update: int) -> DataFrame:
    """Matches that began (name, at, weight) and ended (name, at, start, weight) since the last tick.

    A start takes the time before it off what the tick will charge; an end adds the
    time since the later of its start and the tick.

    Movements are dealt by name and kind before they are summed, so a task holds sums of its
    own names and not of nearly all. Both kinds of a name meet by their sums only, so the
    movements of a very frequent name may be split among tasks.
    """
    on = started.select("name", F.lit(1).alias("n"), F.col("weight").alias("w"), (F.lit(last_update) - F.col("at")).alias("t"))
    off = ended.select("name", F.lit(-1).alias("n"), (-F.col("weight")).alias("w"), (F.col("at") - F.greatest("start", F.lit(last_update))).alias("t"))
    dealt = on.unionByName(off).hint("rebalance", "name", "n")
    moved = dealt.groupBy("name").agg(F.sum("n").alias("n"), exact_sum("w").alias("w"), F.sum("t").alias("t"), exact_sum(F.col("t") * F.abs("w")).alias("wt"))
    out = customers.join(moved, "name", "left")
    floor = lambda c: F.greatest(c, F.lit(0))
    return out.withColumns({
        "ResourcesUsed": floor(_zero("ResourcesUsed", 0) + _zero("n", 0)).cast("long"),
        "WeightedResourcesUsed": floor(_zero("WeightedResourcesUsed") + _zero("w")).cast("double"),
        "UnchargedTime": (_zero("UnchargedTime", 0) + _zero("t", 0)).cast("long"),
        "WeightedUnchargedTime": _zero("WeightedUnchargedTime") + _zero("wt"),
    }).drop("n", "w", "t", "wt")


def set_values(customers: DataFrame, changes: DataFrame) -> DataFrame:
    """Point changes (name, and any of the ledger's columns, null: unchanged); factors are 1 at least."""
    named = [c for c in changes.columns if c != "name"]
    new = changes.select("name", *(F.col(c).alias(f"new_{c}") for c in named))
    if "PriorityFactor" in named:
        new = new.withColumn("new_PriorityFactor", F.greatest(F.col("new_PriorityFactor"), F.lit(1.0)))
    out = customers.join(new, "name", "full_outer")
    return out.select("name", *(F.coalesce(f"new_{c}", c).alias(c) if c in named else F.col(c) for c in customers.columns if c != "name"))


def reset_usage(customers: DataFrame, now: int, names: DataFrame | None = None) -> DataFrame:
    """Accumulated usage to zero, of the named or of all; usage begins anew."""
    out = customers if names is None else customers.join(names.select("name", F.lit(True).alias("_hit")), "name", "left")
    hit = F.lit(True) if names is None else F.col("_hit").isNotNull()
    new = {"AccumulatedUsage": F.lit(0.0), "WeightedAccumulatedUsage": F.lit(0.0), "BeginUsageTime": F.lit(now).cast("long")}
    return out.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in customers.columns))


def userprio(customers: DataFrame, local_domain: str, rollup: bool = False) -> DataFrame:
    """The report: effective priority and usage of each customer; a rollup folds each group into its parent."""
    factor = priority_factor("name", "PriorityFactor", local_domain)
    rows = customers.select(
        "name", (F.instr("name", "@") == 0).alias("is_group"), effective_priority("Priority", factor).alias("priority"), factor.alias("factor"),
        _zero("ResourcesUsed", 0).alias("resources_used"), _zero("WeightedResourcesUsed").alias("weighted"), _zero("WeightedAccumulatedUsage").alias("accumulated"),
        F.nullif("BeginUsageTime", F.lit(0)).alias("begin"), F.nullif("LastUsageTime", F.lit(0)).alias("last"),
    )
    if not rollup:
        return rows
    parent = F.when(F.col("is_group") & (F.instr("name", ".") > 0), F.regexp_replace("name", r"\.[^.]*$", ""))
    both = rows.union(rows.withColumn("name", parent).filter("name is not null"))
    return both.groupBy("name").agg(F.sum("resources_used").alias("resources_used"), exact_sum("weighted").alias("weighted"), exact_sum("accumulated").alias("accumulated"), F.min("begin").alias("begin"), F.max("last").alias("last"))


def accounting_ads(customers: DataFrame, publish: bool = True) -> DataFrame:
    """Ads of the ledger's customers; those published leave out submitters without usage and uncharged time."""
    is_group = F.instr("name", "@") == 0
    rows = customers.select(F.lit("Accounting").alias("MyType"), "*", is_group.alias("IsAccountingGroup"), charged_group("name").alias("AccountingGroup"))
    return rows.filter(is_group | (_zero("ResourcesUsed", 0) > 0)).drop("UnchargedTime", "WeightedUnchargedTime") if publish else rows


def resource_list(resources: DataFrame, submitter: str) -> DataFrame:
    held = resources.filter(F.col("RemoteUser") == submitter)
    return held.select(F.row_number().over(Window.partitionBy("RemoteUser").orderBy("key", "SlotWeight")).alias("n"), "key", "StartTime", "SlotWeight")


def group_demand(submitters: DataFrame, group: str = "group", weighted: bool = True) -> DataFrame:
    """Jobs idle and running of each group, weighted where the ad says so."""
    part = lambda w, n: F.coalesce(F.col(w), F.col(n).cast("double"), F.lit(0.0)) if weighted else F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    return submitters.groupBy(group).agg(exact_sum(part("WeightedIdleJobs", "IdleJobs") + part("WeightedRunningJobs", "RunningJobs")).alias("requested"))


def ledger_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str, absolute: float = 1e-9, relative: float = 1e-9) -> DataFrame:
    """Rows of two ledgers that differ by more than the tolerance, or that one of them lacks."""
    both = left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    near = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs("a"), F.abs("b")))
    return both.filter(~F.coalesce(near, F.lit(False)))
