"""Two-sided matching of requests and slots, ranks, tiers and rejections.

Requests are matched once for each distinct shape; a shape is what the
expressions see of a request. Equalities between the sides become hash-join keys.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import Compiler, attributes, parse, references
from ..functions.names import PRIVATE, ROOT_GROUP, ancestors, charged_group, claim_id, is_private, limit_tokens, remote_user, slot_weight

LOWEST, LOWEST_FLOAT = -1.7976931348623157e308, -3.4028234663852886e38
#: Tiers, better ones higher.
PRIO, RANK, NO_PREEMPTION = 0, 1, 2


def fixed_slots(slots: DataFrame, weight_default: str = "Cpus", admin: tuple[str, ...] = ()) -> DataFrame:
    """Slots as the matchmaker sees them: negotiator requirements in force, a weight that is a number, no list
    of offline matches, and none of the attributes that `admin` names or the private prefix marks."""
    out, have = slots, {c.lower(): c for c in slots.columns}
    if "negotiatorrequirements" in have and "requirements" in have:
        theirs, own = F.col(have["negotiatorrequirements"]), F.col(have["requirements"])
        out = out.withColumn("SavedRequirements", F.when(theirs.isNotNull(), own)).withColumn(have["requirements"], F.coalesce(theirs, own))
    weight = F.col("SlotWeight").try_cast("double") if "slotweight" in have and dict(slots.dtypes)[have["slotweight"]] == "string" else F.col("SlotWeight") if "slotweight" in have else F.lit(None)
    default, kind = Compiler(attributes(slots))(weight_default)
    out = out.withColumn("SlotWeight", F.coalesce(weight.cast("double"), default.cast("double") if kind in ("int", "real") else F.lit(None).cast("double"), F.lit(1.0)))
    return out.withColumn("MachineMatchCount", F.lit(0)).drop("OfflineMatches", "NegotiatorRequirements", *(c for c in slots.columns if c.lower() in {a.lower() for a in admin} or is_private(c) and c.lower() not in PRIVATE))


def trimmed_slots(slots: DataFrame, preemption: bool) -> DataFrame:
    """Slots that may match at all. The case of State counts here."""
    if preemption:
        return slots.filter(~F.coalesce(F.col("RetirementTimeRemaining") > 0, F.lit(False)))
    return slots.filter(~F.coalesce(F.col("State").isin("Claimed", "Preempting"), F.lit(False)) | F.coalesce(F.col("PartitionableSlot"), F.lit(False)))


def autoregrouped(submitters: DataFrame, regroups: Column, group: str = "group") -> DataFrame:
    """Submitters of groups that regroup (`regroups`) negotiate in the root group, too."""
    return submitters.unionByName(submitters.filter(regroups).withColumn(group, F.lit(ROOT_GROUP)))


def with_priority(submitters: DataFrame, ledger: DataFrame, name: str = "Name", priority: str = "priority", unknown: float = 500.0) -> DataFrame:
    """Each submitter with the ledger's priority (name, priority); `unknown` for those that it lacks."""
    return submitters.join(ledger.select(name, F.col(priority).alias("_p")).dropDuplicates([name]), name, "left").withColumn(priority, F.coalesce("_p", F.lit(unknown))).drop("_p")


def kept_submitters(submitters: DataFrame) -> DataFrame:
    named = (F.coalesce(F.col("Name"), F.lit("")) != "") & (F.coalesce(F.col("ScheddIpAddr"), F.lit("")) != "")
    skip = F.coalesce(F.col("SkipMatchmaking"), F.lit(False)) if "SkipMatchmaking" in submitters.columns else F.lit(False)
    return submitters.filter(named & ~skip & (F.coalesce(F.col("RunningJobs"), F.lit(0)) + F.coalesce(F.col("IdleJobs"), F.lit(0)) > 0))


def with_claims(slots: DataFrame, private: DataFrame) -> DataFrame:
    """Each slot's claim id from the private ads, "null" where there is none; of repeated keys the last counts."""
    secret = private.select(F.col("Name"), F.col("MyAddress"), claim_id("ClaimId", "Capability", "ClaimIdList").alias("claim"), "seq").filter("claim is not null and MyAddress is not null")
    last = secret.groupBy("Name", "MyAddress").agg(F.max_by("claim", "seq").alias("claim"))
    return slots.join(last, ["Name", "MyAddress"], "left").withColumn("claim", F.coalesce("claim", F.lit("null")))


def pool_size(slots: DataFrame) -> DataFrame:
    """Sum and least of the weights, and slots that count: a partitionable one as its CPUs."""
    weight = slot_weight("SlotWeight", "Cpus")
    return slots.agg(
        F.sum(weight.cast("decimal(28,6)")).cast("double").alias("total_weight"), F.min(F.nullif(weight, F.lit(0.0))).alias("least_weight"),
        F.sum(F.when(F.col("PartitionableSlot"), F.col("Cpus")).otherwise(1)).alias("effective_slots"),
    )


def stamped_users(slots: DataFrame, customers: DataFrame) -> DataFrame:
    """Slots with the priority, floor and use of who holds them, from the ledger."""
    users = customers.select(F.col("name").alias("_user"), F.col("effective_priority").alias("RemoteUserPrio"), F.col("floor").alias("RemoteUserFloor"), F.col("resources_used").alias("RemoteUserResourcesInUse"))
    by = remote_user(*(c for c in ("PreemptingAccountingGroup", "PreemptingUser", "AccountingGroup", "RemoteUser") if c in slots.columns))
    return slots.withColumn("_user", by).join(users, "_user", "left").drop("_user")


def sides(requests: DataFrame, slots: DataFrame) -> tuple[Compiler, Compiler]:
    """Compilers for a pair's row, whose columns are j_<request attribute> and m_<slot attribute>."""
    job = attributes(requests.select(*(F.col(c).alias(f"j_{c}") for c in requests.columns)), "j_")
    slot = attributes(slots.select(*(F.col(c).alias(f"m_{c}") for c in slots.columns)), "m_")
    return Compiler(job, slot), Compiler(slot, job)


def bilateral(requests: DataFrame, slots: DataFrame, job_requirements: str, slot_requirements: str = "true") -> DataFrame:
    """Pairs j_*, m_* for which each side's requirements hold.

    One expression text a side; `by_expression` splits ads that bring their own.
    String equalities compare in lower case, and Catalyst takes them as join keys;
    without any, requests must be few shapes against many slots.
    """
    job, slot = sides(requests, slots)
    left = requests.select(*(F.col(c).alias(f"j_{c}") for c in requests.columns))
    right = slots.select(*(F.col(c).alias(f"m_{c}") for c in slots.columns))
    return left.join(right, job.condition(job_requirements) & slot.condition(slot_requirements))


def by_expression(ads: DataFrame, column: str, most: int = 1000):
    """(text, ads with that text) for each distinct expression text; over `most` texts are refused."""
    texts = [r[0] for r in ads.select(column).distinct().limit(most + 1).collect()]
    if len(texts) > most:
        raise ValueError(f"more than {most} distinct {column} expressions")
    for text in sorted(texts, key=lambda t: (t is not None, t)):
        yield text, ads.filter(F.col(column).eqNullSafe(F.lit(text)))


def significant_attributes(expressions: list[str], job_columns: list[str], always: tuple[str, ...] = ("requirements", "rank"), banned: tuple[str, ...] = ("currenttime",)) -> list[str]:
    """Job attributes that the expressions of slots and requests look at, sorted."""
    seen = {name for text in expressions for scope, name in references(parse(text)) if scope in ("", "target")}
    jobs = {c.lower() for c in job_columns}
    return sorted({n for n in seen if n in jobs and n not in banned and not re.match(r"slot\d*_", n)} | set(always))


def shapes(requests: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each distinct shape, with how many requests have it."""
    return requests.groupBy(*columns).agg(F.count("*").alias("requests"), F.min("request_id").alias("first_request"))


def ranked_candidates(pairs: DataFrame, requests: DataFrame, slots: DataFrame, pre: str | None = None, rank: str | None = None, post: str | None = None, preempt: str | None = None) -> DataFrame:
    """`pairs` with pre_rank, rank, post_rank and preempt_rank. Unset or undefined ones are lowest, a job's own rank 0."""
    job, slot = sides(requests, slots)

    def value(compiler: Compiler, text: str | None, default: float) -> Column:
        if not text:
            return F.lit(default)
        c, kind = compiler(text)
        number = c.cast("double") if kind in ("int", "real", "bool") else F.lit(None).cast("double")
        return F.coalesce(number, F.lit(default))

    return pairs.select("*", value(slot, pre, LOWEST).alias("pre_rank"), value(job, rank, 0.0).alias("rank"), value(slot, post, LOWEST).alias("post_rank"), value(slot, preempt, LOWEST_FLOAT).alias("preempt_rank"))


def tier(user: str, submitter: str, rank: Column, current_rank: Column, policy: Column, only_for_rank: bool = False) -> Column:
    """NO_PREEMPTION, RANK or PRIO; null where the candidate is out."""
    holder, current = F.coalesce(F.col(user), F.lit("")), F.coalesce(current_rank, F.lit(LOWEST))
    if only_for_rank:
        return F.when((holder != "") & (rank > current), RANK)
    return F.when(holder == "", NO_PREEMPTION).when(rank > current, RANK).when((holder != F.col(submitter)) & F.coalesce(policy, F.lit(False)) & (rank >= current), PRIO)


def best_first(tiers: str = "tier", scan: str = "m_ScanIndex") -> list[Column]:
    return [F.desc("pre_rank"), F.desc("rank"), F.desc("post_rank"), F.desc(tiers), F.desc("preempt_rank"), F.asc(scan)]


def best_candidate(candidates: DataFrame, key: str, scan: str = "m_ScanIndex", tiers: str = "tier") -> DataFrame:
    """The best candidate of each request: an arg-max, partial on the map side."""
    order = F.struct("pre_rank", "rank", "post_rank", tiers, "preempt_rank", (-F.col(scan)).alias("scan"))
    return candidates.groupBy(key).agg(F.max_by(F.struct(*(c for c in candidates.columns if c != key)), order).alias("best")).select(key, "best.*")


def candidate_order(candidates: DataFrame, key: str, scan: str = "m_ScanIndex", tiers: str = "tier") -> DataFrame:
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*best_first(tiers, scan))))


def permitted(used, cost, allowed) -> Column:
    """A match fits its limit, or is the first and something is allowed."""
    return (F.col(used) + F.col(cost) <= F.col(allowed)) | ((F.col(used) <= 0) & (F.col(allowed) > 0))


def concurrency_open(requests: DataFrame, counts: DataFrame, maxima: DataFrame, key: str = "request_id", text: str = "ConcurrencyLimits") -> DataFrame:
    """Requests none of whose named limits would be passed."""
    asked = requests.select(key, F.explode(limit_tokens(text)).alias("t")).select(key, "t.name", "t.weight")
    state = asked.join(counts, "name", "left").join(maxima, "name")
    full = state.filter(F.coalesce("in_use", F.lit(0.0)) + F.col("weight") > F.col("most"))
    return requests.join(full.select(key), key, "left_anti")


def reject_reasons(candidates: DataFrame, key: str) -> DataFrame:
    """Why a request without a match has none: counters of what was in each candidate's way, the first that counts."""
    n = lambda why: F.sum(F.when(F.col("why") == why, 1).otherwise(0))
    sums = candidates.groupBy(key).agg(*(n(w).alias(w) for w in ("concurrency", "policy", "rank", "limit")))
    reason = F.when(F.col("concurrency") > 0, "concurrency limit reached").when(F.col("policy") + F.col("rank") > 0, "insufficient priority").when(F.col("limit") > 0, "submitter limit exceeded").otherwise("no match found")
    return sums.withColumn("reason", reason)


def enriched_requests(requests: DataFrame, submitters: DataFrame) -> DataFrame:
    """Requests with what they may refer to of their submitter."""
    s = submitters.select(F.col("name").alias("Owner"), F.col("prio").alias("SubmitterUserPrio"), F.col("usage").alias("SubmitterUserResourcesInUse"), charged_group("name").alias("SubmitterGroup"))
    return requests.join(s, "Owner", "left")


def match_ads(matches: DataFrame, expressions: dict[str, str], slots: DataFrame, prefix: str = "NegotiatorMatchExpr") -> DataFrame:
    """Matched slots as they are delivered: saved requirements restored, limits, group and chosen expressions added."""
    compile_ = Compiler(attributes(slots))
    out = matches
    if "SavedRequirements" in out.columns:
        out = out.withColumn("Requirements", F.coalesce("SavedRequirements", "Requirements")).drop("SavedRequirements")
    return out.withColumns({f"{prefix}{n}": compile_(text)[0] for n, text in expressions.items()} | {"RemoteGroup": charged_group("RemoteUser")})


def group_paths(names: str = "name") -> Column:
    return ancestors(charged_group(names))
