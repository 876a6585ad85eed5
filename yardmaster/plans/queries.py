"""One query for each operator over the pool's views, beside its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.expressions import Compiler, attributes
from ..operators import accounting, groups, matching, negotiation, store
from ..sources import ad_text, ledger_log, synthetic
from ..streaming import changes
from .views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *views: str):
    """Register a function of the named views' DataFrames, and its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(view(spark, sf_dir, v) for v in views)) if views else f(spark, sf_dir)

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


PUBLIC = "ScanIndex, Name, MyAddress, key, MyType, OpSys, Arch, Cpus, Memory, SlotWeight, State, PartitionableSlot, RemoteUser, CurrentRank, LastHeardFrom, AdLifetime, RetirementTimeRemaining, MatchedConcurrencyLimits"

# ---- scans, projections, redaction, limits, unions


@query("select Name, Cpus, Memory, MyType from slots where lower(State) = 'claimed' and Cpus > 5", "slots")
def d2_constraint_scan(slots):
    return store.run_query(slots, store.Query('State == "CLAIMED" && Cpus > 5', ("name", "Cpus", "Memory")))


@query("select Name, Cpus from slots where Cpus // 3 * 2 + Memory % 7 > 10 and not (State = 'Owner' and Cpus < 20) and (CurrentRank is null or CurrentRank >= 3)", "slots")
def d1_constraint_language(slots):
    return store.matching(slots, 'Cpus / 3 * 2 + Memory % 7 > 10 && !(State == "owner" && Cpus < 20) && (CurrentRank =?= undefined || CurrentRank >= 3)').select("Name", "Cpus")


@query("select Name, Arch, MyType from slots", "slots")
def c2_projection(slots):
    return store.run_query(slots, store.Query(projection=tuple(store.projection_list("NAME, arch Missing"))))


@query(f"select {PUBLIC} from slots where Cpus >= 25", "slots")
def c5_redaction(slots):
    return store.run_query(slots, store.Query("Cpus >= 25"))


@query("select Name, MyType from slots", "slots")
def c6_redaction_beats_projection(slots):
    return store.run_query(slots, store.Query(projection=("ClaimId", "Name")))


@query("select Name, State, Cpus from slots where State in ('Claimed', 'Owner') and Cpus between 10 and 20", "slots")
def d5_pushed_predicates(slots):
    return store.matching(slots, '(State =?= "Claimed" || State =?= "Owner") && Cpus >= 10 && Cpus <= 20').select("Name", "State", "Cpus")


@query("select Name, Cpus, MyType from slots where Cpus > 10 order by ScanIndex limit 25", "slots")
def h1_limit_ordered(slots):
    return store.run_query(slots, store.Query.parse({"Requirements": "Cpus > 10", "Projection": "Name Cpus", "LimitResults": 25}), order=["ScanIndex"])


@query("select Name, MyType from slots union all select Name, MyType from submitters", "slots", "submitters")
def i1_any_union(slots, submitters):
    private = slots.select("Name", "MyType", "ClaimId")
    return store.any_ads({"machine": slots.select("Name", "MyType", "ClaimId"), "submitter": submitters.select("Name", "MyType"), "machine_private": private})


@query("select 0 as target, Name, MyType, cast(null as bigint) as RunningJobs from slots where Cpus > 40 union all select 1, Name, MyType, RunningJobs from submitters where RunningJobs > 3", "slots", "submitters")
def i2_multi_target(slots, submitters):
    ad = {"TargetType": "Machine,Submitter,Nothing", "MachineRequirements": "Cpus > 40", "MachineProjection": "Name", "SubmitterRequirements": "RunningJobs > 3", "SubmitterProjection": "Name RunningJobs"}
    return store.multi_query({"Machine": slots, "Submitter": submitters}, ad)


@query("select * from (select Name, Cpus from slots where ScanIndex = 7)", "slots")
def a22_point_get(slots):
    return store.point_get(slots.withColumn("key", F.col("Name")), "slot7").select("Name", "Cpus")


@query("select count(*) as ads from slots", "slots")
def a23_row_count(slots):
    return slots.agg(F.count("*").alias("ads"))


@query("select 'machine' as ad_type, count(*) as ads from slots union all select 'submitter', count(*) from submitters", "slots", "submitters")
def f14_storage_stats(slots, submitters):
    return store.storage_stats({"machine": slots, "submitter": submitters}).select("ad_type", "ads")


# ---- keys, upserts, versions, deletes, expiry


_KEYS = """select tbl, case when tbl = 'machine' then Name || coalesce(':' || slot, '') || '|' || coalesce(nullif(addr, ''), '<startd>')
  when tbl = 'master' then Name || '|' when tbl in ('scheduler', 'submitter') then Name || coalesce(schedd, '') || '|' || coalesce(nullif(addr, ''), '<schedd>') else Name || '|' || coalesce(addr, '') end as k
from (select case when ScanIndex % 9 = 0 then MyType else Name end as Name, case when ScanIndex % 3 = 0 then cast(ScanIndex as string) end as slot, case ScanIndex % 4 when 0 then '' when 1 then MyAddress end as addr,
  case when ScanIndex % 2 = 0 then 'schedd' end as schedd, unnest(['machine', 'scheduler', 'submitter', 'master', 'negotiator']) as tbl from slots)"""


def _keyed(slots: DataFrame) -> DataFrame:
    """Ads of each kind; some lack the name, the slot number, the scheduler's name or the address."""
    return slots.select(
        F.expr("case when ScanIndex % 9 = 0 then '' else Name end").alias("Name"), F.col("MyType").alias("Machine"), F.expr("case when ScanIndex % 3 = 0 then ScanIndex end").alias("SlotID"),
        F.expr("case ScanIndex % 4 when 0 then '' when 1 then MyAddress end").alias("MyAddress"), F.lit("<startd>").alias("StartdIpAddr"), F.expr("case when ScanIndex % 2 = 0 then 'schedd' end").alias("ScheddName"), F.lit("<schedd>").alias("ScheddIpAddr"),
    )


def _all_tables(key) -> F.Column:
    """A row for each kind of table: its key as text."""
    pairs = [F.struct(F.lit(t).alias("tbl"), F.replace(key(t), F.lit("\0"), F.lit("|")).alias("k")) for t in ("machine", "scheduler", "submitter", "master", "negotiator")]
    return F.explode(F.array(*pairs)).alias("x")


@query(_KEYS, "slots")
def a5_hash_key(slots):
    ads = _keyed(slots)
    return ads.select(_all_tables(lambda t: names.key_of(t, ads.columns))).select("x.*")


@query("select key, arg_max(State, seq) as State, max(seq) as seq, arg_max(Load, seq) as Load from updates group by key", "updates")
def a1_upsert_latest(updates):
    return store.latest(updates, order=["seq"]).select("key", "State", "seq", "Load")


@query("select key, arg_max(State, seq) as State, max(seq) as seq from updates group by key", "updates")
def a10_micro_batch_last(updates):
    old, new = updates.filter("seq % 2 = 0 and seq < 5000"), updates.filter("seq % 2 = 1 or seq >= 5000")
    first = store.latest(old, order=["seq"])
    later = store.latest(new, order=["seq"])
    return store.latest(first.unionByName(later), order=["seq"]).select("key", "State", "seq")


@query("""select key, seq from (select key, seq, row_number() over (partition by key order by (DaemonStartTime is not null and UpdateSequenceNumber is not null) desc,
  case when UpdateSequenceNumber is not null then DaemonStartTime end desc nulls last, case when DaemonStartTime is not null then UpdateSequenceNumber end desc nulls last, seq) as k from updates) where k = 1""", "updates")
def a12_version_max_by(updates):
    return store.newest_version(updates).select("key", "seq")


@query("select key, 5000 as LastHeardFrom, count(*) as n from updates group by key", "updates")
def a7_receive_stamp(updates):
    return store.received(updates, 5000).groupBy("key", F.col("LastHeardFrom").cast("int").alias("LastHeardFrom")).agg(F.count("*").alias("n"))


@query("select key from slots where not (State = 'Unclaimed' and Cpus < 25)", "slots")
def n2_invalidate_where(slots):
    return store.invalidate_where(slots, 'State == "Unclaimed" && Cpus < 25').select("key")


@query("select key from slots where ScanIndex % 10 <> 3", "slots")
def n1_invalidate_keys(slots):
    return store.invalidate_keys(slots, slots.filter("ScanIndex % 10 = 3").select("key")).select("key")


@query("select key, ClaimId from slots where not (State = 'Claimed')", "slots")
def e3_shadow_anti_join(slots):
    return store.invalidate_where(slots, 'State == "Claimed"', slots.select("key", "ClaimId"))[1]


@query("select key, LastHeardFrom from slots where not (1000001500 - LastHeardFrom > coalesce(AdLifetime, 900))", "slots")
def n3_expire_ttl(slots):
    return store.expire(slots, 1000001500).select("key", "LastHeardFrom")


@query("select key, Name, MyType, ClaimId as Capability from slots where Cpus > 30", "slots")
def a3_private_shadow(slots):
    public = slots.filter("Cpus > 30").select("key", "Name", "MyType")
    return store.with_private(public, slots.select("key", F.lit("other").alias("Name"), F.col("ClaimId").alias("Capability")))


# ---- text


def _as_text(slots: DataFrame) -> DataFrame:
    return slots.select("key", ad_text.written(slots.select("MyType", "Name", "Cpus", "ClaimId", "State")).alias("text"))


@query("select key, Name, Cpus, State from slots", "slots")
def a2_parse_text(slots):
    parsed = ad_text.with_attributes(_as_text(slots))
    value = lambda n: ad_text.text_value(F.col("attrs"), n)
    return parsed.select("key", value("Name").alias("Name"), value("Cpus").cast("long").alias("Cpus"), value("State").alias("State"))


@query(_KEYS, "slots")
def a6_key_from_text(slots):
    ads = _keyed(slots)
    return ads.select(ad_text.written(ads).alias("text")).select(_all_tables(lambda t: ad_text.key_in_text(F.col("text"), t))).select("x.*")


@query("select key, concat('Name = \"', Name, '\"', chr(10), 'Cpus = ', cast(Cpus as string)) as copied from slots", "slots")
def a4_copy_lines(slots):
    return _as_text(slots).select("key", ad_text.copied_lines(F.col("text"), "name", "cpus").alias("copied"))


@query("""select key, concat('MyType = "Machine"', chr(10), 'Name = "', Name, '"', chr(10), 'Cpus = ', cast(Cpus as string), chr(10), 'ClaimId = "<redacted>"', chr(10), 'State = "', State, '"') as safe from slots""", "slots")
def c8_sanitized(slots):
    return _as_text(slots).select("key", ad_text.sanitized(F.col("text")).alias("safe"))


@query("select key, Cpus from slots", "slots")
def j16_int_from_text(slots):
    return _as_text(slots).select("key", ad_text.integer_in_text(F.col("text"), "Cpus").alias("Cpus"))


@query("select case ScanIndex % 3 when 0 then 'machine' else 'submitter' end as tbl, count(*) as ads from slots where ScanIndex % 3 < 2 group by 1 union all select 'machine_private', count(*) from slots", "slots")
def a14_route_by_type(slots):
    """Machines, submitters and ads of no known type, which are passed over; and a private source."""
    kinds = slots.withColumn("MyType", F.expr("case ScanIndex % 3 when 0 then 'MACHINE' when 1 then 'Submitter' else 'Widget' end"))
    attrs = ad_text.with_attributes(_as_text(kinds).select("text")).select("attrs")
    routed = attrs.select(ad_text.table_of(F.col("attrs")).alias("tbl")).unionByName(attrs.select(ad_text.table_of(F.col("attrs"), private=True).alias("tbl")))
    return routed.filter("tbl is not null").groupBy("tbl").agg(F.count("*").alias("ads"))


# ---- change streams


@query("select seq, key, case when m then 0 else 1 end as kind from (select *, lag(m, 1, false) over (partition by key order by seq) as was from (select *, Load > 50 and State = 'click' as m from updates)) where m or was", "updates")
def k2_watch_filtered(updates):
    return changes.changes(updates, 'Load > 50 && State =?= "click"').select("seq", "key", "kind")


@query("select 0 as kind, cast(key as string) as key, seq as cursor from updates where seq > 700 union all select 3, null, max(seq) from updates", "updates")
def k1_watch_resume(updates):
    return changes.replay(updates, cursor=700)


@query("select 2 as kind, cast(null as string) as key, cast(null as bigint) as cursor union all select 0, cast(key as string), max(seq) from updates group by key union all select 3, null, max(seq) from updates", "updates")
def k1_watch_anew(updates):
    return changes.replay(updates)


@query("select key, seq from (select key, max(seq) as seq, arg_max(LastHeardFrom, seq) as h from updates group by key) where not (1009000 - h > 900)", "updates")
def k5_sweep(updates):
    return changes.swept(store.latest(updates, order=["seq"]).withColumn("now", F.lit(1009000))).select("key", "seq")


# ---- ledger


@query("select RemoteUser as name, count(*) as ResourcesUsed, cast(sum(cast(SlotWeight as decimal(28,6))) as double) as WeightedResourcesUsed from claims group by 1", "claims")
def f1_usage_by_user(claims):
    return accounting.usage_by_user(claims)


@query("""with own as (select regexp_extract(RemoteUser, '^(.*)\\.[^.]*@[^@]*$', 1) as g, sum(cast(SlotWeight as decimal(28,6))) as w from claims group by 1),
up as (select g as name, g, w from own union all select split_part(g, '.', 1), g, w from own)
select name, cast(sum(case when name = g then w else 0 end) as double) as weighted, cast(sum(w) as double) as hier_weighted from up group by name""", "claims")
def f3_group_rollup(claims):
    return accounting.group_rollup(claims)


@query("""select name, cast(sum(cast(w as decimal(28,6))) as double) as in_use from (
  select unnest(case when MatchedConcurrencyLimits = 'gpu:2, license' then [{'name': 'gpu', 'w': 2.0}, {'name': 'license', 'w': 1.0}] when MatchedConcurrencyLimits is not null then [{'name': 'gpu', 'w': 1.0}, {'name': 'grp.gpu', 'w': 3.0}] end, recursive := true) from claims) group by name""", "claims")
def f4_limit_counts(claims):
    return accounting.limit_counts(claims)


_AGE = 0.5 ** (3600 / 86400.0)


@query(f"""select name, greatest(aged, 0.5) as Priority, AccumulatedUsage + ResourcesUsed * 3600 + UnchargedTime as AccumulatedUsage,
  WeightedAccumulatedUsage + WeightedResourcesUsed * 3600 + WeightedUnchargedTime as WeightedAccumulatedUsage,
  cast(case when AccumulatedUsage + ResourcesUsed * 3600 + UnchargedTime > 0 and BeginUsageTime = 0 then 103600 else BeginUsageTime end as bigint) as BeginUsageTime
from (select *, greatest(Priority, 0.5::double) * {_AGE!r}::double + (WeightedResourcesUsed + WeightedUnchargedTime / 3600) * {1 - _AGE!r}::double as aged from customers)
where not coalesce(aged < 0.5 and ResourcesUsed = 0 and AccumulatedUsage + ResourcesUsed * 3600 + UnchargedTime = 0 and PriorityFactor is null, false)""", "customers")
def p1_decay_tick(customers):
    return accounting.decay_tick(customers, 103600, 100000).select("name", "Priority", "AccumulatedUsage", "WeightedAccumulatedUsage", "BeginUsageTime")


_FACTOR = "case when PriorityFactor >= 1 then PriorityFactor when lower(regexp_extract(name, '^(.*)\\.[^.]*@[^@]*$', 1)) = 'g1' then 5000.0 when name like '%@%' and split_part(name, '@', 2) <> 'pool' then 1e7 else 1000.0 end"


@query(f"select name, cast({_FACTOR} as double) as factor from customers", "customers")
def p2_priority_factor(customers):
    return customers.select("name", accounting.priority_factor("name", "PriorityFactor", "pool", {"g1": 5000.0}).alias("factor"))


@query(f"select name, greatest(Priority, 0.5::double) * cast({_FACTOR} as double) as effective from customers", "customers")
def p3_effective_priority(customers):
    return customers.select("name", accounting.effective_priority("Priority", accounting.priority_factor("name", "PriorityFactor", "pool", {"g1": 5000.0})).alias("effective"))


_LIMITS = """with t as (select max(prio) as most from submitters), n as (select cast(sum(cast(most / prio as decimal(28,6))) as double) as normal from (select distinct Name, prio, most from submitters, t)),
l as (select s.*, most / (prio * normal) as share, greatest(0.0::double, most / (prio * normal) * 20000.0 - usage) as submitter_limit from submitters s, t, n)"""


@query(f"{_LIMITS} select Name as name, share, submitter_limit, case when ceiling < 0 then 'infinity'::double else greatest(0.0::double, ceiling - usage) end as headroom from l", "submitters")
def p4_submitter_limit(submitters):
    return accounting.submitter_limits(submitters.withColumnRenamed("Name", "name"), 20000.0).select("name", "share", "submitter_limit", "headroom")


@query(f"{_LIMITS} select cast(sum(cast(submitter_limit as decimal(28,6))) as double) as pie_left from l", "submitters")
def f8_pie_left(submitters):
    return accounting.pie_left(accounting.submitter_limits(submitters.withColumnRenamed("Name", "name"), 20000.0))


@query("select max(prio) as most, cast(sum(cast(prio as decimal(28,6))) as double) as total from (select distinct Name, prio from submitters)", "submitters")
def f7_distinct_names(submitters):
    return submitters.dropDuplicates(["Name"]).agg(F.max("prio").alias("most"), accounting.exact_sum("prio").alias("total"))


@query("select top as \"group\", cast(sum(cast(coalesce(WeightedIdleJobs, IdleJobs) + RunningJobs as decimal(28,6))) as double) as requested from submitters group by top", "submitters")
def f9_group_demand(submitters):
    return accounting.group_demand(submitters.withColumn("group", F.col("top")))


@query("select name, ResourcesUsed as resources_used, WeightedResourcesUsed as weighted, nullif(BeginUsageTime, 0) as begin from customers", "customers")
def f11_userprio_report(customers):
    return accounting.userprio(customers, "pool").select("name", "resources_used", "weighted", "begin")


@query("""with r as (select name, ResourcesUsed, WeightedResourcesUsed, nullif(LastUsageTime, 0) as l from customers),
u as (select * from r union all select regexp_replace(name, '\\.[^.]*$', ''), ResourcesUsed, WeightedResourcesUsed, l from r where name not like '%@%' and name like '%.%')
select name, cast(sum(ResourcesUsed) as bigint) as resources_used, cast(sum(cast(WeightedResourcesUsed as decimal(28,6))) as double) as weighted, max(l) as last from u group by name""", "customers")
def f11_userprio_rollup(customers):
    return accounting.userprio(customers, "pool", rollup=True).select("name", "resources_used", "weighted", "last")


@query("select name, name not like '%@%' as IsAccountingGroup, ResourcesUsed from customers where name not like '%@%' or ResourcesUsed > 0", "customers")
def f12_accounting_ads(customers):
    return accounting.accounting_ads(customers).select("name", "IsAccountingGroup", "ResourcesUsed")


@query("select cast(row_number() over (order by key, SlotWeight) as int) as n, key, SlotWeight from claims where RemoteUser = 'g4.h1.user4@pool'", "claims")
def f13_resource_list(claims):
    return accounting.resource_list(claims, "g4.h1.user4@pool").select("n", "key", "SlotWeight")


#: The ledger's name of a claim's holder.
_HOLDER = "concat('g', cast(k % 5 as string), case when k % 3 = 0 then '.h' else '' end, '.user', cast(k as string), case when k % 10 = 0 then '' when k % 7 = 0 then '@far' else '@pool' end)"
_NUMBER = "cast(regexp_extract(RemoteUser, 'user([0-9]+)@', 1) as bigint) as k"


@query(f"""with c as (select *, {_NUMBER} from claims), s as (
  select {_HOLDER} as name, 1 as n, SlotWeight as w, 1010000 - StartTime as t from c
  union all select {_HOLDER}, -1, -SlotWeight, StartTime + 500 - greatest(StartTime, 1010000) from c where StartTime % 3 = 0
), m as (select name, sum(n) as n, sum(w) as w, sum(t) as t, sum(t * abs(w)) as wt from s group by name)
select name, cast(greatest(ResourcesUsed + coalesce(n, 0), 0) as bigint) as ResourcesUsed, greatest(WeightedResourcesUsed + coalesce(w, 0), 0) as WeightedResourcesUsed,
  cast(UnchargedTime + coalesce(t, 0) as bigint) as UnchargedTime, WeightedUnchargedTime + coalesce(wt, 0) as WeightedUnchargedTime from customers left join m using (name)""", "customers", "claims")
def n7_charge_matches(customers, claims):
    """All claims begin, and a third end, since the last tick or before it."""
    held = claims.selectExpr("*", _NUMBER).selectExpr(f"{_HOLDER} as name", "StartTime as at", "SlotWeight as weight")
    ended = held.filter("at % 3 = 0").select("name", (F.col("at") + 500).alias("at"), F.col("at").alias("start"), "weight")
    return accounting.charge_matches(customers, held, ended, 1010000).select("name", "ResourcesUsed", "WeightedResourcesUsed", "UnchargedTime", "WeightedUnchargedTime")


@query("select name, case when ResourcesUsed > 3 then greatest(cast(ResourcesUsed - 4 as double), 1.0::double) else PriorityFactor end as PriorityFactor from customers", "customers")
def n5_set_values(customers):
    return accounting.set_values(customers, customers.filter("ResourcesUsed > 3").select("name", (F.col("ResourcesUsed") - 4).cast("double").alias("PriorityFactor"))).select("name", "PriorityFactor")


@query("select name, case when ResourcesUsed = 0 then 0.0::double else AccumulatedUsage end as AccumulatedUsage from customers", "customers")
def n6_reset_usage(customers):
    return accounting.reset_usage(customers, 5, customers.filter("ResourcesUsed = 0")).select("name", "AccumulatedUsage")


@query("select key from claims where StartTime % 3 <> 0 and StartTime % 5 <> 0 and StartTime % 7 <> 0", "claims")
def e6_stale_claims(claims):
    """Some slots are free again, some have another holder, some are gone."""
    state, holder = F.expr("case StartTime % 3 when 0 then 'Unclaimed' when 1 then 'CLAIMED' else 'Preempting' end"), F.expr("case when StartTime % 5 = 0 then concat('not.', RemoteUser) else RemoteUser end")
    live = claims.filter("StartTime % 7 <> 0").select("key", state.alias("State"), holder.alias("RemoteUser"))
    return accounting.live_resources(claims, live).select("key")


@query("""select name, AccumulatedUsage + 100 as a, case when ResourcesUsed = 5 then AccumulatedUsage + 101 end as b from customers where ResourcesUsed in (5, 6)
union all select 'new.' || name, null, AccumulatedUsage + 100 from customers where ResourcesUsed = 3""", "customers")
def e10_ledger_difference(customers):
    """The other ledger lacks some customers, has some of its own, and differs for others by much or within the tolerance."""
    left = customers.withColumn("AccumulatedUsage", F.col("AccumulatedUsage") + 100)
    usage = F.col("AccumulatedUsage") + F.expr("case ResourcesUsed when 5 then 1.0D when 4 then 1e-11D else 0.0D end")
    right = left.filter("ResourcesUsed < 6").withColumn("AccumulatedUsage", usage)
    own = left.filter("ResourcesUsed = 3").withColumn("name", F.concat(F.lit("new."), F.col("name")))
    return accounting.ledger_difference(left, right.unionByName(own), ["name"], "AccumulatedUsage")


# ---- names and limits


@query("select Name, regexp_extract(Name, '^(.*)\\.[^.]*@[^@]*$', 1) as charged, split_part(Name, '@', 2) as domain from submitters", "submitters")
def j12_charged_group(submitters):
    return submitters.select("Name", names.charged_group("Name").alias("charged"), names.domain_of("Name").alias("domain"))


@query("select Name, concat(top, '.h', cast(index % 3 as string), ',', top) as path from submitters", "submitters")
def j13_ancestors(submitters):
    return submitters.select("Name", F.array_join(names.ancestors(names.charged_group("Name")), ",").alias("path"))


@query("select key, concat(Name, '@', MyAddress) as resource, case when SlotWeight >= 0 then SlotWeight else Cpus end as weight from slots", "slots")
def c15_slot_weight(slots):
    return slots.select("key", names.resource_name("Name", "MyAddress").alias("resource"), names.slot_weight("SlotWeight", "Cpus").alias("weight"))


@query("select key, case when MatchedConcurrencyLimits = 'gpu:2, license' then 'gpu=2.0,license=1.0' when MatchedConcurrencyLimits is null then '' else 'gpu=1.0' end as limits from slots", "slots")
def j10_limit_tokens(slots):
    return slots.select("key", F.array_join(F.transform(names.limit_tokens("MatchedConcurrencyLimits"), lambda t: F.concat(t["name"], F.lit("="), t["weight"].cast("string"))), ",").alias("limits"))


@query("select DesiredArch, case when DesiredArch like '%1' then 3.0::double else 10.0::double end as most from requests group by 1", "requests")
def j11_limit_max(requests):
    name = F.when(F.col("DesiredArch").endswith("1"), "gpu").otherwise("other")
    return requests.select("DesiredArch").distinct().select("DesiredArch", names.limit_max(name, {"GPU_LIMIT": 3, "CONCURRENCY_LIMIT_DEFAULT": 10}).alias("most"))


# ---- slots, submitters, pool


@query("select Name from submitters where ScheddIpAddr <> '' and not SkipMatchmaking and IdleJobs + RunningJobs > 0", "submitters")
def d7_kept_submitters(submitters):
    return matching.kept_submitters(submitters).select("Name")


@query("select key from slots where State not in ('Claimed', 'Preempting') or PartitionableSlot", "slots")
def d8_trimmed_slots(slots):
    return matching.trimmed_slots(slots, preemption=False).select("key")


@query("select key from slots where not RetirementTimeRemaining > 0", "slots")
def d8_trimmed_for_preemption(slots):
    return matching.trimmed_slots(slots, preemption=True).select("key")


@query("select Name from submitters where IdleJobs > 0", "submitters")
def d9_idle_submitters(submitters):
    return store.matching(submitters, "IdleJobs > 0").select("Name")


@query("select Name from submitters where floor > 0 and usage < floor", "submitters")
def d10_below_floor(submitters):
    return store.matching(submitters, "floor > 0 && usage < floor").select("Name")


@query("select key, Cpus as SlotWeight, 0 as MachineMatchCount, case when Cpus > 9 then 'neg' else 'own' end as Requirements, case when Cpus > 9 then 'own' end as SavedRequirements, ClaimId from slots", "slots")
def c10_fixed_slots(slots):
    asked = slots.drop("SlotWeight").withColumns({"Requirements": F.lit("own"), "NegotiatorRequirements": F.expr("case when Cpus > 9 then 'neg' end"), "RemoteAdmin": F.lit("secret"), "OfflineMatches": F.lit(1)})
    fixed = matching.fixed_slots(asked, admin=("remoteadmin",)).withColumn("SlotWeight", F.col("SlotWeight").cast("long"))
    return fixed.select("key", "MachineMatchCount", *(c for c in fixed.columns if c not in asked.columns and c != "MachineMatchCount" or c in ("RemoteAdmin", "OfflineMatches", "NegotiatorRequirements", "Requirements", "ClaimId")))


@query("select s.key, case when Cpus > 20 then ClaimId else 'null' end as claim from slots s", "slots")
def e2_claims(slots):
    private = slots.filter("Cpus > 20").select("Name", "MyAddress", "ClaimId", F.lit(None).cast("string").alias("Capability"), F.lit(None).cast("string").alias("ClaimIdList"), F.col("ScanIndex").alias("seq"))
    return matching.with_claims(slots.drop("ClaimId"), private).select("key", "claim")


@query("select cast(sum(cast(SlotWeight as decimal(28,6))) as double) as total_weight, min(nullif(SlotWeight, 0)) as least_weight, cast(sum(case when PartitionableSlot then Cpus else 1 end) as bigint) as effective_slots from slots", "slots")
def f5_pool_size(slots):
    return matching.pool_size(slots)


@query("select key, c.ResourcesUsed as RemoteUserResourcesInUse from slots left join (select name, any_value(ResourcesUsed) as ResourcesUsed from customers group by name) c on RemoteUser = c.name", "slots", "customers")
def e8_stamped_users(slots, customers):
    ledger = customers.select("name", F.lit(1.0).alias("effective_priority"), F.lit(0).alias("floor"), F.col("ResourcesUsed").alias("resources_used"))
    return matching.stamped_users(slots, ledger).select("key", "RemoteUserResourcesInUse")


@query("select request_id, prio as SubmitterUserPrio from requests left join submitters on Owner = Name", "requests", "submitters")
def e7_enriched_requests(requests, submitters):
    return matching.enriched_requests(requests, submitters.withColumnRenamed("Name", "name")).select("request_id", "SubmitterUserPrio")


# ---- matching

_SHAPES = "select RequestCpus, RequestMemory, DesiredArch, count(*) as requests, min(request_id) as first_request from requests group by 1, 2, 3"
_PAIRS = f"(select * from ({_SHAPES}) j join slots m on lower(j.DesiredArch) = lower(m.Arch) and m.Cpus >= j.RequestCpus and m.Memory >= j.RequestMemory and m.State <> 'Owner')"
_JOB = 'TARGET.Arch == MY.DesiredArch && TARGET.Cpus >= RequestCpus && TARGET.Memory >= RequestMemory'
_SLOT = 'MY.State != "Owner"'


def _pairs(requests: DataFrame, slots: DataFrame) -> DataFrame:
    shaped = matching.shapes(requests, ["RequestCpus", "RequestMemory", "DesiredArch"])
    return matching.bilateral(shaped, slots, _JOB, _SLOT)


def _candidates(requests: DataFrame, slots: DataFrame) -> DataFrame:
    shaped = matching.shapes(requests, ["RequestCpus", "RequestMemory", "DesiredArch"])
    ranked = matching.ranked_candidates(_pairs(requests, slots), shaped, slots, rank="TARGET.Cpus - RequestCpus", post="MY.Memory / 4096")
    return ranked.withColumn("tier", F.lit(matching.NO_PREEMPTION))


@query(f"select first_request, ScanIndex from {_PAIRS}", "requests", "slots")
def e1_bilateral_match(requests, slots):
    return _pairs(requests, slots).select(F.col("j_first_request").alias("first_request"), F.col("m_ScanIndex").alias("ScanIndex"))


_ORDER = "order by Cpus - RequestCpus desc, Memory // 4096 desc, ScanIndex"


@query(f"select first_request, ScanIndex from (select *, row_number() over (partition by first_request {_ORDER}) as k from {_PAIRS}) where k = 1", "requests", "slots")
def g1_best_candidate(requests, slots):
    return matching.best_candidate(_candidates(requests, slots), "j_first_request").select(F.col("j_first_request").alias("first_request"), F.col("m_ScanIndex").alias("ScanIndex"))


@query(f"select first_request, ScanIndex, cast(row_number() over (partition by first_request {_ORDER}) as int) as place from {_PAIRS}", "requests", "slots")
def g2_candidate_order(requests, slots):
    return matching.candidate_order(_candidates(requests, slots), "j_first_request").select(F.col("j_first_request").alias("first_request"), F.col("m_ScanIndex").alias("ScanIndex"), "place")


@query(f"select first_request, ScanIndex, cast(Cpus - RequestCpus as double) as rank, cast(Memory // 4096 as double) as post_rank from {_PAIRS}", "requests", "slots")
def g3_rank_expressions(requests, slots):
    return _candidates(requests, slots).select(F.col("j_first_request").alias("first_request"), F.col("m_ScanIndex").alias("ScanIndex"), "rank", "post_rank")


@query("""select key, cast(case when RemoteUser is null then 2 when Cpus > CurrentRank then 1 when RemoteUser <> 'me' and Cpus % 2 = 0 and Cpus >= CurrentRank then 0 end as int) as tier from slots""", "slots")
def p12_preemption_tier(slots):
    me = slots.withColumn("submitter", F.lit("me"))
    return me.select("key", matching.tier("RemoteUser", "submitter", F.col("Cpus").cast("double"), F.col("CurrentRank"), F.col("Cpus") % 2 == 0).alias("tier"))


@query("select key, SlotWeight + usage <= 30 or usage <= 0 as ok from (select *, cast(Cpus % 3 as double) as usage from slots)", "slots")
def p13_limit_permit(slots):
    return slots.withColumns({"usage": (F.col("Cpus") % 3).cast("double"), "allowed": F.lit(30.0)}).select("key", matching.permitted("usage", "SlotWeight", "allowed").alias("ok"))


@query("select request_id from requests where coalesce(ConcurrencyLimits, '') <> 'license:3'", "requests")
def p11_concurrency_gate(requests):
    spark = requests.sparkSession
    counts = spark.createDataFrame([("gpu", 4.0), ("license", 6.0)], "name string, in_use double")
    return matching.concurrency_open(requests, counts, spark.createDataFrame([("gpu", 8.0), ("license", 8.0)], "name string, most double")).select("request_id")


@query("select State as \"group\", case when count(*) filter (Cpus < 3) > 0 then 'concurrency limit reached' when count(*) filter (Cpus % 2 = 0) > 0 then 'insufficient priority' else 'no match found' end as reason from slots group by State", "slots")
def f16_reject_reason(slots):
    why = F.when(F.col("Cpus") < 3, "concurrency").when(F.col("Cpus") % 2 == 0, "policy")
    return matching.reject_reasons(slots.select(F.col("State").alias("group"), why.alias("why")), "group").select("group", "reason")


@query("select Name, cast(row_number() over (partition by top order by prio, case when floor > 0 then usage / floor else 3.4028234663852886e38 end, LastHeardFrom % 1009, index) as int) as turn from submitters", "submitters")
def g4_submitter_order(submitters):
    ranked = submitters.withColumn("starvation", names.starvation("usage", "floor"))
    return store.ranked(ranked, ["top"], negotiation.submitter_order(submitters), "turn").select("Name", "turn")


@query("select RequestCpus, RequestMemory, DesiredArch, count(*) as requests, min(request_id) as first_request from requests group by 1, 2, 3", "requests")
def c17_shapes(requests):
    wanted = matching.significant_attributes([_JOB, _SLOT, "CurrentTime > 0 && Slot1_Foo > 1"], requests.columns, always=())
    columns = [c for c in requests.columns if c.lower() in wanted] + ["RequestCpus", "RequestMemory", "DesiredArch"]
    return matching.shapes(requests, list(dict.fromkeys(columns)))


# ---- groups


def _config() -> list[dict]:
    top = [{"name": f"g{i}", "quota": 100.0 * (i + 1), "static": i % 2 == 0, "accept_surplus": i > 2} for i in range(5)]
    return [{**g, "quota": g["quota"] if g["static"] else 0.25} for g in top] + [{"name": f"g{i}.h{j}", "quota": 0.25, "static": False} for i in range(5) for j in range(2)]


@query("select Name as name, case when index % 3 < 2 then concat(top, '.h', cast(index % 3 as string)) else top end as \"group\" from submitters", "submitters")
def e4_group_assignment(submitters):
    known = groups.group_table(submitters.sparkSession, _config())
    return groups.negotiating_group(submitters.select(F.col("Name").alias("name")), known)


@query("""with g as (select 'g' || i as name, i % 2 = 0 as s, case when i % 2 = 0 then 100.0::double * (i + 1) else 0.25::double end as c from range(5) t(i)),
q as (select name, case when s then c * least(900.0::double, 2000.0::double) / 900.0::double else c * (2000.0::double - 900.0::double) / greatest(0.5::double, 1.0::double) end as subtree_quota from g)
select name, subtree_quota - 2 * 0.25::double * subtree_quota as quota, subtree_quota from q union all select name || '.h' || j, 0.25::double * subtree_quota, 0.25::double * subtree_quota from q, range(2) t(j)
union all select '<none>', 2000.0::double - sum(subtree_quota), 2000.0::double from q""")
def p6_quota_assign(spark, sf_dir):
    return groups.assign_quotas(groups.group_table(spark, _config()), 2000.0).select("name", "quota", "subtree_quota")


@query(None)
def p7_fair_share(spark, sf_dir):
    submitters = view(spark, sf_dir, "submitters")
    known = groups.group_table(spark, _config())
    demand = accounting.group_demand(groups.negotiating_group(submitters.withColumnRenamed("Name", "name"), known)).withColumnRenamed("group", "name")
    quotas = groups.assign_quotas(known, 2000.0).join(demand, "name", "left").na.fill(0.0, ["requested"])
    root = groups.collected(quotas)
    groups.fair_share(root)
    return spark.createDataFrame([(n.name, float(n.allocated), float(n.quota)) for n in root.walk()], "name string, allocated double, quota double")


@query(None)
def p15_negotiation(spark, sf_dir):
    requests, slots = view(spark, sf_dir, "requests"), view(spark, sf_dir, "slots")
    return negotiation.negotiate(*_sites(requests, slots, view(spark, sf_dir, "submitters")))


def _sites(requests: DataFrame, slots: DataFrame, submitters: DataFrame):
    """Requests, candidates and limits of ten sites; a slot belongs to one site, a submitter to one."""
    keys = ["RequestCpus", "RequestMemory", "DesiredArch"]
    shaped = matching.shapes(requests, keys).select(*keys, F.col("first_request").alias("shape"))
    asked = requests.join(shaped, keys).select(F.concat(F.lit("s"), F.col("SitePick").cast("string")).alias("site"), "request_id", F.col("Owner").alias("submitter"), "shape", F.col("Count").alias("count"))
    ranked = matching.candidate_order(_candidates(requests, slots), "j_first_request")
    offered = ranked.select(F.concat(F.lit("s"), (F.col("m_ScanIndex") % 10).cast("string")).alias("site"), F.col("j_first_request").alias("shape"), "place", F.col("m_ScanIndex").alias("slot"), F.col("m_SlotWeight").alias("cost"), F.col("m_PartitionableSlot").alias("partitionable"))
    limits = accounting.submitter_limits(submitters.withColumnRenamed("Name", "name"), 20000.0).withColumn("site", F.concat(F.lit("s"), (F.col("index") % 10).cast("string")))
    limits = store.ranked(limits.withColumn("starvation", names.starvation("usage", "submitter_limit")), ["site"], negotiation.submitter_order(limits), "turn")
    return asked, offered, limits.select("site", F.col("name").alias("submitter"), "turn", "submitter_limit", "headroom")


@query(None)
def f15_cycle_stats(spark, sf_dir):
    return negotiation.cycle_stats(p15_negotiation(spark, sf_dir))


# ---- sources


@query("select cast(range as bigint) as id from range(1000)")
def a17_synthetic_pool(spark, sf_dir):
    return synthetic.slots(spark, 1000).select(F.col("ScanIndex").alias("id"))


@query("""select 1 as tbl, cast(key as string) as key, arg_max(State, seq) as value from updates where not (seq <= coalesce(dead, 0)) group by key""".replace("from updates where", "from (select u.*, (select max(seq) from updates d where d.key = u.key and d.seq % 10 = 0) as dead from updates u where seq % 10 <> 0) where"), "updates")
def a15_ledger_replay(updates):
    log = updates.select(F.when(F.col("seq") % 10 == 0, "del").otherwise("set").alias("op"), F.lit(1).alias("tbl"), F.col("key").cast("string").alias("key"), F.lit("State").alias("attr"), F.lit("s").alias("kind"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("f"), F.col("State").alias("s"), F.col("seq").alias("n"))
    return ledger_log.replayed(log).select("tbl", "key", "value")


@query("select cast(key as string) as key, arg_max(State, seq) as value from updates where seq % 4 <> 2 group by key", "updates")
def a16_journal_import(updates):
    """Every update is a transaction; those of each fourth don't end."""
    quoted = F.concat(F.lit('103 Customer.'), F.col("key").cast("string"), F.lit(' State "'), F.col("State"), F.lit('"'))
    parts = F.when(F.col("seq") % 4 == 2, F.array(F.lit("105"), quoted)).otherwise(F.array(F.lit("105"), quoted, F.lit("106")))
    lines = updates.select("seq", F.posexplode(parts).alias("p", "line")).select((F.col("seq") * 3 + F.col("p")).alias("n"), "line")
    return ledger_log.journal_records(ledger_log.import_journal(lines)).select("key", "value")


# ---- more of the ledger, queries and shaping


@query("select key, case when State in ('Claimed') and RemoteUser is not null then true else false end as claimed from slots", "slots")
def d15_claimed_test(slots):
    return slots.select("key", (F.lower("State").isin("claimed", "preempting") & F.col("RemoteUser").isNotNull()).alias("claimed"))


@query("select Name from submitters where Name <> '' and ScheddName <> '' and ScheddIpAddr <> ''", "submitters")
def d11_wrappable_submitters(submitters):
    return store.matching(submitters, 'Name != "" && ScheddName != "" && ScheddIpAddr != ""').select("Name")


@query("select request_id from requests where RequestCpus <= 4", "requests")
def d12_job_constraint(requests):
    return store.matching(requests, "RequestCpus <= 4").select("request_id")


@query("select name, IsAccountingGroup, ResourcesUsed from (select name, name not like '%@%' as IsAccountingGroup, ResourcesUsed from customers) where ResourcesUsed > 3 order by name limit 20", "customers")
def d14_negotiator_query(customers):
    ads = accounting.accounting_ads(customers).select("name", "IsAccountingGroup", "ResourcesUsed")
    return store.run_query(ads, store.Query("ResourcesUsed > 3", limit=20), order=["name"])


@query("select Name from slots where Cpus > 10 and State = 'Unclaimed' union all select Name from submitters where IdleJobs > 2", "slots", "submitters")
def a18_snapshot(slots, submitters):
    """A cycle's snapshot under its slot and submitter constraints."""
    one = store.matching(slots, 'Cpus > 10 && State == "Unclaimed"').select("Name")
    return one.unionByName(store.matching(submitters, "IdleJobs > 2").select("Name"))


@query("select Name, 2 as n, concat('<10.0.0.1:9618?a=b c>|', ScheddName) as listed from submitters", "submitters")
def a20_address_list(submitters):
    found = names.addresses(F.concat(F.lit("<10.0.0.1:9618?a=b c>, "), F.col("ScheddName")))
    return submitters.select("Name", F.size(found).alias("n"), F.array_join(found, "|").alias("listed"))


@query("select request_id, greatest(coalesce(Count - request_id % 3, 1), 1) as Count from requests", "requests")
def a21_request_count(requests):
    return requests.select("request_id", F.greatest(F.coalesce(F.col("Count") - F.col("request_id") % 3, F.lit(1)), F.lit(1)).alias("Count"))


@query("select request_id, copy from (select request_id, unnest(range(request_id % 3 + 1)) as copy from requests)", "requests")
def i3_flattened_requests(requests):
    return requests.select("request_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("request_id") % 3)).alias("copy"))


@query("select key, coalesce(nullif(case when ScanIndex % 3 = 0 then ClaimId else '' end, ''), nullif(case when ScanIndex % 3 = 1 then 'cap' end, ''), 'list-1') as claim from slots", "slots")
def c16_claim_id(slots):
    by = F.col("ScanIndex") % 3
    return slots.select("key", names.claim_id(F.when(by == 0, F.col("ClaimId")).otherwise(""), F.when(by == 1, "cap"), F.lit("list-1, list-2")).alias("claim"))


@query("select key, case when ScanIndex % 3 = 0 then 'group' when RemoteUser is not null then RemoteUser end as holder from slots", "slots")
def c14_remote_user(slots):
    return slots.select("key", names.remote_user(F.lit(""), F.when(F.col("ScanIndex") % 3 == 0, "group"), "RemoteUser").alias("holder"))


@query("select key, Cpus * 2 as NegotiatorMatchExprTwice, State = 'Claimed' as NegotiatorMatchExprHeld, case when RemoteUser is not null then split_part(RemoteUser, '.', 1) end as RemoteGroup from slots", "slots")
def c12_match_ads(slots):
    out = matching.match_ads(slots, {"Twice": "Cpus * 2", "Held": 'State == "Claimed"'}, slots)
    return out.select("key", "NegotiatorMatchExprTwice", "NegotiatorMatchExprHeld", "RemoteGroup")


@query("select key, 'Cpus,MyType' as kept from slots", "slots")
def c4_map_projection(slots):
    attrs = ad_text.attributes(ad_text.written(slots.select("MyType", "Name", "Cpus")))
    kept = store.projected_map(attrs, ["CPUS"])
    return slots.select("key", F.array_join(F.array_sort(F.transform(F.map_keys(kept), lambda k: F.when(k == "cpus", "Cpus").otherwise("MyType"))), ",").alias("kept"))


@query("select key, Name from slots", "slots")
def c9_name_from_text(slots):
    return _as_text(slots).select("key", ad_text.name_in_text(F.col("text")).alias("Name"))


@query("select count(*) as good, 5 as bad from slots", "slots")
def a9_good_and_bad(slots):
    texts = _as_text(slots).select("text")
    bad = slots.filter("ScanIndex < 5").select(F.lit("Cpus = 4\nnonsense").alias("text"))
    good, refused = ad_text.parsed_updates(texts.unionByName(bad))
    return good.agg(F.count("*").alias("good")).withColumn("bad", F.lit(refused.count()).cast("int"))


@query("select name, cast(coalesce(w, 0) as double) as WeightedResourcesUsed from customers left join (select RemoteUser, sum(cast(SlotWeight as decimal(28,6))) as w from claims group by 1) on RemoteUser = name", "customers", "claims")
def f2_rebuilt_usage(customers, claims):
    return accounting.rebuilt_usage(customers, claims).select("name", "WeightedResourcesUsed")


@query("select name, greatest(ResourcesUsed - 2, 0) as ResourcesUsed from customers", "customers")
def n8_remove_matches(customers):
    two = customers.select("name", F.explode(F.array(F.lit(1100000), F.lit(1200000))).alias("at")).withColumns({"start": F.lit(1000000), "weight": F.lit(1.0)})
    # names repeat in the ledger's view: one record each
    two = two.dropDuplicates(["name", "at"])
    return accounting.charge_matches(customers, two.limit(0).select("name", "at", "weight"), two, 1000000).select("name", "ResourcesUsed")


@query("with p as (select Name, case when index % 3 <> 0 then prio else 500.0::double end as priority from submitters) select * from p where priority = (select min(priority) from p)", "submitters")
def e5_submitter_ledger(submitters):
    ledger = submitters.filter("index % 3 <> 0").select("Name", F.col("prio").alias("priority"))
    joined = matching.with_priority(submitters.select("Name"), ledger)
    least = joined.agg(F.min("priority").alias("least"))
    return joined.join(F.broadcast(least), F.col("priority") == F.col("least")).select("Name", "priority")


@query("select ScheddName, count(distinct Name) as submitters from submitters group by ScheddName", "submitters")
def f15_distinct_submitters(submitters):
    return submitters.groupBy("ScheddName").agg(F.countDistinct("Name").alias("submitters"))


@query("select seq, cast(row_number() over (order by seq desc) as int) - 1 as n, seq - lag(seq) over (order by seq) as period from updates qualify row_number() over (order by seq desc) <= 3", "updates")
def f17_stats_ring(updates):
    """The newest cycles of a log, numbered from 0, with the gap to the one before."""
    newest = updates.select("seq", F.lit("negotiator").alias("name")).orderBy(F.desc("seq")).limit(4)
    ranked = store.ranked(newest, ["name"], [F.desc("seq")], "k").withColumn("before", F.max("seq").over(_before()))
    return ranked.filter("k <= 3").select("seq", (F.col("k") - 1).alias("n"), (F.col("seq") - F.col("before")).alias("period"))


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("name").orderBy("seq").rowsBetween(-1, -1)


@query("select key, floor(0.5 + Cpus / 4.0) as rounded, abs(Cpus - Memory / 1024) <= 1e-9 as near from slots", "slots")
def j19_rounding(slots):
    return slots.select("key", names.round_half_up(F.col("Cpus") / 4.0).alias("rounded"), names.close_to("Cpus", F.col("Memory") / 1024).alias("near"))


@query("select Name, case when floor > 0 then usage / floor else 3.4028234663852886e38 end as starvation from submitters", "submitters")
def j21_starvation(submitters):
    return submitters.select("Name", names.starvation("usage", "floor").alias("starvation"))


@query("""with g as (select '<none>' as name, 0::double as own union all select 'g' || i, i::double from range(5) t(i) union all select 'g' || i || '.h' || j, (10 + j)::double from range(5) t(i), range(2) u(j))
select a.name, sum(b.own) as total from g a join g b on a.name = '<none>' or b.name = a.name or starts_with(b.name, a.name || '.') group by a.name""")
def f10_subtree_sums(spark, sf_dir):
    own = F.when(F.col("name") == names.ROOT_GROUP, 0.0).when(F.col("depth") == 1, F.substr("name", F.lit(2)).try_cast("double")).otherwise(10 + F.substr("name", F.lit(5)).try_cast("double"))
    table = groups.group_table(spark, _config()).withColumn("own", own)
    return groups.subtree_sums(table, "own", "total").select("name", "total")


def expression_columns(df: DataFrame, **texts: str) -> DataFrame:
    compiler = Compiler(attributes(df))
    return df.select(*(compiler(t)[0].alias(n) for n, t in texts.items()))


@query("select Name as n, Cpus // 3 as third, Memory % 1000 as rest, case when Cpus > 25 then Cpus * 10 else Memory end as pick, concat(State, '-', cast(Cpus as string)) as tag, CurrentRank is null as unset, coalesce(CurrentRank, -1.0) as ranked from slots", "slots")
def j4_expression_functions(slots):
    return expression_columns(slots, n="Name", third="Cpus / 3", rest="Memory % 1000", pick="ifThenElse(Cpus > 25, Cpus * 10, Memory)", tag='strcat(State, "-", Cpus)', unset="CurrentRank =?= undefined", ranked="CurrentRank ?: -1.0")
