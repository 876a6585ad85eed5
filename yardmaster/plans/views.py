"""The pool's tables as views over the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "slots": """
select p_partkey as ScanIndex, concat('slot', cast(p_partkey as string)) as Name, concat('<10.0.0.', cast(p_partkey % 250 as string), ':9618>') as MyAddress,
  concat('slot', cast(p_partkey as string), '|<10.0.0.', cast(p_partkey % 250 as string), ':9618>') as key, 'Machine' as MyType, p_type as OpSys, p_brand as Arch,
  cast(p_size as bigint) as Cpus, cast(p_size as bigint) * 1024 as Memory, cast(p_size as double) as SlotWeight,
  case p_partkey % 4 when 0 then 'Claimed' when 1 then 'Owner' else 'Unclaimed' end as State, p_partkey % 5 = 0 as PartitionableSlot,
  case when p_partkey % 4 = 0 then concat('g', cast(p_partkey % 5 as string), '.user', cast(p_partkey % 50 as string), '@pool') end as RemoteUser,
  case when p_partkey % 4 = 0 then cast(p_partkey % 10 as double) end as CurrentRank, concat('claim#', cast(p_partkey as string)) as ClaimId,
  1000000000 + p_partkey % 3000 as LastHeardFrom, case when p_partkey % 7 = 0 then cast(600 as bigint) end as AdLifetime, p_partkey % 100 - 50 as RetirementTimeRemaining,
  case p_partkey % 3 when 0 then 'gpu:2, license' when 1 then 'GPU, 1bad' end as MatchedConcurrencyLimits
from {part}""",
    "submitters": """
select c_custkey as index, concat('g', cast(c_custkey % 5 as string), '.h', cast(c_custkey % 3 as string), '.user', cast(c_custkey as string), '@pool') as Name,
  concat('schedd', cast(c_custkey % 20 as string)) as ScheddName, case when c_custkey % 11 = 0 then '' else concat('<10.1.0.', cast(c_custkey % 20 as string), ':9618>') end as ScheddIpAddr,
  coalesce(idle, 0) as IdleJobs, coalesce(running, 0) as RunningJobs, case when c_custkey % 2 = 0 then cast(coalesce(idle, 0) as double) * 2 end as WeightedIdleJobs,
  cast(null as double) as WeightedRunningJobs, c_custkey % 13 = 0 as SkipMatchmaking, 1000000000 + c_custkey % 5000 as LastHeardFrom, 'Submitter' as MyType,
  cast(500 + c_custkey % 40 * 25 as double) as prio, cast(c_custkey % 6 as double) as usage, cast(c_custkey % 4 as double) as floor, c_custkey % 9 - 1 as ceiling,
  concat('g', cast(c_custkey % 5 as string)) as top
from {customer} left join (
  select o_custkey, cast(sum(case when o_orderstatus = 'O' then 1 else 0 end) as bigint) as idle, cast(sum(case when o_orderstatus = 'P' then 1 else 0 end) as bigint) as running from {orders} group by o_custkey
) on c_custkey = o_custkey""",
    "requests": """
select o_orderkey as request_id, concat('g', cast(o_custkey % 5 as string), '.h', cast(o_custkey % 3 as string), '.user', cast(o_custkey as string), '@pool') as Owner,
  o_orderkey % 8 + 1 as RequestCpus, (o_orderkey % 8 + 1) * 2048 as RequestMemory, concat('Brand#', cast(o_orderkey % 5 + 1 as string), cast(o_orderkey % 3 + 1 as string)) as DesiredArch,
  o_orderkey % 120 as AutoClusterId, cast(1 as bigint) as Count, case o_orderkey % 4 when 0 then 'gpu' when 1 then 'license:3' end as ConcurrencyLimits, o_custkey % 10 as SitePick
from {orders} where o_orderstatus = 'O'""",
    "claims": """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as key, concat('g', cast(o_custkey % 5 as string), '.h', cast(o_custkey % 3 as string), '.user', cast(o_custkey as string), '@pool') as RemoteUser,
  l_quantity as SlotWeight, 1000000 + l_orderkey * 10 + l_linenumber as StartTime, case l_linenumber % 3 when 0 then 'gpu:2, license' when 1 then 'GPU, grp.gpu:3, 1bad' end as MatchedConcurrencyLimits
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "updates": """
select user_id as key, event_id as seq, event_type as State, value as Load, 1000000 + event_id as LastHeardFrom,
  case when event_id % 3 = 0 then null else event_id % 17 end as DaemonStartTime, case when event_id % 5 = 0 then null else event_id % 101 end as UpdateSequenceNumber
from {events}""",
    "customers": """
select concat('g', cast(c_custkey % 5 as string), case when c_custkey % 3 = 0 then '.h' else '' end, '.user', cast(c_custkey as string), case when c_custkey % 10 = 0 then '' when c_custkey % 7 = 0 then '@far' else '@pool' end) as name,
  cast(c_custkey % 100 as double) / 8 as Priority, case when c_custkey % 4 = 0 then cast(c_custkey % 30 as double) end as PriorityFactor, c_custkey % 7 as ResourcesUsed,
  cast(c_custkey % 7 as double) * 2 as WeightedResourcesUsed, cast(0 as double) as HierWeightedResourcesUsed, c_custkey % 3 * 30 as UnchargedTime, cast(c_custkey % 3 as double) * 60 as WeightedUnchargedTime,
  cast(c_custkey % 5 as double) * 100 as AccumulatedUsage, cast(c_custkey % 5 as double) * 200 as WeightedAccumulatedUsage, c_custkey % 2 * 1000 as BeginUsageTime, c_custkey % 2 * 2000 as LastUsageTime
from {customer}""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = [t for t in TABLES if f"{{{t}}}" in VIEWS[name]]
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(sql: str) -> str:
    """`sql` for DuckDB, after the views that it names."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} as ({VIEWS[n].format(**{t: t for t in TABLES}).strip()})" for n in used]
    own = re.match(r"\s*with\s+(.*)", sql, re.S)
    return "with " + ",\n".join(ctes) + (",\n" + own[1] if own else "\n" + sql) if ctes else sql
