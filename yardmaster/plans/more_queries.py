"""Queries that write and read again, stream, or walk the group tree; see `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import accounting, groups, matching, negotiation, store
from ..session import shared_folder
from ..sources import ad_text, ledger_log
from ..streaming import changes
from .queries import _candidates, _config, p15_negotiation, query
from .views import view


@query("select key, State, Cpus from slots where Cpus > 8", "slots")
def a8_durable_upsert(slots):
    """The batch is written before it counts as stored."""
    path = shared_folder(slots.sparkSession, "ads")
    store.write_table(slots, path)
    return slots.sparkSession.read.parquet(path).filter("Cpus > 8").select("key", "State", "Cpus")


@query("select key from slots where not (1000001500 - LastHeardFrom > coalesce(AdLifetime, 900))", "slots")
def a24_restart_reload(slots):
    path = shared_folder(slots.sparkSession, "ads")
    store.write_table(slots, path)
    return store.expire(slots.sparkSession.read.parquet(path), 1000001500).select("key")


@query("select Name, Cpus from slots", "slots")
def a13_text_file_source(slots):
    path = shared_folder(slots.sparkSession, "pool")
    blocks = slots.select(ad_text.written(slots.select("MyType", "Name", "Cpus")).alias("value"))
    blocks.write.option("lineSep", "\n\n").text(path)
    good, _ = ad_text.parsed_updates(ad_text.read_ad_text(slots.sparkSession, path))
    return good.select(F.col("name").alias("Name"), ad_text.text_value(F.col("attrs"), "Cpus").cast("long").alias("Cpus"))


@query("select cast(key as string) as key, count(*) as changes, max(seq) as last from updates group by key", "updates")
def b8_ledger_append(updates):
    spark, path = updates.sparkSession, shared_folder(updates.sparkSession, "ledger")
    rows = updates.select(F.lit("set").alias("op"), F.lit(1).alias("tbl"), F.col("key").cast("string").alias("key"), F.lit("State").alias("attr"), F.lit("s").alias("kind"), F.col("State").alias("s"), F.col("seq").alias("n"))
    ledger_log.append_log(rows.filter("n % 2 = 0"), path)
    ledger_log.append_log(rows.filter("n % 2 = 1"), path)
    return ledger_log.read_log(spark, path).groupBy("key").agg(F.count("*").alias("changes"), F.max("n").alias("last"))


def _log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The update log as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("State"), F.col("value").alias("Load"))


@query("select seq, cast(key as string) as key, case when m then 0 else 1 end as kind from (select *, lag(m, 1, false) over (partition by key order by seq) as was from (select *, Load > 50 and State = 'click' as m from updates)) where m or was")
def k1_stream_changes(spark, sf_dir):
    out = shared_folder(spark, "changes")
    stream = changes.stream_changes(_log_stream(spark, sf_dir), 'Load > 50 && State =?= "click"')
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("seq", "key", "kind")


@query("select key, max(seq) as seq, arg_max(State, seq) as State from updates group by key")
def k4_stream_upserts(spark, sf_dir):
    out = shared_folder(spark, "table")
    changes.upsert_stream(_log_stream(spark, sf_dir), out, shared_folder(spark, "stream")).awaitTermination()
    return changes.upserted(spark, out).select("key", "seq", "State")


@query("select count(*) as ads, min(seq) as first from (select * from updates order by seq limit 4096)")
def k10_view_fan_out(spark, sf_dir):
    one, two = shared_folder(spark, "view"), shared_folder(spark, "view")
    changes.fan_out(_log_stream(spark, sf_dir), [one, two], shared_folder(spark, "stream")).awaitTermination()
    # the views are whole; the SQL asks for the first 4096 ads of one
    return spark.read.parquet(two).orderBy("seq").limit(4096).agg(F.count("*").alias("ads"), F.min("seq").alias("first"))


@query("select key, seq from (select key, seq, row_number() over (partition by key order by coalesce(DaemonStartTime, -1) desc, seq desc) as k from updates) where k = 1", "updates")
def k7_version_order(updates):
    """Late rows: by version where the option asks for it, not by arrival."""
    return store.latest(updates.withColumn("version", F.coalesce("DaemonStartTime", F.lit(-1))), order=["version", "seq"]).select("key", "seq")


@query("select case when 9000 > 8192 then 4 else 0 end as kind, max(seq) as cursor from updates", "updates")
def k3_resync(updates):
    return updates.agg(F.max("seq").alias("cursor")).select(F.lit(changes.resume_point(8192, 9000)).alias("kind"), "cursor")


@query("select Name, idle + 1 as waiting from (select Name, IdleJobs as idle from submitters where Name like 'g1.%')", "submitters")
def c1_projection_and_expression(submitters):
    wanted = store.projection_list("Name,\tIdleJobs\n")
    found = store.run_query(submitters, store.Query('regexp("^g1\\\\.", Name)', tuple(wanted)))
    return found.select("Name", (F.col("IdleJobs") + 1).alias("waiting"))


@query("select key, State = 'Claimed' and ScanIndex % 3 <> 0 as held from slots", "slots")
def d16_still_claimed(slots):
    customer = F.expr("concat(case when ScanIndex % 3 = 0 then 'x' else 'g' end, cast(ScanIndex % 5 as string), '.user', cast(ScanIndex % 50 as string), '@pool')")
    return accounting.still_claimed(slots, customer).select("key", "held")


@query("""with g as (select 'g' || i as name, i as n from range(5) t(i))
select name, cast(row_number() over (order by n % 3, n) as int) as place from g""")
def g5_group_order(spark, sf_dir):
    """By the sort expression, then in configured order."""
    top = groups.group_table(spark, _config()).filter("depth = 1").withColumn("n", F.substr("name", F.lit(2)).try_cast("long"))
    return store.ranked(top, ["parent"], [F.col("n") % 3, F.col("n")], "place").select("name", "place")


@query("""with g as (select 'g' || i as name, i as n from range(5) t(i))
select name, cast(row_number() over (order by n % 2, n desc) as int) as turn from g""")
def g6_round_robin_order(spark, sf_dir):
    """Who was served longest ago, then the larger quota."""
    top = groups.group_table(spark, _config()).filter("depth = 1").withColumn("n", F.substr("name", F.lit(2)).try_cast("long"))
    return store.ranked(top.withColumn("rr_time", F.col("n") % 2), ["parent"], ["rr_time", F.desc("n")], "turn").select("name", "turn")


@query("select Name, path, depth from (select Name, unnest([concat(top, '.h', cast(index % 3 as string)), top]) as path, unnest([2, 1]) as depth from submitters)", "submitters")
def e9_ancestors(submitters):
    up = submitters.select("Name", F.posexplode(names.ancestors(names.charged_group("Name"))).alias("n", "path"))
    return up.select("Name", "path", F.size(F.split("path", r"\.")).alias("depth"))


@query("""with c as (select 'g' || i as name, 100.0::double * (i + 1) as cap from range(5) t(i)),
u as (select top, top || '.h' || cast(index % 3 as string) as node, cast(sum(usage) as double) as used from submitters group by 1, 2),
s as (select top, sum(used) as used from u group by 1)
select node, least(50.0::double, greatest(0.0::double, cap - s.used)) as slots from u join s on u.top = s.top join c on c.name = u.top""", "submitters")
def p9_strict_cap(submitters):
    """What each group may still take under the groups above it that accept no surplus."""
    used = submitters.groupBy(names.charged_group("Name").alias("node")).agg(accounting.exact_sum("usage").alias("used"))
    caps = submitters.sparkSession.createDataFrame([(f"g{i}", 100.0 * (i + 1)) for i in range(5)], "group string, cap double")
    return accounting.strict_caps(used, F.broadcast(caps), 50.0)


@query("select Name, case when index % 2 = 0 then '<none>' else top end as \"group\" from submitters union all select Name, top from submitters where index % 2 = 0", "submitters")
def p19_autoregroup(submitters):
    """Submitters of regrouping groups negotiate in the root, too."""
    own = submitters.select("Name", F.col("top").alias("group"), "index")
    return matching.autoregrouped(own, F.col("index") % 2 == 0).select("Name", "group")


@query("select Name, case when coalesce(ceiling, -1) < 0 then null else ceiling end as ceiling, floor from submitters", "submitters")
def j22_normalized_bounds(submitters):
    return submitters.select("Name", F.when(F.coalesce("ceiling", F.lit(-1)) >= 0, F.col("ceiling")).alias("ceiling"), "floor")


@query("select key from slots where not (case when Cpus > 30 then State = 'Owner' else key = 'slot1|<10.0.0.1:9618>' end)", "slots")
def n4_invalidate_command(slots):
    """By constraint where the command has one, else by key."""
    by_constraint = store.invalidate_where(slots.filter("Cpus > 30"), 'State == "Owner"')
    key = slots.sparkSession.createDataFrame([("slot1|<10.0.0.1:9618>",)], "key string")
    return by_constraint.unionByName(store.invalidate_keys(slots.filter("Cpus <= 30"), key)).select("key")


@query("select RequestCpus, count(*) as pairs, cast(sum(rank) as double) as ranks from (select j.RequestCpus, cast(m.Cpus - j.RequestCpus as double) as rank from (select RequestCpus, RequestMemory, DesiredArch from requests group by 1, 2, 3) j join slots m on lower(j.DesiredArch) = lower(m.Arch) and m.Cpus >= j.RequestCpus and m.Memory >= j.RequestMemory and m.State <> 'Owner') group by 1", "requests", "slots")
def e1_match_summary(requests, slots):
    return _candidates(requests, slots).groupBy(F.col("j_RequestCpus").alias("RequestCpus")).agg(F.count("*").alias("pairs"), F.sum("rank").alias("ranks"))


@query(None)
def b5_match_delivery(spark, sf_dir):
    return negotiation.match_records(p15_negotiation(spark, sf_dir))[0]


@query(None)
def b6_reject_delivery(spark, sf_dir):
    return negotiation.match_records(p15_negotiation(spark, sf_dir))[1]


@query(None)
def p10_group_rounds(spark, sf_dir):
    """Groups' shares over rounds in which each uses at most what it asked for."""
    known = groups.group_table(spark, _config())
    demand = accounting.group_demand(groups.negotiating_group(view(spark, sf_dir, "submitters").withColumnRenamed("Name", "name"), known)).withColumnRenamed("group", "name")
    root = groups.collected(groups.assign_quotas(known, 2000.0).join(demand, "name", "left").na.fill(0.0, ["requested"]))
    asked = {n.name: n.requested for n in root.walk()}
    groups.group_rounds(root, 2000.0, lambda name, slots: min(slots, asked[name]))
    return spark.createDataFrame([(n.name, float(n.usage), float(n.allocated)) for n in root.walk()], "name string, usage double, allocated double")


@query(None)
def p8_whole_slots(spark, sf_dir):
    root = groups.collected(groups.assign_quotas(groups.group_table(spark, [{"name": n, "quota": q, "static": False, "accept_surplus": True} for n, q in (("a", 0.5), ("b", 0.25), ("c", 0.25))]), 10.0))
    for n in root.children:
        n.requested = 100.0
    left = groups.fair_share(root)
    groups.whole_slots(root, left)
    return spark.createDataFrame([(n.name, float(n.allocated)) for n in root.children], "name string, slots double")


def tiers_by_state(slots: DataFrame) -> DataFrame:
    """How many candidates each tier has in each state."""
    me = slots.withColumn("submitter", F.lit("me"))
    return me.groupBy("State", matching.tier("RemoteUser", "submitter", F.col("Cpus").cast("double"), F.col("CurrentRank"), F.lit(True)).alias("tier")).agg(F.count("*").alias("slots"))


@query("select State, cast(case when RemoteUser is null then 2 when Cpus > CurrentRank then 1 when Cpus >= CurrentRank then 0 end as int) as tier, count(*) as slots from slots group by 1, 2", "slots")
def p12_tier_counts(slots):
    return tiers_by_state(slots)


@query("select key, lead_seq - seq as gap from (select key, seq, lead(seq) over (partition by key order by seq) as lead_seq from updates) where lead_seq is not null", "updates")
def f17_periods(updates):
    """The gap between consecutive cycles of each negotiator."""
    gap = F.lead("seq").over(Window.partitionBy("key").orderBy("seq")) - F.col("seq")
    return updates.select("key", gap.alias("gap")).filter("gap is not null")
