import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from yardmaster.operators import accounting, groups, matching, negotiation
from yardmaster.sources import ledger_log

LEDGER = "name string, Priority double, PriorityFactor double, ResourcesUsed long, WeightedResourcesUsed double, HierWeightedResourcesUsed double, UnchargedTime long, WeightedUnchargedTime double, AccumulatedUsage double, WeightedAccumulatedUsage double, BeginUsageTime long, LastUsageTime long"


def ledger(spark, **values):
    row = {"name": "alice@pool", "PriorityFactor": 1000.0, "ResourcesUsed": 0} | values
    return spark.createDataFrame([tuple(row.get(c.split()[0]) for c in LEDGER.split(", "))], LEDGER)


@pytest.mark.parametrize(("half_life", "dt", "start"), [(100, 100, 100), (100, 50, 100), (3600, 300, 64)])
def test_priority_decays_by_half_life(spark, half_life, dt, start):
    table = ledger(spark, Priority=float(start))
    for n in range(1, 4):
        table = accounting.decay_tick(table, 1000 + n * dt, 1000 + (n - 1) * dt, half_life)
        assert table.first().Priority == pytest.approx(max(0.5, start * 0.5 ** (n * dt / half_life)), rel=1e-9)


def test_a_match_is_charged_for_its_own_time(spark):
    match = lambda at, **x: spark.createDataFrame([{"name": "alice@pool", "at": at, "weight": 2.0, **x}])
    none = match(0, start=0).limit(0)
    one = accounting.charge_matches(ledger(spark, Priority=0.5), match(1030), none, 1000)
    assert (one.first().UnchargedTime, one.first().WeightedUnchargedTime, one.first().ResourcesUsed) == (-30, -60, 1)
    two = accounting.decay_tick(one, 1100, 1000, 100)
    assert (two.first().AccumulatedUsage, two.first().WeightedAccumulatedUsage) == (70, 140)
    three = accounting.charge_matches(two, none.select("name", "at", "weight"), match(1150, start=1030), 1100)
    assert (three.first().UnchargedTime, three.first().WeightedUnchargedTime, three.first().ResourcesUsed, three.first().WeightedResourcesUsed) == (50, 100, 0, 0)


def test_movements_are_dealt_by_name_before_they_are_summed(spark):
    """Else each task that reads them holds sums of nearly all names."""
    name = F.when(F.col("id") % 3 == 0, "hot@pool").otherwise(F.concat(F.lit("u"), (F.col("id") % 50).cast("string"), F.lit("@pool")))
    started = spark.range(3000, numPartitions=6).select(name.alias("name"), (F.col("id") + 900).alias("at"), (F.col("id") % 4).cast("double").alias("weight"))
    ended = started.filter("at % 2 = 0").select("name", (F.col("at") + 500).alias("at"), F.col("at").alias("start"), "weight")
    customers = started.select("name").distinct().select("name", F.lit(5).cast("long").alias("ResourcesUsed"), *(F.lit(0.0).alias(c) for c in ("WeightedResourcesUsed", "UnchargedTime", "WeightedUnchargedTime")))
    table = accounting.charge_matches(customers, started, ended, 1000)
    got = {r.name: (r.ResourcesUsed, r.WeightedResourcesUsed, r.UnchargedTime, r.WeightedUnchargedTime) for r in table.collect()}
    want = {}
    for i in range(3000):
        at, w, x = i + 900, float(i % 4), want.setdefault("hot@pool" if i % 3 == 0 else f"u{i % 50}@pool", [5, 0.0, 0, 0.0])
        moves = [(1, w, 1000 - at)] + [(-1, -w, at + 500 - max(at, 1000))] * (at % 2 == 0)
        for n, v, t in moves:
            x[0], x[1], x[2], x[3] = x[0] + n, x[1] + v, x[2] + t, x[3] + t * w
    assert got == {k: (max(n, 0), max(w, 0.0), t, wt) for k, (n, w, t, wt) in want.items()}
    plan = table._jdf.queryExecution().executedPlan().toString()
    summed, dealt, union = plan.index("partial_sum"), plan.find("REBALANCE_PARTITIONS_BY_COL"), plan.index("Union")
    assert summed < dealt < union  # the plan's root comes first


def test_idle_forgotten_customers_are_purged(spark):
    assert accounting.decay_tick(ledger(spark, Priority=0.4, PriorityFactor=None), 2000, 1000).count() == 0
    assert accounting.decay_tick(ledger(spark, Priority=0.4), 2000, 1000).first().Priority == 0.5  # a stored factor keeps it
    assert accounting.decay_tick(ledger(spark, Priority=0.5), 1000, 2000).first().Priority == 0.5


def test_factors(spark):
    cases = [("a@pool", None, 1000), ("nice-user.a@pool", None, 1e10), ("physics.a@pool", None, 5000), ("a@far", None, 1e7), ("a", None, 1000), ("a@far", 2.0, 2), ("nice-user.a@far", None, 1e10), ("a@pool", 0.5, 1000)]
    table = spark.createDataFrame([c[:2] for c in cases], "name string, stored double")
    got = [r[0] for r in table.select(accounting.priority_factor("name", "stored", "pool", {"physics": 5000})).collect()]
    assert got == [c[2] for c in cases]


def test_limits_and_headroom(spark):
    table = spark.createDataFrame([("a", 1.0, 0.0, 0.0, -1), ("b", 3.0, 0.0, 2.0, 2), ("b", 3.0, 0.0, 2.0, 2)], "name string, prio double, usage double, floor double, ceiling long")
    got = {r.name: r for r in accounting.submitter_limits(table, 10.0).collect()}
    assert got["a"].submitter_limit == pytest.approx(7.5) and got["b"].submitter_limit == pytest.approx(2.5) and got["b"].headroom == 2 and got["a"].headroom == float("inf")
    one = accounting.submitter_limits(table.limit(1), 100.0, quota=100.0, group_usage=90.0, preemption=False).first()
    assert one.submitter_limit == one.unclaimed_limit == 10


def tree(*rows):
    """(name, quota, asked, accepts) below a root (quota, asked)."""
    root = groups.Group("<none>", *rows[0], accept_surplus=True)
    root.requested = rows[0][2]
    for name, quota, asked, accepts in rows[1:]:
        g = groups.Group(name, quota, quota, asked, config=quota, accept_surplus=accepts, parent=root)
        root.children.append(g)
    return root


def shares(root):
    groups.fair_share(root)
    return {g.name: pytest.approx(g.allocated, abs=1e-6) for g in root.walk()}


def test_surplus_goes_round():
    assert shares(tree((0, 20, 0), ("a", 10, 5, False), ("b", 10, 15, True))) == {"<none>": 0, "a": 5, "b": 15}
    assert shares(tree((0, 12, 0), ("donor", 8, 0, False), ("x", 2, 100, True), ("y", 2, 100, True))) == {"<none>": 0, "donor": 0, "x": 6, "y": 6}
    assert shares(tree((0, 10, 0), ("donor", 10, 0, False), ("z", 0, 100, True))) == {"<none>": 0, "donor": 0, "z": 10}
    assert shares(tree((6, 18, 100), ("donor", 6, 0, False), ("a", 6, 100, True))) == {"<none>": 9, "donor": 0, "a": 9}
    assert shares(tree((0, 12, 0), ("donor", 8, 0, False), ("x", 2, 100, True), ("y", 2, 100, False))) == {"<none>": 0, "donor": 0, "x": 10, "y": 2}


@pytest.mark.parametrize(
    ("config", "total", "over", "want"),
    [
        ([("a", 8, True), ("b", 4, True)], 10, False, {"a": 20 / 3, "b": 10 / 3, "<none>": 0}), ([("a", 8, True), ("b", 4, True)], 10, True, {"a": 8, "b": 4, "<none>": 0}), ([("a", 0.5, False), ("b", 0.75, False)], 10, False, {"a": 4, "b": 6, "<none>": 0}),
        ([("a", 0.3, False), ("b", 0.2, False)], 10, False, {"a": 3, "b": 2, "<none>": 5}), ([("a", 3, True), ("b", 0.5, False)], 10, False, {"a": 3, "b": 3.5, "<none>": 3.5}), ([("a", 0, True)], 10, False, {"a": 0, "<none>": 10}), ([("P", 10, True), ("P.c", 1.0, False)], 20, False, {"P": 0, "P.c": 10, "<none>": 10}),
    ],
)
def test_quotas(spark, config, total, over, want):
    table = groups.group_table(spark, [{"name": n, "quota": q, "static": s} for n, q, s in config])
    got = {r.name: pytest.approx(r.quota, abs=1e-9) for r in groups.assign_quotas(table, total, over).collect()}
    assert got == want


def test_group_configuration_and_membership(spark):
    table = groups.group_table(spark, [{"name": "a"}, {"name": "A"}, {"name": "x.y"}, {"name": "<none>"}, {"name": "a.b", "quota": 7, "static": False}])
    assert sorted(r.name for r in table.collect()) == ["<none>", "a", "a.b"] and table.filter("name = 'a.b'").first().config == 1.0
    users = spark.createDataFrame([("A.b.u@p",), ("a.zz.u@p",), ("u@p",), ("a.u@p",)], "name string")
    assert {r.name: r.group for r in groups.negotiating_group(users, table).collect()} == {"A.b.u@p": "a.b", "a.zz.u@p": "a", "u@p": "<none>", "a.u@p": "a"}


def test_strict_cap_and_rounds():
    root = tree((0, 20, 0), ("P", 10, 0, False))
    p = root.children[0]
    p.config, p.usage = 10, 5
    child = groups.Group("P.c", 10, 10, 5, 8, config=10, parent=p)
    p.children.append(child)
    assert groups.strict_limit(child, 12, lambda g: sum(x.usage for x in g.walk())) == 8
    calls = []
    root = tree((0, 10, 0), ("a", 10, 5, False))
    groups.group_rounds(root, 10, lambda name, slots: calls.append((name, slots)) or slots)
    assert calls == [("a", 5)]


def pool(spark, ranks):
    rows = [(i, *r) for i, r in enumerate(ranks)]
    return spark.createDataFrame([(1, *r, 2, 0.0) for r in rows], "j long, m_ScanIndex long, pre_rank double, rank double, post_rank double, tier int, preempt_rank double")


def test_candidate_order(spark):
    ranks = [(1.0, 0.0, 0.0), (2.0, 0.0, 0.0), (1.0, 5.0, 0.0), (1.0, 5.0, 9.0), (1.0, 5.0, 9.0), (2.0, 0.0, 0.0)]
    table = pool(spark, ranks)
    assert [r.m_ScanIndex for r in matching.candidate_order(table, "j").orderBy("place").collect()] == [1, 5, 3, 4, 2, 0]
    assert matching.best_candidate(table, "j").first().m_ScanIndex == 1


def test_two_sided_requirements(spark):
    jobs = spark.createDataFrame([(1, "jones", 4)], "request_id long, Owner string, RequestCpus long")
    slots = spark.createDataFrame([("small", 512, 8, ""), ("banned", 4096, 8, "jones"), ("few", 4096, 2, ""), ("good", 4096, 8, "")], "Name string, Memory long, Cpus long, Banned string")
    pairs = matching.bilateral(jobs, slots, "Memory >= 1024", 'Owner != Banned && TARGET.RequestCpus <= Cpus')
    assert [r.m_Name for r in pairs.collect()] == ["good"]
    texts = spark.createDataFrame([("a > 1", 1), (None, 2), ("a > 1", 3)], "e string, n int")
    assert [(t, d.count()) for t, d in matching.by_expression(texts, "e")] == [(None, 1), ("a > 1", 2)]


def test_slot_weights(spark):
    slots = spark.createDataFrame([("3.5", 9, 0), (None, 4, 0), (None, 8, 0)], "SlotWeight string, Cpus long, Gpus long")
    assert [r.SlotWeight for r in matching.fixed_slots(slots).collect()] == [3.5, 4, 8]
    assert [r.SlotWeight for r in matching.fixed_slots(slots.drop("SlotWeight"), "ifThenElse(Gpus > 0, Gpus * 10, Cpus * 2)").collect()] == [18, 8, 16]


def test_significant_attributes():
    got = matching.significant_attributes(["TARGET.Custom > 1 && CurrentTime > 0", "Slot1_Foo > 2 && Memory > 3"], ["Custom", "Slot1_Foo", "CurrentTime", "Memory", "Unseen"])
    assert got == ["custom", "memory", "rank", "requirements"]


def negotiated(spark, asks, slots, limits):
    requests = spark.createDataFrame([("s", i, who, 1, 1) for i, who in enumerate(w for w, n in asks for _ in range(n))], "site string, request_id long, submitter string, shape long, count long")
    candidates = spark.createDataFrame([("s", 1, i, i, 1.0, p) for i, p in enumerate(slots)], "site string, shape long, place int, slot long, cost double, partitionable boolean")
    turns = spark.createDataFrame([("s", i, who, most, head) for i, (who, most, head) in enumerate(limits)], "site string, turn int, submitter string, submitter_limit double, headroom double")
    rows = negotiation.negotiate(requests, candidates, turns).collect()
    count = lambda who: sum(r.slot is not None for r in rows if r.submitter == who)
    return {who: count(who) for who, _ in asks}, [r.reason for r in rows if r.slot is None]


def test_shares_limit_matches(spark):
    inf = float("inf")
    assert negotiated(spark, [("alice", 8), ("bob", 4)], [False] * 10, [("alice", 7.5, inf), ("bob", 2.5, inf)]) == ({"alice": 7, "bob": 2}, ["submitter limit exceeded"] * 2)
    assert negotiated(spark, [("alice", 3)], [True], [("alice", 5.0, inf)])[0] == {"alice": 3}
    assert negotiated(spark, [("alice", 5)], [False] * 5, [("alice", 5.0, 2.0)])[0] == {"alice": 2}
    assert negotiated(spark, [("alice", 2)], [False], [("alice", 5.0, inf)]) == ({"alice": 1}, ["no match found"])


def plain_negotiation(asks, offers, limits):
    """Matches and rejections of a site by scans of whole lists."""
    out, gone = [], set()
    for who, most in limits:
        used, refused = 0.0, set()
        for r, shape in [(r, s) for r, w, s in asks if w == who]:
            if shape in refused:
                continue
            free = [o for o in offers if o[0] == shape and o[2] not in gone]
            pick = next((o for o in free if used + o[3] <= most or used <= 0 < most), None)
            if pick is None:
                refused.add(shape)
                out.append((r, who, None, None, len(out), "submitter limit exceeded" if free else "no match found"))
                continue
            out.append((r, who, pick[2], pick[3], len(out), None))
            used += pick[3]
            gone |= set() if pick[4] else {pick[2]}
    return out


def test_negotiation_equals_scans_of_whole_lists(spark):
    rng, inf = random.Random(3), float("inf")
    asks, offers, limits, want = [], [], [], set()
    for site in "pqrs":
        mine = [(i, f"u{rng.randrange(12)}", rng.randrange(5)) for i in range(300)]
        lists = [(s, k, slot, rng.choice((0.1, 0.5, 1.0, 2.5, inf, float("nan"))), rng.random() < 0.1) for s in range(4) for k, slot in enumerate(rng.sample(range(90), 60))] if site != "s" else []
        turns = [(f"u{i}", rng.choice((0.0, -1.0, 0.3, 2.0, 7.5, 30.0, inf))) for i in rng.sample(range(12), 10)]
        want |= {(site, *map(repr, row)) for row in plain_negotiation(mine, lists, turns)}
        asks += [(site, r, w, s, 1) for r, w, s in mine]
        offers += [(site, *o) for o in lists]
        limits += [(site, i, w, m, inf) for i, (w, m) in enumerate(turns)]
    requests = spark.createDataFrame(rng.sample(asks, len(asks)), "site string, request_id long, submitter string, shape long, count long")
    candidates = spark.createDataFrame(rng.sample(offers, len(offers)), "site string, shape long, place int, slot long, cost double, partitionable boolean")
    turns = spark.createDataFrame(limits, "site string, turn int, submitter string, submitter_limit double, headroom double")
    rows = negotiation.negotiate(requests, candidates, turns).collect()
    assert {(r.site, *map(repr, r[1:])) for r in rows} == want and len(rows) == len(want)


def test_a_request_looks_at_few_candidates():
    class Counted(set):
        looks = 0

        def __contains__(self, x):
            Counted.looks += 1
            return super().__contains__(x)

    n, gone = 3000, Counted()
    offers = negotiation._Offers(np.arange(n), np.arange(n) % 50 + 1.0, np.zeros(n, bool))
    for i in range(n):
        pick = offers.first(offers.affordable(1.0, 100.0), gone)
        assert pick == i
        gone.add(pick)
    assert offers.first(offers.out, gone) is None and Counted.looks <= 2 * n


def test_deliveries_are_sorted_without_a_second_negotiation(spark, tmp_path):
    def run(frames):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from frames

    rows = [("s", i, "u", i if i % 2 else None, 1.0, i, None if i % 2 else "no match found") for i in range(40)]
    results = spark.createDataFrame(rows, negotiation.RESULT).repartition(4, "request_id").mapInPandas(run, negotiation.RESULT)
    assert [r.seq for r in negotiation.match_records(results)[0].collect()] == list(range(1, 40, 2))
    assert len(list(tmp_path.iterdir())) <= 4


def test_journal_import(spark):
    text = [
        '107 1 CreationTimestamp 5', "105", "101 Customer.alice@p Customer *", "103 Customer.alice@p Priority 2.5", '103 Customer.alice@p Note "say \\"hi\\""', "103 Customer.alice@p Flag true", "103 Customer.alice@p Nothing undefined", "106",
        "101 Customer.carol@p Customer *", "103 Customer.carol@p Priority 1", "102 Customer.carol@p", "103 Resource.slot1 RemoteUser \"alice@p\"", "103 Customer.alice@p Temp 1", "104 Customer.alice@p Temp", "105", "103 Customer.mallory@p Priority 9",
    ]
    lines = spark.createDataFrame(list(enumerate(text)), "n long, line string")
    got = {(r.key, r.attr): r.value for r in ledger_log.journal_records(ledger_log.import_journal(lines)).collect()}
    assert got == {("alice@p", "Priority"): "2.5", ("alice@p", "Note"): 'say "hi"', ("alice@p", "Flag"): "1", ("slot1", "RemoteUser"): "alice@p"}
    cut = lines.withColumn("line", F.when(F.col("n") == 3, "gibberish").otherwise(F.col("line")))
    assert ledger_log.journal_records(ledger_log.import_journal(cut)).count() == 0


def test_ledger_log_round_trip(spark, tmp_path):
    rows = [("set", 1, "a", "P", "f", None, 2.5, None, 1), ("set", 1, "a", "P", "f", None, 3.5, None, 2), ("set", 1, "b", "P", "i", 7, None, None, 3), ("del", 1, "b", None, None, None, None, None, 4), ("set", 1, "b", "Q", "s", None, None, "x", 5)]
    ledger_log.append_log(spark.createDataFrame(rows, ledger_log.LINE), str(tmp_path / "log"))
    got = ledger_log.replayed(ledger_log.read_log(spark, str(tmp_path / "log")))
    assert {(r.key, r.attr): r.value for r in got.collect()} == {("a", "P"): "3.5", ("b", "Q"): "x"}
    assert {r.key: (r.P, r.Q) for r in ledger_log.records(got, ["P", "Q"]).collect()} == {"a": ("3.5", None), "b": (None, "x")}
