import pytest
from pyspark.sql import functions as F

from yardmaster.functions import names
from yardmaster.functions.expressions import Compiler, ExpressionError, attributes, parse, references
from yardmaster.operators import matching, store
from yardmaster.sources import ad_text
from yardmaster.streaming import changes


@pytest.fixture(scope="module")
def slots(spark):
    return spark.createDataFrame([("a", "Unclaimed", 8, 4096, None, 3.5), ("b", "Claimed", 4, 2048, "x", None)], "key string, State string, Cpus long, Memory long, Owner string, W double")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('State == "CLAIMED"', [False, True]), ('State =?= "CLAIMED"', [False, False]), ("Cpus / 3", [2, 1]), ("-7 / 2", [-3, -3]), ("-7 % 3", [-1, -1]), ("1 / 0", [None, None]), ("7 / 2.0", [3.5, 3.5]),
        ("Missing =?= undefined", [True, True]), ("Missing == 3", [None, None]), ("Missing == 3 || true", [True, True]), ("Missing == 3 && false", [False, False]), ('Owner == "x"', [None, True]), ('Owner =!= "x"', [True, False]),
        ("W ?: 1.0", [3.5, 1.0]), ("Cpus > 5 ? 1 : 2", [1, 2]), ("ifThenElse(Missing, 1, 2)", [None, None]), ('strcat(State, ":", Cpus)', ["Unclaimed:8", "Claimed:4"]), ('State > 3', [None, None]), ("!(Cpus > 5)", [False, True]),
        ("2 + 3 * 4 - 1", [13, 13]), ("(2 + 3) * 4", [20, 20]), ("{1, 2, 3}[1]", ["2", "2"]), ("member(Cpus, {8, 9})", [True, False]), ('stringListMember("b", "a, b")', [True, True]), ("floor(W)", [3, None]), ('size("abc")', [3, 3]), ('substr("abcd", 1, 2)', ["bc", "bc"]),
    ],
)
def test_three_valued_language(slots, text, want):
    got = [r[0] for r in slots.orderBy("key").select(Compiler(attributes(slots))(text)[0]).collect()]
    assert [str(g) if isinstance(w, str) else g for g, w in zip(got, want)] == want


def test_scopes_and_references():
    assert references(parse("MY.Cpus > TARGET.Want && Other")) == {("my", "cpus"), ("target", "want"), ("", "other")}
    for bad in ("Cpus >", "(1", '"open', "1 2", "nosuch("):
        with pytest.raises(ExpressionError):
            parse(bad)


def test_own_side_first_then_the_other(spark):
    pair = spark.createDataFrame([(None, 8, 5)], "j_Cpus long, m_Cpus long, m_Memory long")
    compiler = Compiler(attributes(pair, "j_"), attributes(pair, "m_"))
    assert tuple(pair.select(compiler("Cpus")[0], compiler("Memory")[0], compiler("MY.Memory")[0]).first()) == (8, 5, None)


def test_upsert_query_invalidate(spark, slots):
    update = spark.createDataFrame([("a", "Claimed", 8, 4096, None, 1.0, 7, 1), ("a", "Owner", 8, 1, None, 1.0, 6, 0)], "key string, State string, Cpus long, Memory long, Owner string, W double, LastHeardFrom long, seq long")
    table = store.upsert(slots, update)
    assert table.count() == 2 and store.matching(table, 'State == "Claimed"').count() == 2 and store.matching(table, "Cpus > 5").count() == 1
    assert store.invalidate_where(table, "Cpus > 5").count() == 1 and store.invalidate_keys(table, spark.createDataFrame([("a",)], "key string")).count() == 1


def test_expiry_is_strict_and_spares_the_unheard(spark):
    ads = spark.createDataFrame([("a", 1000, None), ("b", 1000, 10), ("c", None, 1)], "key string, LastHeardFrom long, AdLifetime long")
    left = lambda now: {r.key for r in store.expire(ads, now).collect()}
    assert left(1010) == {"a", "b", "c"} and left(1011) == {"a", "c"} and left(1900) == {"a", "c"} and left(1901) == {"c"}


def test_secrets_never_leave(spark, monkeypatch):
    monkeypatch.setattr(names, "PRIVATE_PREFIX", "_abc_priv")
    ads = spark.createDataFrame([("n", 4, "s1", "s2", "s3")], "Name string, Cpus long, ClaimId string, Capability string, _abc_PrivKey string")
    assert store.private_columns(["_ABC_PRIVkey", "_other_private_note", "claimIDs", "Claim"]) == ["_ABC_PRIVkey", "claimIDs"]
    assert matching.fixed_slots(ads).columns == ["Name", "Cpus", "ClaimId", "Capability", "SlotWeight", "MachineMatchCount"]
    text = spark.createDataFrame([("_abc_PrivKey = 1\n_other_private_note = 2",)], "text string").select(ad_text.sanitized(F.col("text"))).first()[0]
    assert text == '_abc_PrivKey = "<redacted>"\n_other_private_note = 2'
    assert store.run_query(ads, store.Query(projection=("ClaimId", "Cpus", "capability"))).columns == ["Cpus"]
    assert store.any_ads({"machine": ads, "machine_private": ads}).columns == ["Name", "Cpus"]
    text = ad_text.sanitized(F.lit('Name = "a"\nclaimid = "secret"\n_abc_PrivX = "secret"'))
    assert "secret" not in spark.range(1).select(text).first()[0]


def test_versions(spark):
    def wins(a, b):
        rows = [("k", *a, 0), ("k", *b, 1)]
        return store.newest_version(spark.createDataFrame(rows, "key string, DaemonStartTime long, UpdateSequenceNumber long, seq long")).first().seq

    assert wins((100, 4), (100, 5)) == 1 and wins((100, 5), (100, 5)) == 0 and wins((100, 999999), (200, 0)) == 1
    assert wins((None, None), (1, 1)) == 1 and wins((1, 1), (None, 9)) == 0


def test_text_blocks(spark, tmp_path):
    (tmp_path / "pool.ads").write_text('MyType = "Machine"\nName = "slot1"\nCpus = 4\nname = "second"\n\nMyType = "Submitter"\nName="b \\"q\\""\n\nCpus = 2\n')
    good, bad = ad_text.parsed_updates(ad_text.read_ad_text(spark, str(tmp_path / "pool.ads")))
    assert sorted(r.name for r in good.collect()) == ['b "q"', "slot1"] and bad.count() == 1
    assert sorted(r[0] for r in good.select(ad_text.table_of(F.col("attrs"))).collect()) == ["machine", "submitter"]


def test_limit_tokens_and_maxima(spark):
    text = "gpu, GPU, gpu:2.5, gpu:0, gpu:-3, grp.gpu:3, a.b.c, 1bad"
    got = spark.range(1).select(names.limit_tokens(F.lit(text))).first()[0]
    assert [(t["name"], t["weight"]) for t in got] == [("gpu", 1), ("gpu", 1), ("gpu", 2.5), ("gpu", 1), ("gpu", 1), ("grp.gpu", 3)]
    config = {"CONCURRENCY_LIMIT_DEFAULT": 10, "CONCURRENCY_LIMIT_DEFAULT_GROUP": 5, "GPU_LIMIT": 3}
    of = lambda n, c: spark.range(1).select(names.limit_max(F.lit(n), c)).first()[0]
    assert [of(n, config) for n in ("gpu", "other", "group.foo", "group.gpu")] == [3, 10, 5, 5] and of("gpu", {}) == 2308032


def test_watch_turns_mismatch_into_delete(spark):
    log = spark.createDataFrame([(1, "w2", 4), (2, "w1", 8), (3, "w1", 2), (4, "w1", 1), (5, "w2", 9)], "seq long, key string, Cpus long")
    assert [(r.key, r.kind) for r in changes.changes(log, "Cpus >= 8").orderBy("seq").collect()] == [("w1", 0), ("w1", 1), ("w2", 0)]
    assert [r.kind for r in changes.replay(log, cursor=4).orderBy("cursor", "kind").collect()] == [0, 3]
    assert changes.resume_point(8192, 9000) == changes.RESYNC


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i, f"k{i % 3}", i * 7 % 10) for i in range(1, 31)]
    schema = "seq long, key string, Cpus long"
    for part in (rows[:11], rows[11:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    run = changes.stream_changes(stream(), "Cpus >= 5").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r.seq, r.key, r.kind) for r in spark.table("seen").collect())
    assert got == sorted((r.seq, r.key, r.kind) for r in changes.changes(spark.createDataFrame(rows, schema), "Cpus >= 5").collect())
    changes.upsert_stream(stream(), str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination(120)
    assert sorted((r.key, r.seq) for r in changes.upserted(spark, str(tmp_path / "t")).collect()) == [("k0", 30), ("k1", 28), ("k2", 29)]
    changes.fan_out(stream(), [str(tmp_path / "v1"), str(tmp_path / "v2")], str(tmp_path / "c3"), most=5).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "v1")).count() == spark.read.parquet(str(tmp_path / "v2")).count() == 10


def test_views_get_whole_batches_and_failures_are_retried(spark, tmp_path):
    schema, log, good, bad = "seq long, key string", str(tmp_path / "log"), tmp_path / "good", tmp_path / "bad"
    spark.range(5000).selectExpr("id as seq", "cast(id as string) as key").write.parquet(log)
    bad.write_text("a file where the view's folder should be")
    start = lambda: changes.fan_out(spark.readStream.schema(schema).parquet(log), [str(bad), str(good)], str(tmp_path / "c"))
    with pytest.raises(Exception, match="missed views"):
        start().awaitTermination(120)
    assert spark.read.parquet(str(good)).count() == 5000
    bad.unlink()
    start().awaitTermination(120)
    assert spark.read.parquet(str(bad)).count() == spark.read.parquet(str(good)).count() == 5000


def test_an_ad_is_parsed_once(spark):
    raw = spark.createDataFrame([('Name = "a"\nname = "b"\nCpus = 1\nodd',), ("junk",), (None,)], "text string")
    good, bad = ad_text.parsed_updates(raw)
    assert [(r.name, r.attrs) for r in good.collect()] == [("a", {"name": '"a"', "cpus": "1"})]
    assert {r.text for r in bad.collect()} == {"junk", None}
    routed = ad_text.with_attributes(raw).select(ad_text.table_of(F.col("attrs")).alias("tbl")).filter("tbl is not null")
    for df in (good, bad, good.select("name"), routed):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
