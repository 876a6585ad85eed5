import random
import re
from pathlib import Path

import pytest
import xxhash

from yardmaster.llm import simhash
from yardmaster.llm.common import connected_components

from .helpers import components, frame


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_odd_tables_match_the_plain_model(spark):
    table = frame(spark)
    rows = simhash.near_duplicates(table).collect()
    source = [r for r in table.collect() if r.doc_id is not None]
    prints = {(r.doc_id, r.text): plain_fingerprint(r.text) for r in source}
    keys = sorted(prints, key=repr)
    groups = components(range(len(keys)), lambda a, b: (prints[keys[a]] ^ prints[keys[b]]).bit_count() <= 3)
    # a row without doc_id links, too
    least = {}
    for i, g in groups.items():
        least[g] = min(least.get(g, 99), keys[i][0])
    want = sorted((keys[i][0], f"{prints[keys[i]]:016x}", least[g]) for i, g in groups.items())
    got = sorted({(r.doc_id, r.fingerprint, r.component_id) for r in rows if r.doc_id is not None})
    assert got == want
    assert len(rows) == table.count()
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"max_shard": 4}, {"max_shard": 2, "expected": 1, "dense": 8}, {"max_shard": 1, "dense": 4}])
def test_links_join_what_all_pairs_join(spark, sizes):
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(150)}
    for center in list(values)[:5]:
        values |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(40)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame_ = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(frame_, **sizes)).collect()}
    want = components(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {v: roots.get(v, v) for v in values} == want


def test_a_dense_group_is_cut_until_its_shards_are_small(spark):
    rng = random.Random(12)
    center, free = rng.getrandbits(64), rng.sample(range(64), 20)
    values = {center}
    while len(values) < 1500:
        values.add(center ^ sum(1 << b for b in rng.sample(free, rng.randrange(1, 9))))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    roots = {r.node: r.root for r in connected_components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), max_shard=100)).collect()}
    want = components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {v: roots.get(v, v) for v in signed} == want


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(3)
    tree, values = simhash.BKTree(3), []
    for _ in range(400):
        x = rng.choice(values) ^ (1 << rng.randrange(64)) if values and rng.random() < 0.6 else rng.getrandbits(64)
        assert sorted(tree.insert(x)) == sorted(v for v in values if (v ^ x).bit_count() <= 3)
        values.append(x)


def test_near_copies_by_five_words(spark):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for c in range(4):
            copy = list(words)
            for at in rng.sample(range(300), c):  # up to 3 changes: similarity above 0.9
                copy[at] = "changed"
            rows.append((g * 10 + c, " ".join(copy), "", 1, 1, ""))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert {k: v // 10 for k, v in got.items()} == {k: k // 10 for k in got}  # clean documents are left alone
    assert sum(v == k // 10 * 10 for k, v in got.items()) >= 46
    split = simhash.similar_groups(frame(spark, rows), max_shard=2)
    assert {r.doc_id: r.component_id for r in split.collect()} == got
    assert simhash.similar_groups(frame(spark, [])).count() == 0


def test_links_near_the_threshold_match_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for g in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))] + ["a", "common", "line", "of", "text", "here"] * 3
        for c in range(4):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randrange(len(copy) // 30)):  # about 0.75 to 1
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy), "", 1, 1, ""))
    sets = {r[0]: set(zip(*(r[1].split()[i:] for i in range(5)))) for r in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets}
    assert sum(0.75 < s < 0.8 for s in alike.values()) > 20 and sum(0.8 <= s < 0.85 for s in alike.values()) > 20
    want = components(sets, lambda a, b: alike[a, b] >= 0.8)
    for sizes in ({}, {"max_shard": 2}):
        got = simhash.similar_groups(frame(spark, rows), **sizes)
        assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_small_tables_are_few_files_however_many_shuffle_partitions(spark):
    """Each file costs processes of its own, in whose first moment the executor's memory counts twice."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, " ".join([*words[:50], f"x{rng.randrange(8)}", *words[51 : 200 - i % 3]]), "", 1, 1, "") for i in range(120)]
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, old = set(shared.iterdir()), {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    made = {p.name.rpartition("-")[0]: len([*p.glob("part-*.parquet")]) for p in set(shared.iterdir()) - before}
    assert set(got) == set(range(120)) and set(got.values()) == {0}
    assert len(made) > 10 and {k: n for k, n in made.items() if n > 4} == {k: made[k] for k in made if k in ("fingerprints", "prefixes") and made[k] > 4}
