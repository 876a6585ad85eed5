import gzip
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from yardmaster.llm import quality, topk, warc

from .helpers import frame


def plain_top(vectors, queries, k):
    out = set()
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in vectors if i != q and len(u) == len(v))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("bins", [4, 2048])
def test_top_k_matches_brute_force(spark, bins):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.999]) for _ in range(6)], 1) for i in range(150)]
    rows += [(200 + i, [0.25] * 6, 1) for i in range(40)]  # many ties
    rows += [(300, None, 1), (301, [None] * 6, 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 1), (None, [0.1] * 6, 1), (400, [0.1] * 5, 1), (500, [0.9] * 5, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    vectors = topk.integer_vectors(table)
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and i not in (300, 301, 302, 303)]
    got = topk.top_k(vectors, vectors.filter("id % 50 = 0"), k=7, bins=bins, query_block=2, candidate_block=20, group_size=24).collect()
    assert {tuple(r) for r in got} == plain_top(fine, [x for x in fine if x[0] % 50 == 0], 7) and len(got) == len(set(got))
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_large_components_stay_exact(spark):
    table = spark.createDataFrame([(0, [3e5, 1e5]), (1, [2e5, 7e5]), (2, [-1e6, 3e6])], "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(table)
    got = {tuple(r) for r in topk.top_k(vectors, vectors.filter("id = 0")).collect()}
    assert got == plain_top([(i, [math.floor(1024 * x) for x in v]) for i, v in ((0, [3e5, 1e5]), (1, [2e5, 7e5]), (2, [-1e6, 3e6]))], [(0, [307200000, 102400000])], 10)


@pytest.mark.parametrize("bins", [100, 2048])
def test_scores_are_exact_to_the_range_of_a_long(spark, bins):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1.6e6, 1.6e6) for _ in range(3)]) for i in range(60)] + [(60, [1.4e6, 1.2e6, 1e6]), (61, [1.4e6, 1.2e6, 1e6]), (62, [-2.9e6] * 3), (63, [2.9e6] * 3)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    got = topk.top_k(vectors, vectors.filter("id % 5 = 0 or id > 59"), k=5, bins=bins).collect()
    true = {(q, i): sum(a * b for a, b in zip(v, u)) for q, v in fine for i, u in fine}
    held = {pair: max(-(1 << 63), min((1 << 63) - 1, s)) for pair, s in true.items()}
    want = {(q, n + 1, i, -s) for q, _ in fine if q % 5 == 0 or q > 59 for n, (s, i) in enumerate(sorted((-held[q, i], i) for i, _ in fine if i != q)[:5])}
    assert {tuple(r) for r in got} == want and max(true.values()) > 1 << 63 and max(s for *_, s in want) == (1 << 63) - 1
    assert any(1 << 62 < s < (1 << 63) - 1 for *_, s in want)
    # all candidates but one lie at the low end
    low = topk.integer_vectors(spark.createDataFrame([(0, [3e6] * 3), *((i, [-3e6] * 3) for i in range(1, 6))], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in topk.top_k(low, low.filter("id = 0"), k=3).orderBy("rank").collect()] == [(0, n, n, -(1 << 63)) for n in (1, 2, 3)]


def pages():
    body = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n</p>" * 5
    return [(1, "http://a/1", body, 9), (2, "http://a/2\r\nX: y", body, 9), (3, None, body, 9), (4, "u", "short", 9), (5, "u", "short", 9), (6, "u", None, 9), (7, "u", "", 9), (8, "u", body + "x", 9), (9, "u", "z" * 300_000, 9), (10, "u", "z" * 300_000, 9), (10, "u", "z" * 300_000, 9), (1, "http://a/1", body, 9), (None, "u", body, 9), (None, "u", "n" * 200, 9)]


def test_archives_come_back(spark, tmp_path):
    rows = pages()
    table = spark.createDataFrame(rows, "page_id long, url string, html string, kind int")
    least = {}
    for i, _, h, _ in rows:
        if i is not None:
            least[h] = min(least.get(h, i), i)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and least.get(h) is not None and least[h] != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least[h] if again else None))
    got = warc.round_trip(table, str(tmp_path / "w"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    nested = warc.assemble(warc.read_records(spark, str(tmp_path / "w")))
    payload = {r.metadata.page_id: r.payload for r in nested.filter("kind = 'response'").collect()}
    assert payload[1] == rows[0][2] and payload[9] == "z" * 300_000 and payload[6] == ""
    assert nested.filter("request is null or metadata is null").count() == 0
    assert warc.round_trip(table.limit(0), str(tmp_path / "none")).count() == 0


def test_files_are_bounded_by_payload_bytes(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "u", "".join(rng.choice("ab") for _ in range(n))) for i, n in enumerate([200] * 40 + [20_000] * 12 + [300_000] * 3)]
    warc.write_captures(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), file_bytes=1 << 18, per_file=30)
    sizes = [sum(len(b) for h, b in warc.parse_records(f.read_bytes()) if h["warc-type"] == "response") for f in (tmp_path / "w").rglob("*.gz")]
    assert sum(s > 100 for s in sizes) >= 2 + 2 + 3 and max(sizes) < 300_000 + 200



def test_reader_takes_members_and_plain_files():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    for content in (one * 3, gzip.compress(one) * 3, gzip.compress(one * 3)):
        assert [b for _, b in warc.parse_records(content)] == [b"ab\r\n"] * 3


def test_words_are_runs_whatever_the_batch():
    texts = [b"", b"Hello WORLD!! 12 \xc3\xa9t\xc3\xa9", b"a" * 3_000_000, b" ".join(b"w%d" % i for i in range(300_000)), b"!!"]
    context = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIMENSIONS))
    together = quality.features(texts, context)
    assert np.allclose(together, np.concatenate([quality.features([t], context) for t in texts]))
    assert not together[0].any()
    place, bucket = quality.buckets_of(b"Hello WORLD!! 12")
    assert place.tolist() == [0, 1, 6, 11, 14] and bucket[3] == quality.buckets_of(b"!!")[1][0]


def plain_words(text):
    """Runs of bytes of one class, but blank ones."""
    kind = lambda b: " " if b in (0, 9, 11, 12, 13, 32) else "a" if 97 <= b <= 122 or b > 127 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else b
    runs = [bytes(g) for _, g in itertools.groupby(text, kind)]
    return [int(quality.buckets_of(r)[1][0]) for r in runs if kind(r[0]) != " "]


def odd_bytes():
    rng = random.Random(3)
    texts = [b" ".join(rng.choice([b"one", b"Two", b"33", b"--", b"!?", b"\xc3\xa9t\xc3\xa9", b"\n"]) for _ in range(rng.randrange(60))) for _ in range(30)]
    return [*texts, b"", b" ", b"y" * 500, b"a" * 200 + b"B" * 200 + b" c", b"-" * 100 + b" 5" * 90]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_cooccurrences_match_a_plain_model(chunk):
    want = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for text in odd_bytes():
        words = plain_words(text)
        for i, a in enumerate(words):
            for b in words[max(0, i - quality.REACH) : i] + words[i + 1 : i + 1 + quality.REACH]:
                want[a] += quality._INDEX[b]
    assert np.allclose(quality.cooccurrences(odd_bytes(), chunk).reshape(want.shape), want)


def test_features_and_scores_match_a_plain_model():
    rng = np.random.default_rng(4)
    context = rng.normal(size=(quality.BUCKETS, quality.DIMENSIONS))
    net = quality.Network(rng.normal(size=67), rng.uniform(1, 2, 67), rng.normal(size=(67, 5)), rng.normal(size=5), rng.normal(size=5), 0.3, 1.7)
    got = quality.features(odd_bytes(), context)
    for text, x in zip(odd_bytes(), got):
        words = plain_words(text)
        mean = [sum(table[w] for w in words) / len(words) if words else np.zeros(32) for table in (context, quality._INDEX)]
        plain = np.concatenate([*mean, [math.sqrt(sum(v * v for v in m)) for m in mean], [math.log(1 + len(words))]])
        assert np.allclose(x, plain)
        hidden = [math.tanh(sum((plain[i] - net.mean[i]) / net.scale[i] * net.w1[i, j] for i in range(67)) + net.b1[j]) for j in range(5)]
        logit = (sum(h * w for h, w in zip(hidden, net.w2)) + 0.3) / 1.7
        assert np.allclose(net.score(x[None]), 1 / (1 + math.exp(-logit)))


def test_a_fit_separates_and_is_calibrated():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 67))
    share = 1 / (1 + np.exp(-3 * np.sin(x[:, 0]) - 2 * x[:, 1]))
    y = (rng.uniform(size=3000) < share).astype(float)
    scores = quality.fit(x[:2000], y[:2000]).score(x[2000:])
    for low in (0.0, 0.25, 0.5, 0.75):
        held = (scores >= low) & (scores < low + 0.25)
        assert abs(scores[held].mean() - y[2000:][held].mean()) < 0.12
    assert ((scores > 0.5) == y[2000:]).mean() > 0.75


def test_a_labelled_id_that_fills_the_table_is_learned_once(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)] + [(2, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 41)] + [(2, "another")] * 500, "doc_id long, text string")
    got = quality.labelled(docs, labels, 20).collect()
    assert len(got) == len({r.doc_id for r in got}) == 20 and all(r.y == (r.doc_id % 2 or r.doc_id == 2) for r in got)
    ids = [r.doc_id for r in quality.labelled(docs, labels, 100).collect()]
    assert sorted(ids) == [i for i in range(1, 41) if zlib.crc32(str(i).encode()) % 5]


def test_scores_are_learned_and_held_out(spark):
    from tests.conftest import SF

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    shuffled = labels.select("doc_id", (1 - labels.quality).alias("quality")).filter(quality.held_out("doc_id")).unionByName(labels.select("doc_id", "quality").filter(~quality.held_out("doc_id")))
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, shuffled).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)  # held-out labels are never seen


def test_scores_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (8, 0, 0)], "doc_id long, quality int, score int")
    got = quality.quality_scores(frame(spark), labels).collect()
    assert len(got) == frame(spark).count() and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(frame(spark), labels.limit(0)).count() == len(got)
    assert quality.quality_scores(frame(spark, []), labels).count() == 0
