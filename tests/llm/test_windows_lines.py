import hashlib
import random
import re

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from yardmaster.llm import lines, substrings, winnowing

from .helpers import frame


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_removal(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=repr)


def test_repeated_windows_match_the_plain_model(spark):
    rng = random.Random(5)
    shared = [f"s{k}" for k in range(40)]
    rows = [(i, " ".join([f"u{rng.randrange(9)}" for _ in range(rng.randrange(30))] + shared[rng.randrange(15) : rng.randrange(20, 40)] + ["z"] * rng.randrange(25))) for i in range(60)]
    rows += [(r.doc_id, r.text) for r in frame(spark).collect() if len(r.text or "") < 5000]
    table = frame(spark, [(i, t, "", 1, 1, "") for i, t in rows])
    for window, anchor in ((10, 4), (50, 8)):
        got = substrings.without_repeats(table, window, anchor, with_text=True).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == plain_removal(rows, window)
        assert all(sha(r.kept_text) == r.kept_sha256 for r in got)
    assert substrings.without_repeats(frame(spark, [])).count() == 0


def test_very_long_texts_are_read_whole(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    body = " ".join(f"b{k}" for k in range(40_000))
    table = frame(spark, [(1, body + " " + passage, "", 1, 1, ""), (2, "intro " + passage + " end", "", 1, 1, "")])
    got = {r.doc_id: r.n_removed for r in substrings.without_repeats(table).collect()}
    assert got == {1: 0, 2: 60}


def test_patterns_that_cancel_in_sums_are_told_apart(spark):
    """Two documents whose blocks differ by one word each, after the Thue-Morse sequence and its complement."""
    block = lambda k, bit: [f"head{j}" for j in range(8)] + ["one" if bit else "zero"] + [f"w{k}.{j}" for j in range(31)]
    text = lambda flip: " ".join(w for k in range(1024) for w in block(k, k.bit_count() % 2 ^ flip))
    got = substrings.without_repeats(frame(spark, [(i, text(i), "", 1, 1, "") for i in (0, 1)])).collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(40_960, 0)] * 2


def test_spans_are_compared_at_their_source(spark):
    rows = [(1, " ".join(f"a{k}" for k in range(30))), (2, " ".join(f"a{k}" for k in range(20)) + " x " + " ".join(f"a{k}" for k in range(20, 30)))]
    docs = frame(spark, [(i, t, "", 1, 1, "") for i, t in rows]).select("doc_id", F.xxhash64("text").alias("th"), "text")
    th = {r.doc_id: r.th for r in docs.collect()}
    spans = lambda n: spark.createDataFrame([(2, th[2], 0, n, 1, th[1], 0)], "doc_id long, th long, at int, n int, from_id long, from_th long, from_at int")
    for n, wrong in ((11, 0), (12, 1)):
        done, found = substrings.cut_spans(docs, spans(n), 10)
        assert found == wrong and {r.doc_id: r.n_removed for r in done.collect()} == {1: 0, 2: n + 9}


def test_pieces_are_named_by_their_end_nodes():
    rng = random.Random(11)
    texts = [[b"%d" % rng.randrange(3) for _ in range(rng.randrange(80))] for _ in range(50)] + [[b"z"] * 200, []]
    named, seen = {}, [0] * len(texts)
    for text, start, size, least, left, right in zip(*(x.tolist() for x in substrings.pieces_of(texts, 10, 4))):
        assert start == seen[text] and 0 < size < 10
        seen[text] += size
        words = tuple(texts[text][start : start + size + 9])
        assert named.setdefault((left, right, size), words) == words
    assert seen == [max(0, len(t) - 9) for t in texts] and len(set(named.values())) == len(named)


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.execute(f"create table {name} ({columns})")
        if rows:
            con.executemany(f"insert into {name} values ({','.join('?' * len(rows[0]))})", rows)
    return sorted(con.sql(sql).fetchall(), key=repr)


def test_contamination_matches_sql(spark):
    rng = random.Random(6)
    words = ["ab", "Cd", "ef", "é", "12", "x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 14, 30]))) for i in range(12)] + [(20, None), (21, "..."), (22, "Ab, cd"), (23, text(12)), (24, "lonely")]
    items.append((25, items[13][1]))
    docs = [(i, text(rng.randrange(4, 120)) + ("; " + items[i % 12][1] + "! " + text(5) if i % 3 == 0 else "")) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "LONELY"), (103, "ab--cd"), (104, "12 " * 4000 + items[5][1])]
    got = winnowing.decontaminate(frame(spark, [(i, t, "", 1, 1, "") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"))
    want = run_sql(winnowing.SQL, documents=("doc_id bigint, text varchar", docs), benchmark=("item_id bigint, text varchar", items))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == want
    assert any(w[5] for w in want) and not all(w[5] for w in want)


def test_contamination_of_odd_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (None, "gamma")], "item_id long, text string")
    assert winnowing.decontaminate(frame(spark), items).count() == frame(spark).count()
    none = winnowing.decontaminate(frame(spark), items.limit(0))
    assert none.filter("contaminated or n_hit > 0").count() == 0
    assert winnowing.decontaminate(frame(spark, []), items).count() == 0


def test_line_runs_match_sql(spark):
    rng = random.Random(8)
    lines_ = [*"abcdefghij", "five words are in this", "but\x0bfour in\tthis ", "so\x0bis this with\tfive "]
    docs = [(i, "\n".join(rng.choice(lines_) for _ in range(rng.randrange(1, 14)))) for i in range(40)] + [(50, None), (51, ""), (52, "\n\n\n"), (53, "q")]
    got = lines.line_report(frame(spark, [(i, t, "", 1, 1, "") for i, t in docs]))
    want = run_sql(lines.SQL, documents=("doc_id bigint, text varchar", docs))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()), key=repr) == want


def test_line_runs_of_any_length(spark):
    rng = random.Random(9)
    docs = [(i, "\n".join(rng.choice("abc") for _ in range(12))) for i in range(30)]
    for least in (1, 3, 5):
        first, want = {}, {}
        for i, t in docs:
            rows = t.split("\n")
            for k in range(len(rows) - least + 1):
                first.setdefault(tuple(rows[k : k + least]), (i, k))
        for i, t in docs:
            rows = t.split("\n")
            gone = {k + j for k in range(len(rows) - least + 1) if first[tuple(rows[k : k + least])] != (i, k) for j in range(least)}
            want[i] = "\n".join(r for k, r in enumerate(rows) if k not in gone)
        got = lines.without_repeated_lines(frame(spark, [(i, t, "", 1, 1, "") for i, t in docs]).drop("n_lines"), least)
        assert {r.doc_id: r.text for r in got.collect()} == want


def test_suffix_array_and_its_prefixes(spark):
    """Order, common prefixes and maximal runs against sorted suffixes, each compared with all others."""
    rng = random.Random(12)
    body = [rng.choice("abcdefg") for _ in range(60)]
    docs = {i: [rng.choice("aab") for _ in range(rng.randrange(1, 30))] for i in range(12)} | {20: body, 21: body, 22: ["z", *body[:41], "y"], 23: ["a"] * 40, 24: []}
    units = spark.createDataFrame([(i, i, k, ord(c)) for i, d in docs.items() for k, c in enumerate(d) if c != "d"], "doc_id long, th long, at int, rank long")
    rest = lambda i, k: "".join(docs[i][k:]).split("d")[0]  # noqa: E731  d is not there: it ends suffixes
    want = sorted((rest(i, k), i, k) for i, d in docs.items() for k, c in enumerate(d) if c != "d")
    same = lambda x, y: next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    got = sorted(lines.suffix_array(units).collect(), key=lambda r: (r.ranks[-1], r.doc_id, r.at))
    assert [(r.doc_id, r.at, r.left) for r in got] == [(i, k, len(x)) for x, i, k in want]
    assert [r.lcp for r in got] == [0] + [same(a[0], b[0]) for a, b in zip(want, want[1:])]
    table = frame(spark, [(i, "\n".join(d), "", 1, 1, "") for i, d in docs.items()]).select("doc_id", F.lit(0).cast("long").alias("th"), "text")
    longest = {(i, k): max(same(docs[i][k:], docs[j][m:]) for j in docs for m in range(len(docs[j])) if (i, k) != (j, m)) for i in docs for k in range(len(docs[i]))}
    runs = {(i, k, n) for (i, k), n in longest.items() if n >= 2 and longest.get((i, k - 1)) != n + 1}
    assert {(r.doc_id, r.at, r.n) for r in lines.maximal_runs(table).collect()} == runs


def test_single_long_lines_go_alone(spark):
    rng = random.Random(10)
    long, short = [f"line {c} of five words" for c in "abcd"], ["x", "four words are short", "", " "]
    docs = [(i, "\n".join(rng.choice(long + short + [f"own {i} {k}"] * 6) for k in range(8))) for i in range(40)]
    first, want = {}, {}
    for i, t in docs:
        rows = t.split("\n")
        for k in range(len(rows)):
            first.setdefault(rows[k], (i, k))
            first.setdefault(tuple(rows[k : k + 2]), (i, k))
    for i, t in docs:
        rows = t.split("\n")
        gone = {k for k, r in enumerate(rows) if len(r.split()) >= 5 and first[r] != (i, k)}
        gone |= {k + j for k in range(len(rows) - 1) if first[tuple(rows[k : k + 2])] != (i, k) for j in (0, 1)}
        want[i] = "\n".join(r for k, r in enumerate(rows) if k not in gone)
    got = lines.without_repeated_lines(frame(spark, [(i, t, "", 1, 1, "") for i, t in docs]).drop("n_lines"), alone=5)
    assert {r.doc_id: r.text for r in got.collect()} == want
    staged = corpus_pipeline.cut_lines(spark, frame(spark, [(1, "top\n" + long[0], "", 1, 1, ""), (2, long[0] + "\nend", "", 1, 1, ""), (3, long[0], "", 1, 1, "")]), "")
    assert {r.doc_id: r.text for r in staged.collect()} == {1: "top\n" + long[0], 2: "end"}


def test_lines_of_odd_tables(spark):
    table = frame(spark)
    got = lines.without_repeated_lines(table, n_lines="lines_", n_removed="removed_")
    assert got.columns == [*table.columns, "lines_", "removed_"] and got.count() == table.count()
    kept = {(r.doc_id, r.text) for r in got.collect()}
    assert (11, "first") in kept and (12, "a") in kept and any(i is None and t for i, t in kept)
    assert lines.line_report(frame(spark, [])).count() == 0
