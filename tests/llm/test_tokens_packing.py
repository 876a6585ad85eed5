import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from yardmaster.llm import packing, tokens

from .helpers import VOCABULARY, frame


def library():
    return Tokenizer.from_file(VOCABULARY)


def test_counts_equal_the_library_on_odd_texts():
    rng = random.Random(1)
    alphabet = "abcXYZ éßÇİΣσ가中🙂\n\t '’!?#12½\x1c\x85​　é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>'s", "it's we'll I'D", "ab" * 3000, "<|endoftext", ""]
    counter, real = tokens.BytePairCounter(VOCABULARY), library()
    assert [counter.count(t) for t in texts] == [len(x.ids) for x in real.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library_on_every_code_point():
    counter, real = tokens.BytePairCounter(VOCABULARY, memo=1000), library()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 40_000):
        texts = [" ".join(f"a{c}B {c}c{c}'s {c}{c}1" for c in points[j : j + 4]) for j in range(i, min(i + 40_000, len(points)), 4)]
        assert [counter.count(t) for t in texts] == [len(x.ids) for x in real.encode_batch(texts, add_special_tokens=False)]


def test_counts_do_not_depend_on_the_memo():
    small = tokens.BytePairCounter(VOCABULARY, memo=3)
    big = tokens.BytePairCounter(VOCABULARY)
    texts = ["some words repeat, some words don't", "repeat words"] * 3
    assert [small.count(t) for t in texts] == [big.count(t) for t in texts]


def test_token_counts_of_odd_tables(spark):
    real = library()
    rows = tokens.token_counts(frame(spark), VOCABULARY, budget=100).collect()
    want = sorted(((r.doc_id is None, r.doc_id, len((r.text or "").encode()), len(real.encode(r.text or "", add_special_tokens=False).ids)) for r in frame(spark).collect()), key=repr)
    assert sorted(((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert tokens.token_counts(frame(spark, []), VOCABULARY).count() == 0


def test_coded_words_equal_the_library():
    """Plain words are split here, others and special tokens by the library; a memo of few units changes nothing."""
    rng, real = random.Random(3), library()
    parts = ["a", "B", "'", "s", "'S", "'re", "'LL", "1", "22", ".", "!?", "é", "É", "ß", "À", "×", "÷", "ª", "µ", "½", "İ", "ſ", "\u0301", " ", "\x85", "\x1c", "\x00", "  ", "\n", "\x0b", "<|endoftext|>", "<|", "|>", "<|EndOfText|>", "中", "Ж", "🙂", "\u180e", "Ω"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4000)] + [None, ""]
    texts += [f"a{c}B' {c}'s {c}" for c in map(chr, range(1, 0x600))]
    coder = packing.WordIds(VOCABULARY, 500)
    assert coder.known_kind
    for i in range(0, len(texts), 500):
        ids, means = coder.encode(pa.array(texts[i : i + 500], pa.string()))
        assert [x.tolist() for x in ids] == [real.encode(t or "", add_special_tokens=False).ids for t in texts[i : i + 500]]
        assert len(means) == len(ids)


def test_pieces_of_plain_words_are_coded_without_offsets():
    """The library's call with offsets, tokens' texts and word numbers takes twice as long."""

    class Fast:
        def __init__(self, real):
            self.encode_batch_fast = real.encode_batch_fast

    coder, real = packing.WordIds(VOCABULARY, 500), library()
    coder.merger = Fast(coder.merger)
    texts = ["It's a PLAIN text, isn't it?", "</w> a</w>b <w/> x</W>y", "Été à l'ÎLE, n° 12: 3/4 «ça»", "don't 'stop' ''s !'s 1's's x're'll'd'", " ".join(f"Word{i}'ve-ß{i}" for i in range(2000))]
    for batch in (texts[:2], texts[2:], texts):
        assert [x.tolist() for x in coder.encode(pa.array(batch))[0]] == [real.encode(t, add_special_tokens=False).ids for t in batch]


def test_units_without_a_closing_token_are_told_apart_by_words():
    coder, real = packing.WordIds(VOCABULARY, 500), library()
    coder.closes[:] = False
    texts = ["It's a PLAIN text, isn't it?", "Été à l'ÎLE</w>"]
    assert [x.tolist() for x in coder.encode(pa.array(texts))[0]] == [real.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_plain_words_are_those_of_the_pattern():
    rng, pattern = random.Random(8), re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    words = ["".join(rng.choice("'" * 4 + "strevmldaxéßÿö0129!-.") for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    array = pa.array(["cut off", *words, "'"], pa.large_string())
    for got, want in ((array[1:-1], words), (array[1:1], []), (pa.array(["'", "s", "'r", "e", "'l"], pa.large_string()), ["'", "s", "'r", "e", "'l"])):
        pieces, many = packing.plain_pieces(got)
        assert pieces.to_pylist() == [p for w in want for p in pattern.findall(w)]
        assert many.tolist() == [len(pattern.findall(w)) for w in want]


def test_sums_of_runs_some_of_them_empty():
    rows = np.arange(10.0).reshape(5, 2)
    assert packing._sums(rows, np.array([0, 2, 2, 5, 5])).tolist() == [[0, 0], [2, 4], [0, 0], [18, 21], [0, 0]]
    assert packing._sums(rows[:0], np.array([0, 0])).tolist() == [[0, 0], [0, 0]]


def test_packed_pieces_are_the_documents(spark):
    real = library()
    source = [r for r in frame(spark).collect() if r.doc_id is not None and r.doc_id not in (3, 7)]
    rows = packing.packed(frame(spark), VOCABULARY, length=256, memo=50).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc in source:
        ids, at = np.array([*real.encode(doc.text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for piece in sorted(by_doc[doc.doc_id], key=lambda r: r.start):
            assert piece.start == at and piece.doc_tokens == len(ids)
            assert piece.ids_crc32 == zlib.crc32(ids[at : at + piece.length].tobytes())
            at += piece.length
        assert at == len(ids)
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 256 and end & (end - 1) == 0  # full, or a power of two: nothing is padded
    assert packing.packed(frame(spark, []), VOCABULARY).count() == 0


def test_hilbert_curve_visits_each_cell_from_a_neighbour():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(np.ndindex(*[1 << bits] * dimensions)))
        keys = packing.hilbert_key(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert set(np.abs(np.diff(path, axis=0)).sum(axis=1).tolist()) == {1}


def test_ranges_hold_about_equally_many_tokens(spark):
    rng = random.Random(5)
    # a third of the rows have one key, and lengths differ a thousandfold
    key = lambda: 77 if rng.random() < 0.34 else rng.randrange(1 << 48)
    rows = [(i, key() << packing.SPREAD | rng.randrange(1 << packing.SPREAD), rng.choice([5, 20, 60, 5000])) for i in range(6000)]
    coded = spark.createDataFrame(rows, "doc_id long, place long, n long")
    total = sum(r[2] for r in rows)
    dealt = packing.ranged(coded, total // 10).select("*", F.spark_partition_id().alias("p")).collect()
    sums, ends = {}, {}
    for r in dealt:
        sums[r.p] = sums.get(r.p, 0) + r.n
        ends.setdefault(r.p, []).append(r.place)
    assert len(dealt) == len(rows) and len(sums) >= 10 and max(sums.values()) < 1.6 * total / 10
    inside = [ends[p] for p in sorted(ends)]
    assert all(x == sorted(x) for x in inside) and all(a[-1] <= b[0] for a, b in zip(inside, inside[1:]))
    assert packing.ranged(coded.limit(0)).count() == 0
