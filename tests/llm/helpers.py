"""Small tables with what may go wrong in them, and plain models of the operators."""

import random

import public_tokenizers

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, score string, th int, n_lines long, fp string"


def odd_rows():
    rng = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "délta", "the", "of", "x1", "42", "!?", "näïve"]
    long = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(30_000))
    near = [rng.choice(words) + str(i) for i in range(120)]
    other = near[:60] + ["changed"] + near[61:]
    lines = "\n".join(f"line {i} of text" for i in range(8))
    rows = [(1, " ".join(near)), (2, " ".join(other)), (3, " ".join(near)), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n "), (7, "x"), (7, "different text"), (8, long), (9, "y" * 60_000)]
    rows += [(10, lines), (11, "first\n" + lines), (12, "a\na\na\na\na"), (None, lines), (None, None), (13, "line 1 of text"), (14, "word\x00with\x1codd\x85spaces　here"), (15, " ".join(near[20:90]))]
    return [(i, t, "clash", 1, 2, "clash") for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def components(ids, linked):
    """Smallest reachable id of each."""
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}
