"""Quality classifier: random-indexing word vectors, pooled, and a small neural network.

A word is a run of bytes of one class: lower-case and non-ASCII letters, capitals,
digits, or one repeated symbol. Words are hashed to buckets, each with a sparse
random index vector. A pass over all documents adds to each bucket the index
vectors of its neighbours: the bucket's context vector. A document's features are
the means of its words' context and index vectors, their lengths, and its size. A
two-layer network learns the label from a bounded sample of labelled rows; a
temperature fitted on rows set aside makes its outputs probabilities. Only texts
are looked at when scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8

BUCKETS, DIMENSIONS, SPARSE, REACH, CHUNK = 1 << 13, 32, 2, 2, 1 << 18

_rng = np.random.default_rng(10)
_SPACE = 0
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[0, 9, 11, 12, 13, 32]] = _SPACE
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPOTS = np.stack([_rng.permutation(DIMENSIONS)[:SPARSE] for _ in range(BUCKETS)])
_SIGNS = _rng.choice(np.array([-1.0, 1.0]), (BUCKETS, SPARSE))
_INDEX = np.zeros((BUCKETS, DIMENSIONS))
np.put_along_axis(_INDEX, _SPOTS, _SIGNS, axis=1)
_powers: list[np.ndarray] = []


def buckets_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of each word."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not _powers or len(_powers[0]) <= len(raw):
        n = max(2 * CHUNK, len(raw))
        _powers[:] = [np.cumprod(np.array([1] + [b] * n, np.uint64), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    kind = _CLASS[raw]
    start = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    end = np.concatenate([start[1:], [len(raw)]])
    word = kind[start] != _SPACE
    start, end = start[word], end[word]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * _powers[1][: len(raw)], dtype=np.uint64)])
    h = (sums[end] - sums[start]) * _powers[0][start]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD1B54A32D192ED03)
    return start, (h >> np.uint64(64 - 13)).astype(np.int64)


def _cut(text: bytes, size: int) -> int:
    """Where a part of about `size` bytes ends: no word goes on there."""
    if len(text) <= size:
        return len(text)
    kind = _CLASS[np.frombuffer(text, np.uint8, size + 1)]
    ends = np.flatnonzero(kind[1:] != kind[:-1])
    if len(ends):
        return int(ends[-1]) + 1
    at = size  # one word or gap fills the part: it goes on to that one's end
    while at < len(text):
        differs = np.flatnonzero(_CLASS[np.frombuffer(text, np.uint8, min(size, len(text) - at), at)] != kind[0])
        if len(differs):
            return at + int(differs[0])
        at += size
    return len(text)


def _chunks(texts: list[bytes], chunk: int = CHUNK):
    """(joined bytes, document number of each part, where it starts), about `chunk` bytes at a time.

    A very long text goes in parts, cut between words."""
    parts, owners, size = [], [], 0

    def joined():
        return b"\0".join(parts), np.array(owners), np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])

    for i, text in enumerate(texts):
        at = 0
        while True:
            end = at + _cut(text[at : at + 2 * chunk + 1] if len(text) > at + chunk else text[at:], chunk)
            if end == at + 2 * chunk + 1:  # a word of that size
                end = at + _cut(text[at:], chunk)
            parts.append(text[at:end])
            owners.append(i)
            size += end - at + 1
            at = end
            if size >= chunk:
                yield joined()
                parts, owners, size = [], [], 0
            if at >= len(text):
                break
    if parts:
        yield joined()


def cooccurrences(texts: list[bytes], chunk: int = CHUNK) -> np.ndarray:
    """Summed index vectors of the words next to each bucket's words, flat; words on either side of a
    cut in a text are neighbours like others."""
    total = np.zeros(BUCKETS * DIMENSIONS)
    last, last_doc = np.zeros(0, np.int64), -1
    for data, owner, begin in _chunks(texts, chunk):
        at, bucket = buckets_of(data)
        doc = owner[np.searchsorted(begin, at, "right") - 1]
        if owner[0] != last_doc:
            last = last[:0]
        bucket, doc = np.concatenate([last, bucket]), np.concatenate([np.full(len(last), last_doc), doc])
        for reach in range(1, REACH + 1):
            # pairs within what is carried over were counted before
            same = (doc[reach:] == doc[:-reach]) & (np.arange(reach, max(len(doc), reach)) >= len(last))
            a, b = bucket[:-reach][same], bucket[reach:][same]
            for word, near in ((a, b), (b, a)):
                for j in range(SPARSE):
                    total += np.bincount(word * DIMENSIONS + _SPOTS[near, j], _SIGNS[near, j], BUCKETS * DIMENSIONS)
        last_doc = owner[-1]
        last = bucket[doc == last_doc][-REACH:]
    return total


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vector of each bucket over all documents: BUCKETS x DIMENSIONS numbers."""

    def run(batches):
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            total += cooccurrences(utf8(batch))
        seen = total.reshape(BUCKETS, DIMENSIONS)
        used = np.flatnonzero(seen.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(seen[used, j]) for j in range(DIMENSIONS))], ["bucket", *(f"v{j}" for j in range(DIMENSIONS))])

    columns = [f"v{j}" for j in range(DIMENSIONS)]
    sums = docs.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"{c} double" for c in columns))
    sums = sums.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns))
    out = np.zeros((BUCKETS, DIMENSIONS))
    for row in sums.collect():  # BUCKETS rows at most
        out[row[0]] = row[1:]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length, length, 1)


def features(texts: list[bytes], context: np.ndarray) -> np.ndarray:
    """A row for each text; zeros but for the size where there are no words."""
    table = np.concatenate([context, _INDEX], axis=1)
    sums, n = np.zeros((len(texts), 2 * DIMENSIONS)), np.zeros(len(texts))
    for data, owner, begin in _chunks(texts):
        at, bucket = buckets_of(data)
        part = np.searchsorted(begin, at, "right") - 1
        for p in np.unique(part):
            own = bucket[np.searchsorted(part, p) : np.searchsorted(part, p, "right")]
            if len(own) > BUCKETS:
                sums[owner[p]] += np.bincount(own, minlength=BUCKETS) @ table
            else:
                sums[owner[p]] += table[own].sum(axis=0)
            n[owner[p]] += len(own)
    means = sums / np.maximum(n, 1)[:, None]
    lengths = [np.linalg.norm(m, axis=1, keepdims=True) for m in (means[:, :DIMENSIONS], means[:, DIMENSIONS:])]
    return np.concatenate([means, *lengths, np.log1p(n)[:, None]], axis=1)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 400, rate: float = 0.01, decay: float = 1e-3) -> Network:
    """Full-batch Adam on four of five rows, the temperature on the fifth. One class, or none, gives its share."""
    rng = np.random.default_rng(5)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return net
    aside = np.arange(len(x)) % 5 == 4
    z, t = (x[~aside] - mean) / scale, y[~aside]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    for step in range(1, steps + 1):
        h = np.tanh(z @ net.w1 + net.b1)
        g = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30))) - t) / len(t)
        back = np.outer(g, net.w2) * (1 - h * h)
        grads = [z.T @ back + decay * net.w1, back.sum(axis=0), h.T @ g + decay * net.w2, np.array([g.sum()])]
        moves = []
        for m, d in zip(moments, grads):
            m[0], m[1] = 0.9 * m[0] + 0.1 * d, 0.999 * m[1] + 0.001 * d * d
            moves.append(rate * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
        net.w1, net.b1, net.w2, net.b2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2], net.b2 - float(moves[3][0])
    if aside.any() and len(np.unique(y[aside])) == 2:
        logits, t, grid = net.logit(x[aside]), y[aside], np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, np.where(t > 0, -1, 1) * logits / k)) for k in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(doc_id):
    """True where crc32 of the id as text leaves no remainder by 5, and for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, y, text): `sample` labelled rows at most, those with the least hash of doc_id of what isn't held out.

    Rows that repeat a doc_id in `labels` count once, with their largest label, and
    those that repeat it in `docs` once, with the text of the least hash; null
    labels are left out.
    """
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[np.ndarray, Network]:
    """Context vectors of all `docs`, and the network learned from `sample` `labelled` rows at most."""
    bounded_batches(docs.sparkSession)
    context = context_vectors(docs)
    rows = labelled(docs, labels, sample)

    def run(batches):
        for batch in batches:
            x = features(utf8(batch), context)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y double, x array<double>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["doc_id"][i].as_py(), got["x"][i].as_py()))
    x = np.array([got["x"][i].as_py() for i in order]).reshape(len(order), 2 * DIMENSIONS + 3)
    return context, fit(x, np.array([got["y"][i].as_py() for i in order]))


def with_score(docs: DataFrame, context: np.ndarray, net: Network, out: str = "score") -> DataFrame:
    """`docs` with the probability of label 1 of each whole text; null and empty texts have one, too."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(net.score(features(utf8(batch), context)))], [*batch.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0.0)).schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of each row.

    Repeated rows repeat, a null doc_id stays null and is held out, an empty table
    gives an empty result. Without labels of both classes every score is the
    share of label 1. Other columns are not read.
    """
    context, net = train(docs, labels, sample)
    scored = with_score(docs.select("doc_id", "text"), context, net)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
