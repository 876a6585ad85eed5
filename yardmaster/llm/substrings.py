"""Exact removal of word windows that repeat across documents, by de Bruijn compaction.

The edges of the graph are token k-mers, windows of `window` consecutive words; its
nodes are the spans of one word less between them. A document is a walk, cut into
pieces: runs of edges with the same minimizer (the least hash of an `anchor`-word
gram inside), of fewer edges than a window has words, so that a piece's two end
nodes hold all its words and name it. Equal pieces merge, keeping the coordinates of
the smallest document. Pieces that share a minimizer with another are laid open to
their edges, which meet by hash. Of the graph of repeated pieces, nodes with one
piece in and one out are joined away: the pieces around them are one nonbranching
path. What a document shares with an earlier one is then a few spans, each within a
path, and the SHA-256 of every span's words is compared with that of the words at
the source's coordinates. Hashes only propose: equal words always have equal hashes,
so nothing is missed, and a span whose words differ has the work done anew by other
hashes.
"""

from __future__ import annotations

import hashlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stash, utf8

#: Edges of a piece at most: their numbers fit the bits of a long.
_MOST = 62
_PIECE = ["left", "right", "size"]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads them (finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(words: list[bytes], widths: tuple[int, ...], seed: int = 0) -> list[np.ndarray]:
    """For each of the ascending widths, the hashes of all spans of so many words.

    A hash is mixed from those of two shorter spans that cover the span, from single
    words up, so patterns of words don't cancel as in a sum of products.
    """

    def joined(h: np.ndarray, by: int) -> np.ndarray:
        n = max(0, len(h) - by)
        return _mix(h[:n] * np.uint64(0x9E3779B97F4A7C15) + h[by:])

    have, size, out = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words)), 1, []
    for width in widths:
        while 2 * size <= width:
            have, size = joined(have, size), 2 * size
        out.append(joined(have, width - size) if width > size else have)
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def pieces_of(texts: list[list[bytes]], window: int, anchor: int, seed: int = 0):
    """(text, start, size, minimizer, left, right) arrays: the pieces of each text's walk."""
    lengths = np.array([len(words) for words in texts], np.int64)
    n = np.maximum(lengths - window + 1, 0)
    if not n.sum():
        return None
    # all texts are hashed end to end; spans that cross from one to the next are passed over
    grams, nodes = span_hashes(list(chain.from_iterable(texts)), (anchor, window - 1), seed)
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(lengths) - lengths
    at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
    least = _sliding_min(grams, window - anchor + 1)[at]
    begin = np.concatenate([[0], np.flatnonzero((least[1:] != least[:-1]) | (owner[1:] != owner[:-1])) + 1])
    run = np.diff(np.concatenate([begin, [len(at)]]))
    most = min(window - 1, _MOST)
    parts = -(-run // most)
    start = np.repeat(begin, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * most
    end = np.concatenate([start[1:], [len(at)]])
    text = owner[start]
    return text, at[start] - first[text], end - start, least[start], nodes[at[start]], nodes[at[end - 1] + 1]


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _i32(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _pieces(docs: DataFrame, window: int, anchor: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = pieces_of([t.split() for t in utf8(batch)], window, anchor, seed)
            if found is not None:
                text, start, size, least, left, right = found
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("th").take(rows), _i32(start), _i32(size), _i64(least), _i64(left), _i64(right)],
                    ["doc_id", "th", "start", "size", "least", "left", "right"],
                )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, start int, size int, least long, left long, right long")


def _edges(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """The edges, with their hash, of the pieces named in `pieces` (array of start, size)."""

    def run(batches):
        for batch in batches:
            for row, (text, pieces) in enumerate(zip(utf8(batch), batch.column("pieces").to_pylist())):
                (hashes,) = span_hashes(text.split(), (window,), seed)
                size = np.array([p["size"] for p in pieces])
                start = np.repeat(np.array([p["start"] for p in pieces]), size)
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                rows = pa.array(np.full(len(step), row))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("th").take(rows), _i32(start), _i32(step), _i64(hashes[start + step])], ["doc_id", "th", "start", "step", "w"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, start int, step int, w long")


def _branching(sources: DataFrame, docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc_id, th, start, mask, from_id, from_th, from_at): for pieces of `sources` under a minimizer
    with several, which edges a smaller document has, and where; bit i of mask is edge i, and
    from_at the place of edge 0 there."""
    several = sources.groupBy("least").agg(F.count("*").alias("n")).filter("n > 1").select("least")
    named = sources.join(stash(several, "branching"), "least").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "size")).alias("pieces"))
    edges = stash(_edges(docs.join(named, ["doc_id", "th"]).select("doc_id", "th", "text", "pieces"), window, seed), "edges")
    least = F.min(F.struct("doc_id", "th", (F.col("start") + F.col("step")).alias("at"))).alias("s")
    # written first, so that the join's shuffle is its own and a very frequent edge is split there
    first = stash(edges.groupBy("w").agg(least, F.max("doc_id").alias("hi")).filter("s.doc_id < hi").select("w", F.col("s.doc_id").alias("from_id"), F.col("s.th").alias("from_th"), F.col("s.at").alias("at")), "repeated-edges")
    earlier = edges.join(first, "w").filter("from_id < doc_id").withColumn("from_at", F.col("at") - F.col("step"))
    return earlier.groupBy("doc_id", "th", "start", "from_id", "from_th", "from_at").agg(F.bit_or(F.expr("shiftleft(1L, step)")).alias("mask"))


def _paths(sources: DataFrame) -> DataFrame:
    """`sources` with `path`: where, in the source document, the piece's nonbranching path begins."""
    ends = sources.select(F.col("left").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(sources.select("right", F.lit(0), F.lit(1)))
    plain = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out = 1 and into = 1").select(F.col("node").alias("left"), F.lit(True).alias("plain"))
    walk = Window.partitionBy("doc_id", "th").orderBy("start")
    goes_on = F.col("plain") & (F.lag(F.col("start") + F.col("size")).over(walk) == F.col("start"))
    head = F.when(~F.coalesce(goes_on, F.lit(False)), F.col("start"))
    return sources.join(plain, "left", "left").withColumn("head", head).withColumn("path", F.last("head", ignorenulls=True).over(walk)).drop("head", "plain")


def _ranges(mask: Column) -> Column:
    """(from, size) of each run of ones."""
    is_set = lambda i: F.expr("1L") == F.call_function("shiftright", mask, i).bitwiseAND(F.expr("1L"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(_MOST)), is_set)
    begin = F.filter(bits, lambda b: ~F.array_contains(bits, b - 1))
    end = F.filter(bits, lambda b: ~F.array_contains(bits, b + 1))
    return F.zip_with(begin, end, lambda a, b: F.struct(a.alias("from"), (b - a + 1).alias("size")))


def repeated_spans(docs: DataFrame, window: int = 50, anchor: int = 8, seed: int = 0) -> DataFrame:
    """(doc_id, th, at, n, from_id, from_th, from_at): the `n` windows of `docs` (doc_id, th, text) from word
    `at` on start, by their hashes, also at word `from_at` of a document with a smaller doc_id."""
    pieces = stash(_pieces(docs.filter("doc_id is not null"), window, anchor, seed), "pieces")
    shared = stash(pieces.groupBy("least").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("least"), "minimizers")
    pieces = stash(pieces.join(shared, "least"), "shared-pieces")
    sources = pieces.groupBy("least", *_PIECE).agg(F.min(F.struct("doc_id", "th", "start")).alias("s"))
    sources = stash(sources.select("least", *_PIECE, "s.*"), "sources")
    paths = stash(_paths(sources).select(*_PIECE, F.col("doc_id").alias("from_id"), F.col("th").alias("from_th"), F.col("start").alias("from_at"), "path"), "paths")
    met = pieces.drop("least").join(paths, _PIECE)
    whole = met.filter("doc_id > from_id").select("doc_id", "th", F.col("start").alias("at"), F.col("size").alias("n"), "from_id", "from_th", "from_at", "path")
    # the source document's own copies of the piece: the edges that other pieces hold earlier
    part = stash(_branching(sources, docs, window, seed), "earlier-edges").toDF("own_id", "own_th", "own_at", "from_id", "from_th", "from_at", "mask")
    own = met.filter("doc_id = from_id").select("doc_id", "th", "start", F.col("from_id").alias("own_id"), F.col("from_th").alias("own_th"), F.col("from_at").alias("own_at"))
    some = own.join(part, ["own_id", "own_th", "own_at"]).select("doc_id", "th", "start", "from_id", "from_th", "from_at", F.explode(_ranges(F.col("mask"))).alias("r"))
    some = some.select("doc_id", "th", (F.col("start") + F.col("r.from")).alias("at"), F.col("r.size").alias("n"), "from_id", "from_th", (F.col("from_at") + F.col("r.from")).alias("from_at"), F.lit(-1).alias("path"))
    walk = Window.partitionBy("doc_id", "th").orderBy("at")
    same = [F.lag(c).over(walk) == F.col(c) for c in ("from_id", "from_th", "path")] + [F.lag(F.col(c) + F.col("n")).over(walk) == F.col(c) for c in ("at", "from_at")]
    goes_on = F.coalesce(same[0] & same[1] & same[2] & same[3] & same[4], F.lit(False))
    runs = whole.unionByName(some).withColumn("head", F.when(~goes_on, F.col("at"))).withColumn("head", F.last("head", ignorenulls=True).over(walk))
    # rows that repeat a document begin a run each, so its length is where it ends
    spans = runs.groupBy("doc_id", "th", "head").agg((F.max(F.col("at") + F.col("n")) - F.col("head")).alias("n"), F.min("from_id").alias("from_id"), F.min("from_th").alias("from_th"), F.min("from_at").alias("from_at"))
    return spans.withColumnRenamed("head", "at")


_SPAN = ("at", "n", "from_id", "from_th", "from_at")


def _cut(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """`docs` (doc_id, th, text, hits, asked) without the words that the spans `hits` cover; `said` has the
    digest of the words of each span, by its source's coordinates, and of each (at, n) in `asked`, by its own."""

    def digest(words, at, n):
        d = hashlib.sha256(b" ".join(words[at : at + n + window - 1])).digest()
        return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:16], "little", signed=True)

    def run(batches):
        for batch in batches:
            n, gone, kept, said, ends = [], [], [], [], [0]
            for doc, th, text, hits, asked in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), utf8(batch), batch.column("hits").to_pylist(), batch.column("asked").to_pylist()):
                words = left = text.split()
                if hits:
                    covered = np.zeros(len(words) + 1, np.int64)
                    for hit in hits:
                        covered[hit["at"]] += 1
                        covered[hit["at"] + hit["n"] + window - 1] -= 1
                        said.append((hit["from_id"], hit["from_th"], hit["from_at"], hit["n"], *digest(words, hit["at"], hit["n"])))
                    left = [w for w, c in zip(words, np.cumsum(covered).tolist()) if not c]
                said.extend((doc, th, a["at"], a["n"], *digest(words, a["at"], a["n"])) for a in asked or ())
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
                ends.append(len(said))
            fields = list(zip(*said)) or [()] * 6
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            told = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(fields, kinds)], ["id", "th", "at", "n", "d1", "d2"])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "said"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    said = f"array<struct<id:{kind},th:long,at:int,n:int,d1:long,d2:long>>"
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, said {said}" + ", kept_text string" * with_text)


def cut_spans(docs: DataFrame, spans: DataFrame, window: int, with_text: bool = False) -> tuple[DataFrame, int]:
    """The rows of `docs` (doc_id, th, text) without the words under `spans`, and how many source spans
    don't have the words of the spans that name them."""
    spans = stash(spans, "spans")
    hit = F.struct(*_SPAN)
    asked = spans.select("from_id", "from_th", "from_at", "n").distinct()
    none = lambda c: F.lit(None).cast(spans.select(c.alias("c")).schema["c"].dataType)
    ask = F.struct(F.col("from_at").alias("at"), F.col("n").alias("n"))
    both = spans.select("doc_id", "th", hit.alias("hit"), none(ask).alias("ask")).unionAll(asked.select("from_id", "from_th", none(hit), ask))
    named = both.groupBy("doc_id", "th").agg(F.collect_list("hit").alias("hits"), F.collect_list("ask").alias("asked"))
    done = stash(_cut(docs.join(named, ["doc_id", "th"], "left").select("doc_id", "th", "text", "hits", "asked"), window, with_text), "cut")
    told = done.select(F.explode("said").alias("s")).select("s.*").groupBy("id", "th", "at", "n").agg(*(f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("d1", "d2")))
    return done.drop("said"), told.filter("mind1 <> maxd1 or mind2 <> maxd2").count()


def without_repeats(docs: DataFrame, window: int = 50, anchor: int = 8, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (and kept_text) of each row.

    A word is removed if a window of `window` words over it also starts in a
    document with a smaller doc_id. Null and empty texts have no words. A row with
    a null doc_id is neither source nor cut. Rows that repeat a doc_id don't cut
    each other; equal rows give equal results. An empty table gives an empty
    result. Other columns are not read. The work is done when this returns.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    for seed in range(5):
        done, wrong = cut_spans(docs, repeated_spans(docs, window, anchor, seed), window, with_text)
        if not wrong:
            return done
    raise RuntimeError("spans with equal hashes and different words under five sets of hashes")
