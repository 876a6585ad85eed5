"""SimHash near-duplicate groups: 64-bit fingerprints, sharded BK-trees, components.

Fingerprints within `radius` bits are linked. Cut into `blocks` blocks, two such
fingerprints agree in blocks - radius of them at least (pigeonhole), so each set
of that many blocks, with its values, names a shard, and every link lies in some
shard. A shard's fingerprints form a BK-tree: a child hangs under its parent at
the integer distance between them, and a search follows only edges whose label is
within the radius of the distance found. No tree leaves its task, so nothing is
broadcast; only links to a shard's smallest reached fingerprint go out, never all
pairs of a group.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, stash, utf8

_SEED = 42
#: Documents whose shingles, or prefixes of these, make one file.
_WIDE = 5000


def words_of(text: bytes) -> list[bytes]:
    """Runs of anything but the six ASCII spaces, A-Z lower-cased: what bytes.lower and split do."""
    return text.lower().split()


def shingles_of(words: list[bytes], k: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words)] if len(words) < k else list(map(b" ".join, zip(*(words[i:] for i in range(k)))))


def fingerprint(shingles: list[bytes], chunk: int = 8192) -> int:
    """Unsigned 64-bit SimHash; a bit is set if over half of the hashes have it."""
    if not shingles:
        return 0
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(shingles), chunk):
        h = np.array([digest(s, _SEED) for s in shingles[i : i + chunk]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, shingle: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    """`docs` with a long column `out`, the fingerprint's 64 bits as a signed number.

    Null and wordless texts get 0.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingles_of(words_of(t), shingle)) for t in utf8(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(fps, np.uint64).view(np.int64))], [*batch.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0).cast("long")).schema)


class BKTree:
    """Integers under Hamming distance; insertion returns all earlier ones in the radius."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, None

    def insert(self, x: int) -> list[int]:
        if self.root is None:
            self.root = (x, {})
            return []
        found = self.search(x)
        value, edges = self.root
        while True:
            d = (value ^ x).bit_count()
            if d not in edges:
                edges[d] = (x, {})
                return found
            value, edges = edges[d]

    def search(self, x: int) -> list[int]:
        found, todo, r = [], [self.root] if self.root else [], self.radius
        while todo:
            value, edges = todo.pop()
            d = (value ^ x).bit_count()
            if d <= r:
                found.append(value)
            if edges:
                for at in range(d - r, d + r + 1):
                    if at in edges:
                        todo.append(edges[at])
        return found


def _choices(free: list[tuple[int, int]], cut: int, agree: int, fixed: int = 0) -> list[tuple[int, list[tuple[int, int]]]]:
    """The ranges of bits `free` are each cut in `cut`; for each choice of `agree` of these parts, the mask of
    their bits and of `fixed`, and the other parts."""
    parts = [(a + (b - a) * k // cut, a + (b - a) * (k + 1) // cut) for a, b in free for k in range(cut)]
    ones = [((1 << (b - a)) - 1) << a for a, b in parts]
    return [(fixed | sum(ones[i] for i in c), [p for i, p in enumerate(parts) if i not in c]) for c in combinations(range(len(parts)), agree)]


def _masks(spark: SparkSession, masks: list[tuple[int, int]]) -> DataFrame:
    """(parent, choice, mask) of the numbered masks with the number of what each refines."""
    rows = [(parent, i, m - (1 << 64) if m >> 63 else m) for i, (parent, m) in enumerate(masks)]
    return F.broadcast(spark.createDataFrame(rows, "parent int, choice int, mask long"))


def _tree_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) in each shard of `rows` (shard, fp). Two shards under one key make a larger tree,
    never a wrong link."""

    def run(batches):
        key, tree, up, a, b = None, None, {}, [], []

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def close():
            for x in up:
                if (y := top(x)) != x:
                    a.append(x)
                    b.append(y)

        for batch in batches:
            for shard, fp in zip(batch.column("shard").to_pylist(), batch.column("fp").to_pylist()):
                if shard != key:
                    close()
                    key, tree, up = shard, BKTree(radius), {}
                for h in tree.insert(fp & 0xFFFFFFFFFFFFFFFF):
                    x, y = top(fp), top(h - (1 << 64) if h >> 63 else h)
                    up[max(x, y)] = min(x, y)
            if len(a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = 3, max_shard: int = 1024, expected: int = 32, dense: int = 12, n: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fps` (fp) that join the same groups as all
    links of at most `radius` bits do. `n`: their number, if known.

    The number of blocks follows the number of fingerprints, so that a shard of
    evenly spread bits holds `expected` at most. What two neighbours differ in lies
    in the `radius` blocks that their shard doesn't name. So a shard of over
    `max_shard` fingerprints (a large group of near copies) is cut again by halves
    of these blocks, `radius` of which must agree, and so on until no more than
    `dense` bits are open: then 2**dense fingerprints are all that it can hold. No
    link is lost, and a fingerprint's work is bounded however large its group is.
    """
    spark, n = fps.sparkSession, fps.count() if n is None else n
    blocks = radius + 1
    while n >> int(64 * (blocks - radius) / blocks) > expected and blocks < 3 * radius:
        blocks += 1
    level = [(0, m, free) for m, free in _choices([(0, 64)], blocks, blocks - radius)]
    first = F.array(*(F.struct(F.lit(i).alias("choice"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for i, (_, m, _) in enumerate(level)))
    cut, ready = fps.select("fp", F.explode(first).alias("m")).select("fp", "m.*"), []
    while True:
        cut = cut.select("fp", "choice", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"))
        cut = cut.dropDuplicates(["fp", "shard"]) if ready else cut
        sizes = stash(cut.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"), "shards", n * len(level) // 2)
        if max(sum(b - a for a, b in free) for *_, free in level) <= dense:
            ready.append(cut.join(sizes, "shard").select("shard", "fp"))
            break
        ready.append(cut.join(sizes.filter(F.col("n") <= max_shard), "shard").select("shard", "fp"))
        large = sizes.filter(F.col("n") > max_shard)
        if not large.limit(1).count():
            break
        rows = stash(cut.join(large, "shard").select("fp", "choice"), "large-shards")
        level = [(i, m, free) for i, (_, fixed, open_) in enumerate(level) for m, free in _choices(open_, 2, radius, fixed)]
        cut = rows.withColumnRenamed("choice", "parent").join(_masks(spark, [(p, m) for p, m, _ in level]), "parent")
    return _tree_links(reduce(DataFrame.unionByName, ready), radius)


def _rooted(fps: DataFrame, radius: int, **sizes) -> DataFrame:
    """`fps` (distinct fp, ...) with root, the smallest fingerprint that each reaches by `links`."""
    n = fps.count()
    roots = connected_components(links(fps.select("fp"), radius, n=n, **sizes), rows=n)
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, **sizes) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of each row.

    Null, empty and wordless texts have fingerprint 0 and are linked like any
    other. Repeated rows give repeated results. A row without doc_id links its
    neighbours but names no group; a group of such rows only has component_id null.
    An empty table gives an empty result. Other columns are not read.
    """
    fps = stash(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "fingerprints")
    named = stash(_rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), radius, **sizes), "named")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(groups, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, _SEED) for s in shingles_of(words_of(text), shingle)], np.uint64)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _parity(hs: np.ndarray, words: int = 16) -> np.ndarray:
    """A bitmap of 64 x `words` bits: whether an odd number of the hashes falls on each. Two sets' bitmaps
    differ in no more bits than the sets have elements that are in one of them only."""
    at = (hs.view(np.uint64) >> np.uint64(20)) % np.uint64(64 * words)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * words) % 2 == 1, bitorder="little").view(np.int64)


def _bands(hs: np.ndarray, bands: int = 8, rows: int = 4) -> np.ndarray:
    """Keys that sets much alike probably have in common: hashes of the least elements of `rows` classes each."""
    least = np.full(bands * rows, -1, np.int64)
    kind, first = np.unique(hs & (bands * rows - 1), return_index=True)
    least[kind] = hs[first]
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(bands, rows))], np.uint64).view(np.int64)


def _hashed(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, hs) of `rows` (node, text): the distinct shingle hashes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists([_shingle_hashes(t, shingle) for t in utf8(batch)])], ["node", "hs"])

    return rows.select("node", "text").mapInArrow(run, "node long, hs array<long>")


def _common(docs: DataFrame, shingle: int, share: int = 16, least: int = 3, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingle hashes, ascending, and their counts in one document of `share`.

    They only order a document's shingles: any order finds all links, and one that
    has frequent shingles last compares fewer pairs.
    """
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").distinct()
    counts = _hashed(some.withColumn("node", F.lit(0).cast("long")), shingle).select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    got = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = got["h"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefixed(docs: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, th (hash of the text), node (hash of the shingle set), n (its size), bits (`_parity`), `bands`
    and pre: so many of its hashes, rarest first, that two sets of `similarity` or more have one of these in common."""
    known, counts = common

    def prefix(hs: np.ndarray) -> np.ndarray:
        if not len(hs):
            return hs
        if len(known):
            at = np.minimum(np.searchsorted(known, hs), len(known) - 1)
            order = np.argsort(np.where(known[at] == hs, counts[at], 0), kind="stable")
            hs = hs[order]
        return hs[: len(hs) - math.ceil(similarity * len(hs) - 1e-9) + 1]

    def run(batches):
        for batch in batches:
            sets = [np.sort(_shingle_hashes(t, shingle)) for t in utf8(batch)]
            nodes = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), _SEED) for s in sets], np.uint64).view(np.int64))
            sizes = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), nodes, sizes, _lists([_parity(s) for s in sets]), _lists([_bands(s) for s in sets]), _lists([prefix(s) for s in sets])], ["doc_id", "th", "node", "n", "bits", "bands", "pre"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, node long, n int, bits array<long>, bands array<long>, pre array<long>")


def _may_be_similar(x: Column, y: Column, p: Column, q: Column, similarity: float) -> Column:
    """False where two sets of p and q elements differ, by their bitmaps, in more elements than `similarity` allows."""
    apart = F.aggregate(F.zip_with(x, y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return apart <= (p + q) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, rows: int) -> DataFrame:
    """Those of the distinct `pairs` (a, b) whose shingle sets have a Jaccard similarity of `similarity` or more."""
    met = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts_ = docs.select("text", F.xxhash64("text").alias("th")).join(nodes.select("node", "th").join(met, "node"), "th")
    sets = stash(_hashed(texts_.dropDuplicates(["node"]), shingle), "sets", rows, _WIDE)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hs").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("p"), F.size("y").alias("q"), F.size(F.array_intersect("x", "y")).alias("o"))
    return stash(both.filter(F.col("o") / (F.col("p") + F.col("q") - F.col("o")) >= similarity).select("a", "b"), "links", rows)


def _led(banded: DataFrame, rows: int, few: int = 8) -> DataFrame:
    """(node, least) pairs of `banded` (node, band): each node with the smallest of its band, and with the
    smallest of about `few` nodes that a hash deals together. A group of sets that are alike, but not all
    like its smallest, falls together by the second."""
    sizes = stash(banded.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("size")).filter("size > 1"), "bands", rows)
    met = stash(banded.join(sizes, "band").withColumn("deal", F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("size") / few))), "banded", rows)
    dealt = stash(met.groupBy("band", "deal").agg(F.min("node").alias("least")), "dealt", rows)
    return met.select("node", "least").union(met.drop("least").join(dealt, ["band", "deal"]).select("node", "least")).filter("node > least")


def near_copies(docs: DataFrame, shingle: int = 3, radius: int = 3, **exact) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable) by links of two kinds: SimHash fingerprints within
    `radius` bits, then those of `similar_groups` (`exact`), which add what fingerprints miss."""
    rows = docs.select(F.xxhash64("text").alias("th"), "text")
    prints = stash(with_fingerprint(rows, shingle).select("th", "fp").distinct(), "fingerprints")
    named = _rooted(prints.select("fp").distinct(), radius)
    return similar_groups(docs, **exact, known=stash(prints.join(named, "fp").select("th", F.col("root").alias("group")), "simhash-groups", prints.count()))


def _same_group(signed: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """Links (a, b) of the nodes of `signed` (th, node) whose texts `known` (th, group) has in one group."""
    met = signed.select("th", "node").join(known, "th").select("node", "group").distinct()
    first = met.groupBy("group").agg(F.min("node").alias("least"), F.count("*").alias("size")).filter("size > 1")
    return stash(met.join(first, "group").filter("node > least").select(F.col("node").alias("a"), F.col("least").alias("b")), "known-links", rows)


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_shard: int = 16384, known: DataFrame | None = None) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable) by links of texts whose shingle sets have a
    Jaccard similarity of `similarity` or more.

    No link is lost and none is false, up to equal 64-bit hashes. Two such sets share
    a hash among the rarest of each (prefix filter), which names a shard. First sets
    with a band of least hashes in common are compared with one or two of these,
    which joins most of a large group of near copies; then members of a shard that
    are still in different groups are compared. Bitmaps of the sets rule out nearly all unlike pairs,
    what is left is compared by the whole sets. A shard of over
    `max_shard` is dealt to several parts, which all of its members meet. Texts of
    one group of `known` (th, hash of the text; group) are linked beforehand. Nulls,
    repeated rows and empty tables are as in `near_duplicates`.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = stash(_prefixed(docs, shingle, similarity, _common(docs, shingle)), "prefixes")
    n = signed.count()
    nodes = stash(signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), *(F.first(c).alias(c) for c in ("n", "bits", "bands", "pre"))), "nodes", n, _WIDE)
    rows = nodes.select("node", "n", F.posexplode("pre").alias("at", "h"))

    def fits(n, at, n_, at_):
        """Sizes and the places of a common hash allow for the similarity: before its first common hash a set has none."""
        return F.least(n - at, n_ - at_) >= (n + n_) * (similarity / (1 + similarity)) - 1e-6

    sizes = stash(rows.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1"), "shards", n, _WIDE)
    shared = stash(rows.join(sizes, "h"), "shared", n, _WIDE)
    led = _led(nodes.select("node", F.explode("bands").alias("band")), 8 * n)
    signs = nodes.select("node", "n", "bits")
    first = led.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    near = first.join(signs.toDF("a", "p", "x"), "a").join(signs.toDF("b", "q", "y"), "b").filter(_may_be_similar(*map(F.col, "xypq"), similarity))
    found = _verified(stash(near.select("a", "b"), "pairs", n), docs, nodes, shingle, similarity, n)
    found = found if known is None else found.union(_same_group(signed, known, n))
    grouped = shared.select("h", "node", "n", "at", "size").join(connected_components(found, rows=n), "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = stash(grouped, "grouped", n, _WIDE)
    mixed = stash(grouped.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("h"), "mixed-shards", n, _WIDE)
    parts = F.ceil(F.col("size") / max_shard).cast("int")
    apart = grouped.join(mixed, "h").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    apart = stash(apart.join(signs.select("node", "bits"), "node"), "apart", n, _WIDE)
    one = apart.select("h", "part", *(F.col(c).alias(f"{c}_") for c in ("node", "n", "at", "root", "bits")))
    two = apart.select("h", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "node", "n", "at", "root", "bits")
    # the conditions are part of the join, so no other pair leaves it
    alike = (F.col("root") < F.col("root_")) & fits(*map(F.col, ("n", "at", "n_", "at_"))) & _may_be_similar(*map(F.col, ("bits", "bits_", "n", "n_")), similarity)
    others = one.join(two.withColumnsRenamed({"h": "h2", "part": "part2"}), (F.col("h") == F.col("h2")) & (F.col("part") == F.col("part2")) & alike)
    others = stash(others.select(F.col("node").alias("a"), F.col("node_").alias("b")).distinct(), "pairs", n)
    roots = connected_components(found.union(_verified(others, docs, nodes, shingle, similarity, n)), rows=n)
    named = stash(nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named", n)
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return signed.select("doc_id", "node").join(named.join(groups, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
