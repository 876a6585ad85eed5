"""Exact top-k search by distributed histogram selection.

Queries and candidates are dealt to blocks of bounded size, and every pair of
blocks is scored: a stated query set against all rows. Query blocks go to the
candidates, broadcast in counted groups; candidates stay where they are. A pass counts each
query's scores in a histogram over a range that holds its kth best score, and the
summed histogram narrows the range to one bin. When a bin is one score wide, the
kth value is known; a last pass keeps what reaches it, ties by smaller id. A pair
of blocks reports only bins from its own kth best score up, which the global one
can't be below, so a report has about k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stash

#: The range of scores, that of a long; integer vectors only leave it with components over 2**28 or so.
_LOW, _TOP = -(1 << 63), (1 << 63) - 1
#: Query vectors broadcast at once hold so many components: 64 MB.
_GROUP = 1 << 23


def integer_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v): v has floor(scale * x) of each component; rows that can't be scored are left out."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return table.filter(F.col(id_column).isNotNull() & x.isNotNull() & fine).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: F.floor(scale * c.cast("double"))).alias("v"))


def _blocks(rows: DataFrame, key: str, n: int, *columns: str) -> DataFrame:
    """A row for each block of about equally many rows, dealt by the hash of id."""
    dealt = rows.withColumn(key, F.pmod(F.xxhash64("id", F.size("v")), F.lit(n)).cast("int"))
    return dealt.groupBy(key, F.size("v").alias("dim")).agg(F.collect_list(F.struct("id", "v", *columns)).alias(f"{key}_rows"))


def _matrix(rows: pa.StructScalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    values = rows.values
    ids = values.field("id").to_numpy(zero_copy_only=False)
    return ids, values.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, a row for each query: exact in the range of a long, beyond it its ends."""
    largest = lambda x: int(max(abs(int(x.min())), abs(int(x.max())))) if x.size else 0
    if largest(q) * largest(c) * max(1, q.shape[1]) < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, _LOW, _TOP).astype(np.int64)


def _joined(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64))


def _cells(queries: DataFrame, candidates: DataFrame, n_q: int, group: int) -> list[DataFrame]:
    """Each pair of a query block and a candidate block, `group` query blocks a frame, which are broadcast."""
    blocks = stash(_blocks(queries, "q", n_q, "lo", "width"), "query-blocks")
    return [candidates.join(F.broadcast(blocks.filter(F.col("q").between(i, i + group - 1))), "dim") for i in range(0, n_q, group)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return frames[0] if len(frames) == 1 else _union([a.unionAll(b) for a, b in zip(frames[::2], frames[1::2])] + frames[len(frames) & ~1 :])


def _above(s: np.ndarray, lo: int, width: int, bins: int) -> np.ndarray:
    """The bin of each score from `lo` up; differences of longs are taken unsigned, so none overflows."""
    apart = s.view(np.uint64) - np.int64(lo).view(np.uint64)
    return np.minimum(apart // np.uint64(width), np.uint64(bins)).astype(np.int64)


def _histograms(cells: DataFrame, k: int, bins: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                ids, q = _matrix(batch.column("q_rows")[i], dim)
                spec = batch.column("q_rows")[i].values
                lo, width = (spec.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "width"))
                c_ids, c = _matrix(batch.column("c_rows")[i], dim)
                scores = _scores(q, c)
                out = [[], [], []]
                for j in np.flatnonzero(width):
                    s = scores[j][c_ids != ids[j]]
                    if len(s) > k:  # the global kth best is no lower than this block's
                        s = s[s >= np.partition(s, len(s) - k)[len(s) - k]]
                    found, n = np.unique(_above(s[s >= lo[j]], lo[j], width[j], bins), return_counts=True)
                    for column, x in zip(out, (np.full(len(found), ids[j]), found, n)):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([_joined(x) for x in out], ["id", "bin", "n"])

    return cells.mapInArrow(run, "id long, bin long, n long")


def _reaching(cells: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                ids, q = _matrix(batch.column("q_rows")[i], dim)
                lo = batch.column("q_rows")[i].values.field("lo").to_numpy(zero_copy_only=False)
                c_ids, c = _matrix(batch.column("c_rows")[i], dim)
                scores = _scores(q, c)
                out = [[], [], []]
                for j in range(len(ids)):
                    at = np.flatnonzero((scores[j] >= lo[j]) & (c_ids != ids[j]))
                    if len(at) > k:  # ties with the kth value may be many
                        at = at[np.lexsort((c_ids[at], -scores[j][at]))[:k]]
                    for column, x in zip(out, (np.full(len(at), ids[j]), c_ids[at], scores[j][at])):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([_joined(x) for x in out], ["query_id", "vec_id", "score"])

    return cells.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, bins: int = 2048, query_block: int = 256, candidate_block: int = 4096, group_size: int = _GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` highest inner products of each query (id, v) among `vectors` (id, v).

    A candidate with the query's own id is passed over. Fewer candidates than k
    are all returned; none gives no row. Ties go to the smaller id; equal rows
    are candidates each, and of rows that share a query's id the smallest vector
    asks. Vectors of different lengths have no score. A score beyond the range of a
    long is that range's end. No queries or no vectors give an empty result.
    `group_size` bounds the components of the query vectors broadcast at once.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, rows=4)
    queries = stash(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n_c, longest = vectors.agg(F.count("*"), F.max(norm)).first()
    n, size = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    n_q = max(1, -(-n // query_block))
    group = max(1, group_size // max(1, (size or 1) * query_block))
    candidates = stash(_blocks(vectors, "c", max(1, -(-n_c // candidate_block))), "candidates")
    # the product of the lengths bounds a score; one beyond a long's range is its end
    reach = F.least(norm * F.lit(float(longest or 0.0)) * 1.000001 + 1, F.lit(float(_TOP))).cast("long")
    width = F.greatest(F.ceil((reach.cast("double") * 2 + 2) / bins).cast("long"), F.lit(1))
    lowest = F.when(reach == _TOP, F.lit(_LOW)).otherwise(-reach)
    state = stash(queries.select("id", "v", lowest.alias("lo"), width.alias("width")), "ranges")
    best_first = Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = lambda c: F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")
    while state.filter("width > 0").limit(1).count():
        sums = _union([_histograms(cells, k, bins) for cells in _cells(state, candidates, n_q, group)]).groupBy("id", "bin").agg(F.sum("n").alias("n"))
        # the highest bin that, with those above, holds k scores; the range's lowest if there are fewer
        held = sums.withColumn("so_far", F.sum("n").over(best_first)).groupBy("id").agg(F.max(F.when(F.col("so_far") >= k, F.col("bin"))).alias("bin"))
        bin_ = F.when(F.col("bin").isNotNull(), F.least("bin", F.lit(bins))).otherwise(0)  # least passes over nulls
        nearer = state.join(held, "id", "left").withColumn("lo", F.least(wide("lo") + wide(bin_) * wide("width"), F.lit(_TOP).cast("decimal(20,0)")).cast("long"))
        # a bin one score wide is the kth value; width 0 marks that
        state = stash(nearer.select("id", "v", "lo", F.when((F.col("width") <= 1) | F.col("bin").isNull(), 0).otherwise(F.ceil(F.col("width") / bins)).cast("long").alias("width")), "ranges")
    ranked = _union([_reaching(cells, k) for cells in _cells(state, candidates, n_q, group)])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
