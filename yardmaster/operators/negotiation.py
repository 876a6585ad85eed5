"""Allocation of ranked candidates under fair-share limits, one site at a time.

Matching and ranking are joins over all sites at once. What is left is ordered by
nature, since each match changes what the next may take: a site's submitters are
served in turn. Sites are groups of their own, so they run side by side; a site's
candidates are of its request shapes, not of its requests. Its task holds these as
arrays and lets the requests, sorted by turn, stream past.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "site string, request_id long, submitter string, slot long, cost double, seq int, reason string"
_RESULT = pa.schema([("site", pa.string()), ("request_id", pa.int64()), ("submitter", pa.string()), ("slot", pa.int64()), ("cost", pa.float64()), ("seq", pa.int32()), ("reason", pa.string())])
_OFFER, _ASK = 0, 1


def submitter_order(submitters: DataFrame) -> list:
    """Best priority first, then the most starved, then by a spread of the time heard from, then as they came."""
    return [F.asc("prio"), F.asc("starvation"), F.asc(F.col("LastHeardFrom") % 1009), F.asc("index")]


def negotiate(requests: DataFrame, candidates: DataFrame, limits: DataFrame) -> DataFrame:
    """Matches (slot not null) and rejections of each site.

    `requests`: site, request_id, submitter, shape, count; `candidates`: site, shape,
    place (their order), slot, cost, partitionable; `limits`: site, submitter, turn,
    submitter_limit, headroom. A static slot is used up by a match, a partitionable
    one isn't. After one rejection, later requests of that shape and submitter are
    passed over.
    """
    first = limits.groupBy("site", "submitter").agg(F.min(F.struct("turn", "submitter_limit", "headroom")).alias("limit"))
    of_site = (F.col("asked.site") == F.col("first.site")) & F.col("asked.submitter").eqNullSafe(F.col("first.submitter"))
    asks = requests.alias("asked").join(first.alias("first"), of_site).select(F.lit(_ASK).alias("kind"), "asked.*", "limit.*")
    rows = candidates.withColumn("kind", F.lit(_OFFER)).unionByName(asks, allowMissingColumns=True)
    order = ["site", "kind", "turn", "submitter", "request_id", "shape", "count", "place", "slot", "cost", "partitionable"]
    rows = rows.select(*order, "submitter_limit", "headroom").repartition("site").sortWithinPartitions(*order)
    return rows.mapInArrow(_negotiated, RESULT)


class _Offers:
    """A shape's candidates in their order. The first that is free and whose price is among the lowest
    `prices` is found by descent in a tree of least prices; one found gone leaves the tree."""

    def __init__(self, slots: np.ndarray, costs: np.ndarray, partitionable: np.ndarray):
        self.slots, self.costs, self.partitionable = slots, costs, partitionable
        prices, rank = np.unique(costs, return_inverse=True)
        self.prices, self.out = prices.tolist(), len(prices)
        self.leaves = n = 1 << (len(slots) - 1).bit_length()
        tree = np.full(2 * n, self.out, np.int32)
        tree[n : n + len(slots)] = rank
        while n > 1:
            tree[n // 2 : n] = np.minimum(tree[n : 2 * n : 2], tree[n + 1 : 2 * n : 2])
            n //= 2
        self.tree = array("i", tree.tobytes())

    def affordable(self, used: float, most: float) -> int:
        """How many of the prices fit what is left; any, if this is the first match and something is allowed."""
        return self.out if used <= 0 < most else bisect_left(self.prices, True, key=lambda p: not used + p <= most)

    def first(self, prices: int, gone: set[int]) -> int | None:
        tree, n = self.tree, self.leaves
        while tree[1] < prices:
            i = 1
            while i < n:
                i *= 2
                i += tree[i] >= prices
            if self.slots[i - n] not in gone:
                return i - n
            tree[i] = self.out
            while i > 1:
                i //= 2
                tree[i] = min(tree[2 * i], tree[2 * i + 1])
        return None


def _offers(parts: list[pa.RecordBatch]) -> dict[int, _Offers]:
    """A site's candidates by shape; `parts` are sorted by shape and place."""
    if not parts:
        return {}
    table = pa.Table.from_batches(parts)
    shape, slot, cost, lasting = (table.column(c).to_numpy() for c in ("shape", "slot", "cost", "partitionable"))
    ends = [0, *(np.flatnonzero(shape[1:] != shape[:-1]) + 1).tolist(), len(shape)]
    return {int(shape[a]): _Offers(slot[a:b], cost[a:b], lasting[a:b]) for a, b in zip(ends, ends[1:])}


def _negotiated(batches, rows: int = 20_000):
    """Results of the sites that come by, each as its candidates and then its requests by turn and id."""
    site, out = None, []
    for batch in batches:
        sites, kinds = (batch.column(c).to_pylist() for c in ("site", "kind"))
        at = 0
        while at < len(sites):
            end = at + 1
            while end < len(sites) and sites[end] == sites[at] and kinds[end] == kinds[at]:
                end += 1
            part = batch.slice(at, end - at)
            if sites[at] != site:
                site, parts, lists, gone, seq = sites[at], [], None, set(), 0
            if kinds[at] == _OFFER:
                parts.append(part.select(["shape", "slot", "cost", "partitionable"]))
            else:
                if lists is None:
                    lists, parts, turn = _offers(parts), [], None
                columns = ("turn", "submitter", "request_id", "shape", "count", "submitter_limit", "headroom")
                for place, who, request, shape, count, limit, headroom in zip(*(part.column(c).to_pylist() for c in columns)):
                    if (place, who) != turn:
                        turn, used, refused, most = (place, who), 0.0, set(), min(limit, headroom)
                    for _ in range(int(count)):
                        if shape in refused:
                            break
                        offers = lists.get(shape)
                        pick = None if offers is None else offers.first(offers.affordable(used, most), gone)
                        if pick is None:
                            free = offers is not None and offers.first(offers.out, gone) is not None
                            out.append((site, request, who, None, None, seq, "submitter limit exceeded" if free else "no match found"))
                            refused.add(shape)
                        else:
                            slot, cost = int(offers.slots[pick]), float(offers.costs[pick])
                            out.append((site, request, who, slot, cost, seq, None))
                            used += cost
                            if not offers.partitionable[pick]:
                                gone.add(slot)
                        seq += 1
                    if len(out) >= rows:
                        yield _batch(out)
                        out = []
            at = end
    yield _batch(out)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out) if out else [()] * len(_RESULT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)


def match_records(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deliveries in the order of decision, and rejections with the mark of shape and request.

    A sort samples its input for its ranges, so it is given a shuffle's output: else the sites negotiate twice.
    """
    matches = results.filter("slot is not null").repartition("site", "seq").orderBy("site", "seq")
    rejected = results.filter("slot is null").withColumn("message", F.format_string("%s |%s|", "reason", F.col("request_id").cast("string")))
    return matches, rejected


def cycle_stats(results: DataFrame) -> DataFrame:
    return results.agg(F.count("slot").alias("matches"), F.sum(F.when(F.col("slot").isNull(), 1).otherwise(0)).alias("rejections"), F.countDistinct("submitter").alias("submitters"), F.countDistinct("site").alias("sites"))
