"""Hierarchical groups: membership, quotas, fair share and its round driver.

A configuration of groups is small; quotas are handed down one tree level a join.
Surplus sharing is a fixpoint over that tree and runs on its collected nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ROOT_GROUP, ancestors

#: Nodes of a configuration that are collected at most.
MAX_GROUPS = 10_000


def group_table(spark: SparkSession, config: list[dict]) -> DataFrame:
    """(name, parent, depth, quota, static, accept_surplus, autoregroup) of valid groups, and the root.

    A group whose parent isn't there, a repeated one (whatever the case) and the
    root's own name are passed over; dynamic quotas are held to 0..1.
    """
    seen, rows = {ROOT_GROUP}, [(ROOT_GROUP, None, 0, 0.0, True, True, False)]
    for g in sorted(config, key=lambda g: g["name"].lower()):
        name = g["name"]
        above = name.rpartition(".")[0]
        if name.lower() in seen or above and above.lower() not in seen:
            continue
        static = bool(g.get("static", True))
        quota = max(0.0, float(g.get("quota", 0.0)))
        seen.add(name.lower())
        rows.append((name, above or ROOT_GROUP, name.count(".") + 1, quota if static else min(quota, 1.0), static, bool(g.get("accept_surplus", False)), bool(g.get("autoregroup", False))))
    return spark.createDataFrame(rows, "name string, parent string, depth int, config double, static boolean, accept_surplus boolean, autoregroup boolean")


def negotiating_group(submitters: DataFrame, groups: DataFrame, name: str = "name") -> DataFrame:
    """Each submitter with the deepest configured group above it, whatever the case; else the root."""
    path = F.regexp_extract(F.col(name), r"^(.*)\.[^.]*@[^@]*$", 1)
    exploded = submitters.withColumn("_at", F.explode_outer(ancestors(F.lower(path))))
    known = groups.filter("depth > 0").select(F.lower("name").alias("_at"), F.col("name").alias("_group"), "depth")
    best = exploded.join(known, "_at", "left").groupBy(*(F.col(c) for c in submitters.columns)).agg(F.max_by("_group", "depth").alias("group"))
    return best.withColumn("group", F.coalesce("group", F.lit(ROOT_GROUP)))


def assign_quotas(groups: DataFrame, total: float, oversubscribe: bool = False) -> DataFrame:
    """`groups` with quota (what a node keeps for itself) and subtree_quota (what it was handed)."""
    depth = groups.agg(F.max("depth")).first()[0]
    level = groups.filter("depth = 0").withColumn("subtree_quota", F.lit(float(total)))
    done = None
    for d in range(depth + 1):
        children = groups.filter(F.col("depth") == d + 1)
        sums = children.groupBy("parent").agg(F.sum(F.when(F.col("static"), F.col("config")).otherwise(0.0)).alias("s"), F.sum(F.when(~F.col("static"), F.col("config")).otherwise(0.0)).alias("d"))
        q = F.col("subtree_quota")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        by = level.join(sums.withColumnRenamed("parent", "name"), "name", "left")
        static_part = zero("s") if oversubscribe else F.least(zero("s"), q)
        by = by.withColumn("sqa", static_part).withColumn("dqa", F.greatest(F.lit(0.0), q - F.col("sqa")))
        handed = by.select(F.col("name").alias("parent"), "sqa", "dqa", F.when(zero("s") > 0, zero("s")).otherwise(1.0).alias("zs"), F.greatest(zero("d"), F.lit(1.0)).alias("zd"), (q > 0).alias("some"))
        below = children.join(handed, "parent").withColumn("subtree_quota", F.when(~F.col("some"), 0.0).when(F.col("static"), F.col("config") * F.col("sqa") / F.col("zs")).otherwise(F.col("config") * F.col("dqa") / F.col("zd")))
        below = below.select(*groups.columns, "subtree_quota")
        given = below.groupBy("parent").agg(F.sum("subtree_quota").alias("given")).withColumnRenamed("parent", "name")
        keeps = F.when(F.lit(oversubscribe) & (F.col("depth") > 0), q).otherwise(F.greatest(F.lit(0.0), q - zero("given")))
        here = level.join(given, "name", "left").select(*groups.columns, keeps.alias("quota"), "subtree_quota")
        done = here if done is None else done.unionByName(here)
        level = below
    return done


def subtree_sums(groups: DataFrame, value: str, out: str) -> DataFrame:
    """`groups` with the sum of `value` over each node and all below it."""
    up = groups.select(F.explode(F.when(F.col("name") == ROOT_GROUP, F.array(F.lit(ROOT_GROUP))).otherwise(F.concat(ancestors("name"), F.array(F.lit(ROOT_GROUP))))).alias("name"), value)
    return groups.join(up.groupBy("name").agg(F.sum(value).alias(out)), "name", "left")


@dataclass
class Group:
    """A node of the collected configuration."""

    name: str
    quota: float = 0.0
    subtree_quota: float = 0.0
    requested: float = 0.0
    usage: float = 0.0
    static: bool = True
    config: float = 0.0
    accept_surplus: bool = False
    autoregroup: bool = False
    rr_time: float = 0.0
    allocated: float = 0.0
    wanting: float = 0.0
    served: bool = False
    parent: Group | None = None
    children: list[Group] = field(default_factory=list)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def collected(groups: DataFrame) -> Group:
    """The tree on the driver; a configuration of over MAX_GROUPS nodes is refused."""
    rows = groups.limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    known = {f for f in Group.__dataclass_fields__ if f not in ("parent", "children")}
    nodes = {r["name"]: Group(**{k: v for k, v in r.asDict().items() if k in known and v is not None}) for r in rows}
    for r in sorted(rows, key=lambda r: (r["depth"], r["name"].lower())):
        if r["parent"]:
            nodes[r["name"]].parent = nodes[r["parent"]]
            nodes[r["parent"]].children.append(nodes[r["name"]])
    return nodes[ROOT_GROUP]


def fair_share(node: Group) -> float:
    """Grant each group what it asks within its quota, then share what is over; returns what is left."""
    node.allocated = min(node.requested, node.quota)
    node.requested -= node.allocated
    node.wanting, surplus = node.requested, node.quota - node.allocated
    for child in node.children:
        surplus += fair_share(child)
        node.wanting += child.wanting if child.accept_surplus else 0.0
    return _share(node, surplus) if node.children else surplus


def _share(node: Group, surplus: float) -> float:
    if surplus <= 0:
        return 0.0
    if node.wanting <= 0:
        return surplus
    # the node itself stands beside its children, by its own quota and request
    peers = [(c, c.wanting, c.subtree_quota) for c in node.children if c.accept_surplus and c.wanting > 0] + [(node, node.requested, node.quota)] * (node.requested > 0)
    grants = [0.0] * len(peers)
    wants = [w for _, w, _ in peers]
    if surplus >= sum(wants):
        grants, surplus = wants, surplus - sum(wants)
    else:
        for weights in ([q for _, _, q in peers], [1.0] * len(peers)):
            while surplus > 0 and (total := sum(q for q, w, g in zip(weights, wants, grants) if w > g)) > 0:
                gifts = [min(w - g, surplus * q / total) if w > g else 0.0 for q, w, g in zip(weights, wants, grants)]
                capped = any(0 < w - g <= surplus * q / total for q, w, g in zip(weights, wants, grants))
                grants = [g + x for g, x in zip(grants, gifts)]
                surplus = max(0.0, surplus - sum(gifts)) if capped else 0.0
    for (peer, _, _), grant in zip(peers, grants):
        if peer is node:
            node.allocated, node.requested = node.allocated + grant, node.requested - grant
        elif grant > 0:
            _share(peer, grant) if peer.children else _take(peer, grant)
        node.wanting -= grant
    return surplus


def _take(leaf: Group, grant: float) -> None:
    leaf.allocated, leaf.requested, leaf.wanting = leaf.allocated + grant, leaf.requested - grant, leaf.wanting - grant


def whole_slots(root: Group, surplus: float) -> float:
    """For pools of unweighted slots: fractions return to the surplus, which goes out in whole slots,
    to who waited longest, then by larger quota, then by larger request."""
    for n in root.walk():
        part = n.allocated - math.floor(n.allocated)
        n.allocated -= part
        n.requested, surplus = math.floor(n.requested + part + 0.5), surplus + part
    surplus = math.floor(surplus + 0.5)
    queue = sorted((n for n in root.walk() if n.requested > 0 and (n.accept_surplus or n is root or n.allocated < n.quota)), key=lambda n: (n.rr_time, -n.subtree_quota, -n.requested))
    while surplus >= 1 and (left := [n for n in queue if n.requested >= 1]):
        most = max(1, math.floor(surplus / sum(n.requested for n in left)))
        for n in left:
            gift = min(most, n.requested, surplus)
            n.allocated, n.requested, surplus, n.served = n.allocated + gift, n.requested - gift, surplus - gift, True
    return surplus


def strict_limit(node: Group, slots: float, subtree_usage: Callable[[Group], float]) -> float:
    """`slots` held to what each group above that accepts no surplus has left."""
    new, at = slots - node.usage, node
    while at is not None:
        if not at.accept_surplus and at.parent is not None:
            new = min(new, max(0.0, (at.config if at.static else at.subtree_quota) - subtree_usage(at)))
        at = at.parent
    return new + node.usage


def group_rounds(root: Group, total: float, negotiate: Callable[[str, float], float], weighted: bool = True, preemption: bool = False, rounds: int = 3, order: Callable[[Group], float] | None = None) -> None:
    """Allocate and negotiate, up to `rounds` times: what a group couldn't use goes round again.

    `negotiate(name, slots)` returns the group's usage afterwards. Groups that are
    emptiest for their quota come first, the root last if any group regroups.
    """
    nodes = list(root.walk())
    regroup = any(n.autoregroup for n in nodes)
    emptiness = order or (lambda n: n.usage / n.quota if n.quota > 0 else math.inf)
    for _ in range(rounds):
        left = fair_share(root)
        if not weighted:
            whole_slots(root, left)
        if regroup:
            root.quota = root.allocated = total
        line = sorted(range(len(nodes)), key=lambda i: (regroup and nodes[i] is root, emptiness(nodes[i]), i))
        for n in (nodes[i] for i in line):
            if n.allocated > 0 and (preemption or n.usage < n.allocated):
                slots = max(n.allocated, n.quota) if preemption else n.allocated
                slots = strict_limit(n, slots if weighted else math.floor(slots), lambda g: sum(x.usage for x in g.walk()))
                n.usage = negotiate(n.name, slots)
        wanted = sum(n.allocated for n in nodes)
        for n in nodes:
            n.requested = n.usage if n.usage < n.allocated else n.requested + n.allocated
        if sum(min(n.usage, n.allocated) for n in nodes) >= wanted:
            break
