"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is `length` consecutive item words; a shorter item is one window. The
hashes of the `gram`-word grams in a window are winnowed: their minimum is the
window's fingerprint, so equal windows have equal fingerprints and every shared
span of `length` words is found. Consecutive document windows with one fingerprint
are a run; runs whose fingerprint is an item's are extended: each of their windows
is compared, as text, with the items' windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: What lies between words, once A-Z is lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints broadcast at once: 16 bytes each, so 32 MB in memory or little more.
BLOCK = 1_000_000


def let(value: Column, body) -> Column:
    """`body` of `value`, with `value` computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _fingerprints(ws: Column, length: int, gram: int) -> Column:
    """The fingerprint of each window of `length` words: sliding minima of gram hashes."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - gram), lambda i: F.xxhash64(F.slice(ws, i + 1, gram)))
    have, want, out = 1, length - gram + 1, hashes

    def lower(x: Column, step: int) -> Column:
        return let(x, lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - step), F.slice(a, F.lit(step + 1), F.size(a) - step), lambda p, q: F.least(p, q)))

    while 2 * have <= want:
        out, have = lower(out, have), 2 * have
    return lower(out, want - have) if want > have else out


def _runs(ws: Column, length: int, gram: int, short: list[int]) -> Column:
    """(fp, at, n, len, span): n windows of len words from word `at` on share fingerprint fp; span has their words."""

    def run(fp, at, n, size):
        return F.struct(fp.alias("fp"), at.alias("at"), n.alias("n"), F.lit(size).alias("len"), F.slice(ws, at + 1, n + size - 1).alias("span"))

    empty = F.array().cast("array<struct<fp:bigint,at:int,n:int,len:int,span:array<string>>>")

    def joined(fps: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(fps) - 1), lambda i: (i == 0) | (fps[i] != fps[F.greatest(i - 1, F.lit(0))]))
        return let(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(fps))), lambda a, b: run(fps[a], a, b - a, length)))

    parts = [F.when(F.size(ws) >= length, let(_fingerprints(ws, length, gram), joined)).otherwise(empty)]
    def whole(k: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: run(F.xxhash64(F.slice(ws, i + 1, k)), i, F.lit(1), k))
        return F.when(F.size(ws) >= k, each).otherwise(empty)

    parts += map(whole, short)
    return F.concat(*parts)


def _windows(runs: DataFrame) -> DataFrame:
    """A row for each window of the runs, with its text."""
    step = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    return runs.withColumn("step", step).withColumn("at", F.col("at") + F.col("step")).withColumn("window", F.array_join(F.slice("span", F.col("step") + 1, F.col("len")), " ")).drop("span", "n", "step")


def hits_of(docs: DataFrame, items: DataFrame, length: int = 10, gram: int = 5) -> DataFrame:
    """(doc_id, th, n_hit, items) of the rows of `docs` (doc_id, th, text) that hold a window of `items`."""
    known = stash(items.select("item_id", words(F.col("text")).alias("ws")).filter("size(ws) > 0"), "items")
    n = known.count()
    short = sorted(r[0] for r in known.filter(F.size("ws") < length).select(F.size("ws")).distinct().collect())  # below `length`
    laid = known.select("item_id", F.explode_outer(_runs(F.col("ws"), length, gram, [])).alias("r")).select("item_id", "r.*").filter("fp is not null")
    if short:
        whole = known.filter(F.size("ws") < length).select("item_id", F.xxhash64("ws").alias("fp"), F.lit(0).alias("at"), F.lit(1).alias("n"), F.size("ws").alias("len"), F.col("ws").alias("span"))
        laid = laid.unionByName(whole)
    prints = stash(laid.select("fp", "len").distinct().withColumn("block", F.lit(0)), "prints", n, each=1000)
    blocks = max(1, -(-prints.count() // BLOCK))
    held = _windows(laid).groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    held = stash(held.withColumn("key", F.xxhash64("window")), "windows", n, each=1000)

    # explode_outer: a filter inferred from explode would repeat the whole expression below it
    laid_out = let(words(F.col("text")), lambda ws: _runs(ws, length, gram, short))
    runs = docs.select("doc_id", "th", F.explode_outer(laid_out).alias("r")).select("doc_id", "th", "r.*")
    met = None
    for block in range(blocks):  # each broadcast holds about BLOCK fingerprints, counted above
        part = prints.filter(F.pmod("fp", F.lit(blocks)) == block).select("fp", "len")
        found = runs.join(F.broadcast(part), ["fp", "len"])
        met = found if met is None else met.unionByName(found)
    hits = _windows(met.drop("fp")).withColumn("key", F.xxhash64("window"))
    hits = hits.join(held, ["key", "window"]).groupBy("doc_id", "th")
    covered = F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("len") - 1)))
    return hits.agg(F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, gram: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of `docs` (doc_id, text).

    n_hit counts the words inside an occurrence of a window of `items` (item_id,
    text); n_items the items with occurring windows; items_sha256 is the digest of
    their ids, sorted as strings and comma-joined. Null, empty and wordless texts
    have no words and no hits; items without words have no windows. A null item_id
    hits but isn't counted or named. Equal rows give equal results. Empty tables
    give no hits or no rows. Other columns are not read.
    """
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    hits = hits_of(own, items, length, gram)
    counted = own.select("doc_id", "th", F.size(words(F.col("text"))).cast("long").alias("n_words")).alias("d")
    out = counted.join(hits.alias("h"), F.expr("d.doc_id <=> h.doc_id and d.th = h.th"), "left")
    items_ = F.coalesce("h.items", F.array().cast("array<string>"))
    n_hit = F.coalesce("h.n_hit", F.lit(0)).cast("long")
    return out.select(
        "d.doc_id", "d.n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


SQL = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), iw as (
  select item_id, least(len(w), 10) as n, unnest(list_transform(range(0, greatest(len(w) - 10, 0) + 1), lambda i: array_to_string(list_slice(w, i + 1, i + 10), ' '))) as win
  from b where len(w) > 0
), dw as (
  select doc_id, n, p0, array_to_string(list_slice(w, p0 + 1, p0 + n), ' ') as win
  from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as p0 from d, (select distinct n from iw) where len(w) >= n)
), hit as (
  select distinct doc_id, p0, n, item_id from dw join iw using (n, win)
), c as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(p0, p0 + n)) as p from hit) group by doc_id
), i as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join i using (doc_id)
"""
