"""Groups of alike items out of hash buckets, without all pairs of a large bucket.

Items of a bucket are compared with the bucket's leader, its smallest item; those that are near it are linked with it and
leave, and the others get a leader of their own, for some rounds.  Then what the links so far leave apart in the whole
buckets is compared: pair by pair in buckets of up to PAIRWISE such items, and in larger ones by an exact search that the
caller gives, which doesn't form all pairs.  So two items that share a bucket end in one group if they are near.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .common import written
from .components import components

LEADER_ROUNDS = 3
#: Buckets of up to so many unlinked items are compared pair by pair, so that work is in proportion to items.
PAIRWISE = 64


def _led(members: DataFrame) -> DataFrame:
    """members(key, id, own) of the buckets of two or more with an own member, with their lead.

    Aggregated before the shuffle and joined with one row for each bucket: adaptive execution can split a hot bucket.
    """
    by_key = members.groupBy("key").agg(F.min(F.when(F.col("own"), F.col("id"))).alias("lead"), F.count("*").alias("n"))
    by_key = written(by_key.where("n > 1 and lead is not null").select("key", "lead"), "leads")
    return written(members.join(by_key, "key"), "buckets")


def linked(members: DataFrame, verified: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """members(key, id, own) -> (node, root) of the items in groups of two or more; root is the group's smallest item.

    A pair is looked at if it shares a key that is `own` to one of the two.  verified: pairs(a, b) -> (a, b, ok).
    search: (key, id, root) of large buckets -> pairs(a, b), at least all near ones of unlike root in a bucket.
    """
    left = _led(members)
    buckets, found, differ = left, [], []
    for _ in range(LEADER_ROUNDS):
        pairs = left.where("id <> lead").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()
        checked = verified(written(pairs, "pairs"))
        found.append(checked.where("ok").select("a", "b"))
        differ.append(checked.where("not ok").select("a", "b"))
        apart = left.withColumns({"a": F.least("lead", "id"), "b": F.greatest("lead", "id")}).join(differ[-1], ["a", "b"], "left_semi")
        left = _led(apart.select("key", "id", "own"))
        if not left.limit(1).count():
            break
    roots = written(components(reduce(DataFrame.union, found)), "linked")
    # whoever was near a leader left its bucket: all members of the whole buckets that aren't linked yet are compared
    of = buckets.select("key", "id", "own").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "own", F.coalesce("root", "id").alias("root"))
    split = of.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x < y").select("key", (F.col("n") > PAIRWISE).alias("large"))
    several = written(of.join(split, "key"), "unlinked")
    sizes = {r["large"] for r in several.select("large").distinct().collect()}
    pairs = []
    if False in sizes:
        few = several.where("not large").drop("large")
        found_here = few.where("own").toDF("key", "i", "oi", "r").join(few.toDF("key", "j", "oj", "s"), "key").where("r <> s")
        pairs.append(found_here.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")))
    if True in sizes:
        pairs.append(search(several.where("large").select("key", "id", "root")))
    if pairs:
        pairs = reduce(DataFrame.union, pairs).distinct().join(reduce(DataFrame.union, differ), ["a", "b"], "left_anti")
        more = verified(written(pairs, "pairs")).where("ok").select("a", "b")
        if more.limit(1).count():
            roots = components(roots.toDF("a", "b").union(more))
    return roots
