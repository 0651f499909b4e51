"""Groups of linked items from shared keys, without emitting all pairs of a key's items.

First every item is compared with the least id under each of its keys.  What this links
is one group; only keys whose items still lie in several groups are looked at again, and
there only items of different groups are compared, each pair once: in the first slot in
which it meets.  So every pair that shares a key is either compared or already linked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.llm.common import BROADCAST_IDS, drop, store

#: near(l, r): whether two rows of items are worth a comparison; meets(l, r, slot): whether slot is the first they share.
Near = Callable[[str, str], Column]
Meets = Callable[[str, str, Column], Column]
Verify = Callable[[DataFrame], DataFrame]

#: A key with so many items or fewer has its pairs looked at one by one; a larger one goes by its leader.
FEW = 16

#: Least pairs that are made at a time.
PAIRS_AT_ONCE = 500_000


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); ``component`` is the least id that can be reached.

    In each round every node goes over to its neighbour of least rank, if that is below
    its own; ranks are drawn anew each round, so a share of the nodes of any graph leaves.
    """
    edges = store(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                  .filter("a <> b").distinct(), "links")
    nodes = edges.selectExpr("a AS id").union(edges.selectExpr("b")).distinct()
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        rank = len(moves)
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(rank)).alias("rank"), "b")).alias("to"))
        goes = F.col("to.rank") < F.xxhash64("a", F.lit(rank))
        move = store(least.filter(goes).selectExpr("a AS node", "to.b AS to"), "moves")
        moves.append(move)
        for end in ("a", "b"):
            edges = edges.join(move.withColumnRenamed("node", end), end, "left").withColumn(
                end, F.coalesce("to", end)).drop("to")
        edges = store(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .distinct(), "links")
    placed = nodes.withColumn("node", F.col("id"))
    for move in moves:
        placed = placed.join(move, "node", "left").withColumn("node", F.coalesce("to", "node")).drop("to")
    placed = store(placed, "nodes")
    least = placed.groupBy("node").agg(F.min("id").alias("component"))
    return store(placed.join(least, "node").select("id", "component"), "components")


def _close(pairs: DataFrame, items: DataFrame, near: Near) -> DataFrame:
    """``pairs`` (a, b) whose items are near."""
    left, right = (items.select(F.col("id").alias(end), F.struct(*[c for c in items.columns if c != "id"]).alias(side))
                   for end, side in (("a", "l"), ("b", "r")))
    return pairs.join(left, "a").join(right, "b").filter(near("l", "r")).select("a", "b")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, slot, id, leader) of the keys that at least two items have; the leader has the least id."""
    buckets = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("_last")).filter("leader <> _last")
    return store(keys.join(buckets.select("key", "leader"), "key"), "shared-keys")


def linked_groups(items: DataFrame, shared: DataFrame, near: Near, meets: Meets, verify: Verify) -> tuple[DataFrame, DataFrame]:
    """(id, component) of all linked items, and the links (a, b) that were verified.

    ``items`` has one row for each id and what ``near`` reads; ``shared`` (key, slot, id, leader) has
    the shared keys of each item; a key belongs to one slot.  First each item is compared with two
    leaders, the least and the one it meets most often, so this step has two pairs an item at most.
    """
    met = shared.filter("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("n"))
    chosen = met.groupBy("id").agg(F.min("leader").alias("least"), F.max_by("leader", F.struct("n", "leader")).alias("most"))
    stars = chosen.select(F.explode(F.array_distinct(F.array("least", "most"))).alias("a"), F.col("id").alias("b"))
    first = store(verify(store(_close(stars, items, near), "pairs")), "links")
    groups = components(first)

    placed = shared.join(groups, "id", "left").select("key", "slot", "id", F.coalesce("component", "id").alias("grp"))
    parts = placed.groupBy("key", "grp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "grp")).alias("main"), F.count("*").alias("n_grps"))
    mixed = mixed.filter("n_grps > 1").select("key", F.col("main.grp").alias("main"))
    payload = F.struct(*[c for c in items.columns if c != "id"]).alias("item")
    rows = store(placed.join(mixed, "key").join(items.select("id", payload), "id"), "mixed-keys")
    l, r = rows.filter("grp <> main").alias("l"), rows.alias("r")
    # Both sides of a pair outside the main group would bring it twice.
    once = F.expr("l.key = r.key AND l.grp <> r.grp AND (r.grp = r.main OR l.id < r.id)")
    cross = l.join(r, once & meets("l.item", "r.item", F.col("l.slot")) & near("l.item", "r.item")).select(
        F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    second = store(verify(store(cross, "pairs")), "links")
    links = first.unionByName(second)
    if second.isEmpty():
        return groups, links
    return components(links), links


def linked_by_carried(keys: Sequence[DataFrame], near: Near, meets: Meets, verify: Verify,
                      at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """(id, component) as from ``linked_groups``, for items so small that each key carries its own.

    Each of ``keys`` is (key, id, item), and none has a key of another one: their items are put together
    one after the other, so the disk holds the shuffle of one at a time.  ``near`` and ``meets`` read items,
    and ``meets`` gets the key.
    A key of at most FEW items cannot bring many pairs, so all of its pairs are looked at in one
    join; only the items of larger keys are compared with a leader first and by groups then.
    Pairs of different groups grow with the square of a key's items: they are made and verified in
    rounds of about ``at_once``, and what a round has verified is all that stays of it.
    """
    of_key = Window.partitionBy("key")
    each = [some.select("*", F.count("*").over(of_key).alias("n"), F.min(F.struct("id", "item")).over(of_key).alias("head"))
            for some in keys]
    each = [store(some.filter("n > 1").withColumn("head", F.when(F.col("n") > FEW, F.col("head"))), "shared-keys") for some in each]
    shared = reduce(DataFrame.unionByName, each)
    small = shared.filter(F.col("n") <= FEW).select("key", "id", "item")
    l, r = small.alias("l"), small.alias("r")
    pairs = l.join(r, F.expr("l.key = r.key AND l.id < r.id") & near("l.item", "r.item")
                   & meets("l.item", "r.item", F.col("l.key"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))

    large = shared.filter(F.col("n") > FEW).select("key", "id", "item", "head")
    stars = large.filter("id <> head.id").filter(near("item", "head.item")).select(F.col("head.id").alias("a"), F.col("id").alias("b"))
    candidates = store(pairs.union(stars).distinct(), "pairs")
    first = store(verify(candidates), "links")
    drop(candidates)
    groups = components(first)

    few = groups.count() <= BROADCAST_IDS
    placed = store(large.join(F.broadcast(groups) if few else groups, "id", "left").select(
        "key", "id", "item", F.coalesce("component", "id").alias("grp")), "large-keys")
    drop(*each)
    parts = placed.groupBy("key", "grp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "grp")).alias("main"), F.count("*").alias("n_grps"), F.sum("n").alias("n"))
    mixed = mixed.filter("n_grps > 1").select("key", F.col("main.grp").alias("main"), "n")
    rows = store(placed.join(mixed, "key"), "mixed-keys")
    drop(placed)

    def cross(left: DataFrame, right: DataFrame) -> DataFrame:
        l, r = left.filter("grp <> main").alias("l"), right.alias("r")
        # Both sides of a pair outside the main group would bring it twice.
        once = F.expr("l.key = r.key AND l.grp <> r.grp AND (r.grp = l.main OR l.id < r.id)")
        return l.join(r, once & near("l.item", "r.item") & meets("l.item", "r.item", F.col("l.key"))).select(
            F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))

    rounds = max(1, -(-cross(rows, rows).count() // at_once))
    # A key whose pairs would fill a round has its left rows dealt over all rounds.
    hot, by_key = F.col("n") * F.col("n") > at_once, F.pmod(F.xxhash64("key"), F.lit(rounds))
    by_row = F.pmod(F.xxhash64("key", "id"), F.lit(rounds))
    links = first
    for number in range(rounds):
        left, right = rows, rows
        if rounds > 1:
            left = rows.filter(F.when(hot, by_row).otherwise(by_key) == number)
            right = rows.filter(hot | (by_key == number))
        candidates = store(cross(left, right).distinct(), "pairs")
        found = store(verify(candidates), "links")
        drop(candidates)
        if not found.isEmpty():
            links = links.unionByName(found)
    drop(rows)
    return groups if links is first else components(links)
