"""Groups of similar rows without pair lists: hubs link most of a block, the rest is compared across groups only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersift.operators.components import components
from tiersift.runtime import drop_shuffles, materialize, release


def odd_cells_apart(x, y, words: int) -> Column:
    """How many cells of the hash range hold an odd number of elements of only one of two sets, by their bits ``odd``.

    Every element that only one of the sets has turns one bit: the sets differ in at least as many elements.
    """
    return sum((F.bit_count(F.get(x["odd"], F.lit(i)).bitwiseXOR(F.get(y["odd"], F.lit(i)))) for i in range(words)), F.lit(0))


def _rooted(blocks: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return blocks.withColumn("root", F.col("node"))
    return blocks.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def link_blocks(blocks: DataFrame, verify: Callable[[DataFrame], DataFrame], possible, hub_rounds: int = 2,
                columns: tuple[str, ...] = (), known: DataFrame | None = None, central: Column | None = None,
                details: DataFrame | None = None, close=None) -> DataFrame:
    """``node, root`` of all nodes joined by verified pairs that share a block, as a stored table.

    ``blocks``, a stored table, has ``block, node`` and ``columns``; ``verify`` takes distinct pairs ``a, b`` and
    returns those that link as a stored table; ``possible(left, right)`` is a cheap necessary condition on struct
    columns of two rows of one block; ``known`` are pairs ``a, b`` that link anyway (each b has one a). First every row of a block is compared with one hub of it
    (the least ``central``, another one of equals in every round), which takes as many comparisons as rows and joins whole groups of
    copies. Then only rows of one block that are still in different groups are compared, every one of them,
    so no link between groups is lost; ``close(left, right)`` is a second necessary condition for these, on the columns of
    ``details``, one row a node, that tells most of them apart before a pair is written.
    Tables written on the way are deleted as soon as nothing reads them.
    """
    payload = ("node", *columns)
    tested, links, roots = [], [], None
    if known is not None:
        links.append(known.select("a", "b"))
        roots = known.select(F.col("b").alias("node"), F.col("a").alias("root"))

    def check(pairs: DataFrame, name: str, *spent: DataFrame | None) -> DataFrame:
        nonlocal roots
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        for before in tested:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = materialize(pairs, name)
        release(*spent)
        drop_shuffles(pairs.sparkSession)
        tested.append(pairs)
        links.append(verify(pairs))
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        before, roots = roots, components(every)
        release(before)
        return roots

    def still_mixed(rows: DataFrame) -> DataFrame:
        """Rows, with ``root``, of the blocks that hold several groups."""
        now = _rooted(rows, roots)
        mixed = now.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        return now.join(mixed.select("block"), "block", "left_semi")

    rows = blocks
    for turn in range(hub_rounds):
        seen = _rooted(rows, roots)
        hubs = seen.groupBy("block").agg(
            F.min(F.struct((F.lit(0) if central is None else central).alias("place"),
                           F.xxhash64("node", F.lit(turn)).alias("order"), *payload, "root")).alias("hub"),
            F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        met = seen.join(hubs.select("block", "hub"), "block").filter(F.col("root") != F.col("hub.root"))
        met = met.filter(possible(F.struct(*payload), F.col("hub")))
        check(met.select(F.col("node").alias("x"), F.col("hub.node").alias("y")), f"hub{turn}")
        left = materialize(still_mixed(rows).drop("root"), "mixed")  # a block once of one group stays so
        release(None if turn == 0 else rows)
        rows = left
    left = _rooted(rows, roots)
    extra = ()
    if details is not None:
        left = left.join(details, "node")
        extra = tuple(c for c in details.columns if c != "node")
    left = materialize(left, "left")
    one = left.select("block", F.struct(*payload, "root", *extra).alias("l"))
    two = left.select("block", F.struct(*payload, "root", *extra).alias("r"))
    met = one.join(two, "block").filter("l.node < r.node AND l.root <> r.root").filter(
        possible(F.col("l"), F.col("r")))
    if close is not None:
        met = met.filter(close(F.col("l"), F.col("r")))
    check(met.select(F.col("l.node").alias("x"), F.col("r.node").alias("y")), "rest", left, None if rows is blocks else rows)
    release(*tested, *links)
    return roots
