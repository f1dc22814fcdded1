"""Parent-child links to full hierarchies, as nested sets.

Subtree sizes are summed upward, siblings get preorder ranges by prefix sums downward, and a node's ancestors and
descendants, its depth and its root are then found from the ranges. Both passes use doubled jumps (to the 1st, 2nd, 4th,
8th ... ancestor) over the nodes that are still open, so a forest of depth d takes about log2(d) rounds of joins, not d.
Nodes whose jumps never end run into a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.operators.prefix import with_prefix_sums
from verseloom.runtime import Scratch, drop_materialized, materialize

#: Width of the preorder blocks by which ranges meet their nodes, and of those that one task sweeps.
BLOCK, SWEEP = 4096, 65_536


def tidy_id(name: Column) -> Column:
    """An id without white space around it, in lower case; a blank one is null."""
    bare = F.lower(F.regexp_replace(name.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def first_parents(links: DataFrame, child: str, parent: str, ordinal: str | None = None, tidy: bool = True) -> DataFrame:
    """``id`` and ``parent``: for each child its non-null parent with the lowest ordinal (null ordinals last, ties by the
    least parent). Children whose parents are all null have no row. Repeated links count once."""
    clean = tidy_id if tidy else (lambda c: c)
    named = links.select(clean(F.col(f"`{child}`")).alias("id"), clean(F.col(f"`{parent}`")).alias("parent"), (F.col(f"`{ordinal}`") if ordinal else F.lit(0)).alias("o"))
    named = named.where("id IS NOT NULL AND parent IS NOT NULL")
    return named.groupBy("id").agg(F.min(F.struct(F.col("o").isNull().alias("n"), "o", "parent")).alias("x")).select("id", F.col("x.parent").alias("parent"))


class Hierarchy:
    """The forest of a table of ``id`` and ``parent`` with at most one row per id (see :func:`first_parents`).

    ``nodes``, a table in the shared folder: ``id``, ``parent``, ``root``, ``depth`` (links to the root), ``size`` (of the
    subtree, itself included), ``pre`` and ``last``: the descendants of a node are the nodes with ``pre`` in
    ``(pre, last]``. A parent that has no row is a root. Where the chain of parents runs into a cycle, ``depth`` is -1,
    ``root`` the least id on the cycle, ``in_cycle`` tells nodes on it from those that lead to it, and the rest is null.
    A row whose parent is itself is a cycle of one. Null ids or parents are left out; an empty table gives no nodes.
    """

    def __init__(self, parents: DataFrame):
        scratch = Scratch()
        links = scratch(parents.where("id IS NOT NULL AND parent IS NOT NULL").groupBy("id").agg(F.max("parent").alias("parent")), "links")
        sizes, lost = self._sizes(links, scratch)
        heads = links.select(F.col("parent").alias("id")).distinct().join(links.select("id"), "id", "left_anti")
        every = links.unionByName(heads.withColumn("parent", F.lit(None).cast(links.schema["parent"].dataType)))
        if lost is not None:
            every = every.join(lost.select("id"), "id", "left_anti")
        sized = scratch(every.join(sizes, "id", "left").withColumn("size", F.coalesce("size", F.lit(0)) + 1), "sizes")
        widest = sized.groupBy("parent").count().agg(F.max("count").alias("n")).first().n or 0
        begun = with_prefix_sums(sized.withColumn("key", F.xxhash64("id")), "parent", "size", "key", "id", widest, out="earlier")
        offsets = scratch(begun.select("id", "parent", "size", (F.col("earlier") + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("value")), "offsets")
        ranges = scratch(self._downward(offsets, lambda above, own: above + own, scratch).withColumnRenamed("value", "pre").join(offsets.drop("value"), "id"), "ranges")
        placed = self._swept(ranges)
        if lost is not None:
            none = F.lit(None).cast("bigint")
            ringed = self._cycles(links.join(lost.select("id"), "id", "left_semi"), scratch)
            placed = placed.unionByName(ringed.select("id", "parent", "root", F.lit(-1).cast("bigint").alias("depth"), none.alias("size"), none.alias("pre"), none.alias("last"), "in_cycle"))
        self.nodes = materialize(placed, "nodes")
        scratch.release()

    @staticmethod
    def _sizes(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
        """``id`` and ``size``, the number of nodes below it, summed upward; and the nodes that no root was reached from.

        Only nodes whose jump still lands on a node are passed on. A round reaches from 2**k to 2**(k+1) links, so if it
        closes no node, no open node has a root above it."""
        gains, left = [], None
        open_ = links.select("id", F.col("parent").alias("anc"), F.lit(1).cast("bigint").alias("size"))
        while True:
            open_ = scratch(open_, "open")
            n = open_.count()
            if n in (0, left):
                break
            left = n
            gained = open_.groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("more"))  # small and read again below: not written
            gains.append(gained)
            up = open_.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"))
            open_ = open_.join(up, "anc").join(gained, "id", "left").select("id", F.col("anc2").alias("anc"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        below = links.select("id", F.lit(0).cast("bigint").alias("more")).limit(0)
        for g in gains:
            below = below.unionByName(g)
        return below.groupBy("id").agg(F.sum("more").alias("size")), open_ if n else None

    @staticmethod
    def _downward(values: DataFrame, combine, scratch: Scratch) -> DataFrame:
        """``id`` and ``value``: the values of a node's chain, put together by ``combine(above, below)`` from the root down.

        Rows of ``values`` are ``id``, ``parent`` and ``value``. A node whose jump lands on a finished node finishes; only
        the others go on, with twice the jump."""
        done = values.where("parent IS NULL").select("id", "value")
        state = values.where("parent IS NOT NULL").select("id", F.col("parent").alias("anc"), "value")
        while True:
            up = state.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("value").alias("value2"))
            step = scratch(state.join(up, "anc", "left"), "chains")
            above = done.select(F.col("id").alias("anc"), F.col("value").alias("above"))
            closing = step.where("anc2 IS NULL").join(above, "anc").select("id", combine(F.col("above"), F.col("value")).alias("value"))
            done = done.unionByName(scratch(closing, "finished"))
            rest = step.where("anc2 IS NOT NULL")
            if not rest.limit(1).count():
                return done
            state = rest.select("id", F.col("anc2").alias("anc"), combine(F.col("value2"), F.col("value")).alias("value"))

    @staticmethod
    def _swept(ranges: DataFrame) -> DataFrame:
        """Depth and root from the nested-set ranges, in one sweep over preorder: a node's ancestors are the ranges that
        began before it and haven't ended, its root is the root range that began last. Blocks of preorder numbers are
        swept each on its own, after the blocks' totals (one row per block) are carried forward."""
        last = F.col("pre") + F.col("size") - 1
        begins = ranges.select(F.col("pre").alias("at"), F.lit(1).alias("turn"), "id", "parent", "size", F.when(F.col("parent").isNull(), F.col("id")).alias("head"))
        none = lambda c: F.lit(None).cast(ranges.schema[c].dataType)
        ends = ranges.select((last + 1).alias("at"), F.lit(-1).alias("turn"), none("id").alias("id"), none("parent").alias("parent"), none("size").alias("size"), none("id").alias("head"))
        events = begins.unionByName(ends).withColumn("block", F.floor(F.col("at") / SWEEP))
        blocks = events.groupBy("block").agg(F.sum("turn").alias("turns"), F.max_by("head", F.when(F.col("head").isNotNull(), F.col("at"))).alias("head"))
        before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.select("block", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("open"), F.last("head", ignorenulls=True).over(before).alias("under"))
        within = Window.partitionBy("block").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        swept = events.join(F.broadcast(carried), "block").select(
            "id", "parent", F.coalesce(F.last("head", ignorenulls=True).over(within), "under").alias("root"), (F.col("open") + F.sum("turn").over(within) - 1).alias("depth"), "size", F.col("at").alias("pre"), "turn"
        )
        return swept.where("turn = 1").select("id", "parent", "root", "depth", "size", "pre", last.alias("last"), F.lit(False).alias("in_cycle"))

    @staticmethod
    def _cycles(lost: DataFrame, scratch: Scratch) -> DataFrame:
        """``id``, ``parent``, ``root`` and ``in_cycle`` of the nodes that no root was reached from."""
        state = scratch(lost.select("id", "parent", F.col("parent").alias("anc"), F.col("id").alias("least")), "cycles")
        before = None
        while True:
            image = state.select("anc").distinct()
            n = image.count()
            if n == before:  # jumping permutes the image: these are the nodes on cycles
                on = state.join(image.withColumnRenamed("anc", "id"), "id", "left_semi")
                beyond = on.select(F.col("id").alias("parent"), F.col("least").alias("least2"))
                if on.join(beyond, "parent").where("least <> least2").limit(1).count() == 0:
                    break
            before = n
            up = state.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("least").alias("least2"))
            state = scratch(state.join(up, "anc").select("id", "parent", F.col("anc2").alias("anc"), F.least("least", "least2").alias("least")), "cycles")
        ends = on.select(F.col("id").alias("anc"), F.col("least").alias("root"))
        marked = state.join(ends, "anc").join(on.select("id", F.lit(True).alias("on")), "id", "left")
        return marked.select("id", "parent", "root", F.coalesce("on", F.lit(False)).alias("in_cycle"))

    def descendants(self, of: DataFrame | None = None) -> DataFrame:
        """``ancestor``, ``id`` and ``distance`` of all descendants of the nodes in ``of`` (a table with ``id``), or of all.

        A range join on preorder: each range is cut at blocks of ``BLOCK`` numbers, and meets the nodes of those blocks."""
        tree = self.nodes.where("pre IS NOT NULL")
        heads = (tree if of is None else tree.join(of.select("id").distinct(), "id", "left_semi")).where("size > 1")
        ranges = heads.select(F.col("id").alias("ancestor"), F.col("pre").alias("low"), F.col("last").alias("high"), F.col("depth").alias("from"))
        ranges = ranges.withColumn("block", F.explode(F.sequence(F.floor((F.col("low") + 1) / BLOCK), F.floor(F.col("high") / BLOCK))))
        placed = tree.select("id", "pre", "depth", F.floor(F.col("pre") / BLOCK).alias("block"))
        return ranges.join(placed, "block").where("pre > low AND pre <= high").select("ancestor", "id", (F.col("depth") - F.col("from")).alias("distance"))

    def paths(self, separator: str = "/") -> DataFrame:
        """``id`` and ``path``, from the root down to the node, joined from the halves that doubled jumps leave."""
        scratch = Scratch()
        chains = self._downward(self.nodes.where("pre IS NOT NULL").select("id", "parent", F.array("id").alias("value")), F.concat, scratch)
        paths = materialize(chains.select("id", F.array_join("value", separator).alias("path")), "paths")
        scratch.release()
        return paths

    def release(self) -> None:
        """Delete ``nodes``."""
        drop_materialized(self.nodes)
