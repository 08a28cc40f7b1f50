"""Connected components as a loop of joins (no link ever reaches the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskweft.plans.scratch import Scratch


def _follow(pointers: DataFrame, by: DataFrame) -> DataFrame:
    """pointers(node, parent): each parent replaced by its own parent in ``by``, if it has one."""
    nxt = by.select(F.col("node").alias("_mid"), F.col("parent").alias("_top"))
    return pointers.join(nxt, pointers["parent"] == nxt["_mid"], "left").select(
        "node", F.coalesce("_top", "parent").alias("parent")
    )


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst", rows: int | None = None) -> DataFrame:
    """(id, component) for each id that is not the smallest of its component.

    Each round every node hooks to its smallest neighbour below it (a hash aggregate with map-side
    combine), pointers are halved twice, and the links are rewritten between the remaining roots; rounds
    grow with the logarithm of the longest path.  Each round is a written table.  Ids absent from the
    result are their own component.  ``rows`` is a bound of the links, if known.  Links with a null end and links to oneself are ignored; repeated
    links count once; no links give no rows.
    """
    links = scratch.cut(
        edges.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
        .distinct(),
        rows=rows,
    )
    rounds: list[tuple[DataFrame, int]] = []
    while n := links.count():
        hooked = scratch.cut(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")), rows=n)
        halved = _follow(hooked, hooked)
        pointers = scratch.cut(_follow(halved, halved), rows=n)
        scratch.drop(hooked)
        a = pointers.select(F.col("node").alias("_a"), F.col("parent").alias("_pa"))
        b = pointers.select(F.col("node").alias("_b"), F.col("parent").alias("_pb"))
        moved = (
            links.join(a, links["hi"] == a["_a"], "left")
            .join(b, links["lo"] == b["_b"], "left")
            .select(F.coalesce("_pa", "hi").alias("x"), F.coalesce("_pb", "lo").alias("y"))
            .where("x <> y")
            .select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))
            .distinct()
        )
        nxt = scratch.cut(moved, rows=n)
        scratch.drop(links)
        links = nxt
        rounds.append((pointers, n))
    if not rounds:
        return links.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    out, _ = rounds.pop()
    while rounds:
        earlier, n = rounds.pop()
        # a node of a long path can be half-way up in several rounds: the last one knows its component
        once = earlier.join(out.select("node"), "node", "left_anti")
        nxt = scratch.cut(_follow(once, out).unionByName(out), rows=n)
        scratch.drop(earlier, out)
        out = nxt
    return out.select(F.col("node").alias("id"), F.col("parent").alias("component"))
