"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _jumped(step: DataFrame) -> DataFrame:
    """``(node, to)`` with every ``to`` followed to its end: each pass joins the map with itself, so that a
    path of n steps takes log2(n) passes."""
    while True:
        next_ = step.select(F.col("node").alias("to"), F.col("to").alias("on"))
        moved = F.coalesce(F.col("on") != F.col("to"), F.lit(False)).alias("moved")
        last, step = step, saved(step.select("node", "to").join(next_, "to", "left").select("node", F.coalesce("on", "to").alias("to"), moved))
        dropped(last)
        if step.where("moved").isEmpty():
            return step


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; a component is named by its smallest node.

    Each round maps every node to the smallest of itself and its neighbours, follows these maps to their
    ends (smaller at each step, so there are no circles) and contracts the edges. A node that
    is its own smallest has a neighbour that is not, so a round at least halves the nodes with
    edges, whatever the graph; paths end within one round or a few. Only minima, joins and distinct
    rows are used: nothing gathers a component, and a hub's edges are pre-aggregated. Edges with a null
    end are ignored; self-loops only name a node. No edges: no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = e.where("a = b").select(F.col("a").alias("node"))
    e = saved(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    out, steps = None, []
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        step = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")))
        steps.append(_jumped(step))
        step = steps[-1].select("node", "to")
        if out is None:
            out = step.withColumnRenamed("to", "component")
        else:
            on = step.select(F.col("node").alias("component"), "to")
            steps.append(saved(out.join(on, "component", "left").select("node", F.coalesce("to", "component").alias("component"))))
            out = steps[-1]
        ends = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        steps.append(e)
        e = e.join(ends, "b").join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        e = saved(e.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    alone = nodes.distinct().select("node", F.col("node").alias("component"))
    all_ = saved(alone if out is None else out.union(alone.join(out.select("node"), "node", "left_anti")))
    dropped(e, *steps)
    return all_
