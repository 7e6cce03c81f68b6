"""Connected components of a link table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links(a, b); label is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows two hooks and
    replaces the ends of the links by what they hook to. Links inside one group
    go, so that the table at least halves its nodes each round. The rounds' hooks
    are joined to labels at the end. No step gathers more than one row for each
    link or node; nothing goes to the driver but whether a link is left. Rows
    that repeat, loops and links in both directions change nothing. No links
    give no rows.
    """
    edges, steps = materialize(links.select("a", "b").where("a <> b").distinct(), "links"), []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        far = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
        step = materialize(hook.join(far, "to").select("a", F.col("next").alias("to")), "hooks")
        steps.append(step)
        name = lambda c, step=step: step.select(F.col("a").alias(c), F.col("to").alias(f"{c}2"))
        rest = edges.join(name("a"), "a").join(name("b"), "b").where("a2 <> b2")
        following = materialize(rest.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        release(edges)
        edges = following
        if edges.isEmpty():
            break
    labels = steps[0].select(F.col("a").alias("node"), F.col("to").alias("label"))
    for step in steps[1:]:
        labels = labels.join(step.select(F.col("a").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    labels = materialize(labels, "labels")
    release(edges, *steps)
    return labels
