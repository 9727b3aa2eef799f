"""Connected components of a table of links, by labels that shrink along links and jump to their labels' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from codequarry.llm.shared import counted, shared_folder, written


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of any ordered type to (node, label): the smallest node of each component.

    A step takes the smallest label among a node's own and its neighbours' and goes
    two labels further from there. Labels are written to the shared folder; the
    steps end when none moved, which the write itself counts.
    """
    folder = shared_folder(links.sparkSession)
    links, n = counted(links.where("a <> b").select("a", "b").distinct(), folder, "links")
    return _components(links, folder) if n else links.toDF("node", "label")


def _components(links: DataFrame, folder: str) -> DataFrame:
    # Never by broadcast: each would take some MB of the driver until it collects garbage, and there are four a step.
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), folder, "labels-0")
    step = 0
    while True:
        step += 1
        reached = both.join(labels.hint("merge"), both.b == labels.node).groupBy("a").agg(F.min("label").alias("reached"))
        lower = labels.join(reached.hint("merge"), labels.node == reached.a).select("node", "label", F.least("label", "reached").alias("low"))
        jumps = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        again = labels.select(F.col("node").alias("far"), F.col("label").alias("farther"))
        seen = Observation()
        stepped = lower.join(jumps.hint("merge"), "low").join(again.hint("merge"), "far").observe(seen, F.count_if(F.col("farther") != F.col("label")).alias("moved"))
        labels = written(stepped.select("node", F.col("farther").alias("label")), folder, f"labels-{step}")
        if not seen.get["moved"]:
            return labels


def merged(labels: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """``labels`` (node, label) of all nodes, after the components that ``links`` (a, b) of nodes join are one."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    between, n = counted(between.where("a <> b").distinct(), folder, f"{name}-links")
    if not n:
        return labels
    top = _components(between, shared_folder(links.sparkSession)).select(F.col("node").alias("label"), F.col("label").alias("lowest"))
    return written(labels.join(top, "label", "left").select("node", F.coalesce("lowest", "label").alias("label")), folder, name)
