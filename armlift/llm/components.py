"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.session import release, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable from each node of ``links`` (a, b), both bigint.

    Alternates two steps until all links lead to roots: every node sends its larger neighbours, then
    its smaller neighbours, to the smallest node it knows. Trees get flat in a number of
    rounds that grows with the logarithm of their size. A node with very many links is
    never gathered: minima are pre-aggregated, and the join that hands them out can be split.
    """
    current = stored(links.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    while not flat_already(current):
        both = current.unionByName(current.selectExpr("v as u", "u as v"))
        found = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u as w", "least(u, m) as m")
        larger = both.where("v > u").join(found, F.expr("u = w")).selectExpr("v as u", "m as v")
        flat = larger.where("u <> v").distinct()
        least = flat.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        smaller = flat.join(least, F.expr("u = w")).selectExpr("explode(array(v, u)) as u", "m as v")
        following = stored(smaller.where("u <> v").distinct())
        release(current)
        current = following
    roots = current.select("v").distinct().selectExpr("v as node", "v as component")
    return current.selectExpr("u as node", "v as component").unionByName(roots)


def flat_already(links: DataFrame) -> bool:
    """Whether every link (u, v) leads to a root: no node has two links down, and none that is reached has one."""
    ends = links.selectExpr("inline(array(named_struct('node', u, 'down', 1, 'reached', 0), named_struct('node', v, 'down', 0, 'reached', 1)))")
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("reached").alias("reached"))
    return not nodes.where("down > 1 or (down = 1 and reached = 1)").take(1)
