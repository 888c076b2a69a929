"""Undirected weighted graphs of terms: components, communities, and tables for drawing."""

from __future__ import annotations

import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperloom.functions.stats import with_totals
from paperloom.operators.network import tilt
from paperloom.session import cut_lineage

#: Edges that louvain() takes; the networks of selected terms have a few hundred.
MAX_EDGES = 100_000


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w), a <= b: the weights of either direction and of repeated edges added up; null ends and weights are left out."""
    rows = edges.where("from_node is not null and to_node is not null and weight_n is not null")
    return rows.groupBy(F.least("from_node", "to_node").alias("a"), F.greatest("from_node", "to_node").alias("b")).agg(F.sum("weight_n").alias("w"))


def last_written(edges: DataFrame, order: str) -> DataFrame:
    """(a, b, w), a <= b: of repeated edges in either direction the last by `order` counts, instead of their sum; ties to the larger weight."""
    rows = edges.where("from_node is not null and to_node is not null and weight_n is not null")
    ends = F.least("from_node", "to_node").alias("a"), F.greatest("from_node", "to_node").alias("b")
    return rows.groupBy(*ends).agg(F.max(F.struct(order, "weight_n"))["weight_n"].alias("w"))


def components(graph: DataFrame) -> DataFrame:
    """(node, component): the least node that each node is linked to.

    Labels halve their distance each round by pointer jumping, until no label changes; lineage is cut in the shared folder.
    """
    links = cut_lineage(graph.select("a", "b").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = links.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("c"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("j"))
        step = label.join(near, "node").join(jump, "component", "left").select("node", F.col("component").alias("was"), F.least("component", "c", F.coalesce("j", "component")).alias("component"))
        step = cut_lineage(step)
        changed = step.where("was <> component").limit(1).count()
        label = step.select("node", "component")
        if not changed:
            return label


def largest(members: DataFrame, group: str = "component") -> DataFrame:
    """The members of the largest group; of equally large ones the first by name."""
    size = members.groupBy(group).agg(F.count("*").alias("n"))
    return members.join(size.orderBy(F.desc("n"), group).limit(1).select(group), group, "left_semi")


def _louvain(edges: list[tuple[str, str, float]], resolution: float, seed: int | None = None) -> dict[str, int]:
    """Local moving and aggregation until modularity stops rising; nodes in sorted order, or shuffled by a seed, ties to the smallest community."""
    names = sorted({x for e in edges for x in e[:2]})
    if seed is not None:
        random.Random(seed).shuffle(names)
    index = {n: i for i, n in enumerate(names)}
    links: list[dict[int, float]] = [defaultdict(float) for _ in names]
    for a, b, w in edges:
        links[index[a]][index[b]] += w
        if a != b:
            links[index[b]][index[a]] += w
    member = list(range(len(names)))
    while True:
        n = len(links)
        degree = [sum(ls.values()) + ls.get(i, 0.0) for i, ls in enumerate(links)]
        total = sum(degree) or 1.0
        home, weight, moved, any_move = list(range(n)), degree[:], True, False
        while moved:
            moved = False
            for i in range(n):
                near: dict[int, float] = defaultdict(float)
                for j, w in links[i].items():
                    if j != i:
                        near[home[j]] += w
                weight[home[i]] -= degree[i]
                gain = lambda c, i=i, near=near: near.get(c, 0.0) - resolution * degree[i] * weight[c] / total
                best = max(sorted({home[i], *near}), key=lambda c: (round(gain(c), 12), c == home[i], -c))
                weight[best] += degree[i]
                if best != home[i]:
                    home[i], moved, any_move = best, True, True
        if not any_move:
            return {name: member[i] for i, name in enumerate(names)}
        order = {c: k for k, c in enumerate(sorted(set(home)))}
        merged: list[dict[int, float]] = [defaultdict(float) for _ in order]
        for i, ls in enumerate(links):
            for j, w in ls.items():
                a, b = order[home[i]], order[home[j]]
                if i == j:
                    merged[a][a] += w
                elif a != b:
                    merged[a][b] += w
                elif i < j:
                    merged[a][a] += w
        member = [order[home[m]] for m in member]
        links = merged


def louvain(graph: DataFrame, resolution: float = 1.0, seed: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(node, community): communities of a network of selected terms, at most MAX_EDGES edges; more are refused. An empty graph has no rows.

    Nodes of `nodes` without an edge are communities of their own, numbered below 0.
    """
    kept = graph.select("a", "b", F.col("w").cast("double").alias("w"))
    if kept.limit(MAX_EDGES + 1).count() > MAX_EDGES:
        raise ValueError("too many edges for communities in one task; select terms first")

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        found = _louvain(list(rows[["a", "b", "w"]].itertuples(index=False, name=None)), resolution, seed)
        return pd.DataFrame(sorted(found.items()), columns=["node", "community"])

    found = kept.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(find, "node string, community long")
    if nodes is None:
        return found
    alone = nodes.select("node").distinct().join(found, "node", "left_anti")
    return found.unionByName(numbered(alone, "node", "i").select("node", (-F.col("i")).alias("community")))


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Adds the last name of `order` as a column: 1, 2, ... in the order of what comes before it. Rows are sorted by range and counted by partition, so no task sees them all."""
    *by, name = order
    kept = cut_lineage(rows.orderBy(*by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = kept.groupBy("_p").agg(F.count("*").alias("n"))  # one row a partition
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    within = F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)
    return kept.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + within + 1).drop("_p", "_i", "_before")


def ranked(members: DataFrame, group: str, weights: DataFrame) -> DataFrame:
    """(node, community_id, community_rank, weight): communities numbered by total weight, members ranked within; ties by name."""
    rows = members.join(weights.select("node", "weight"), "node")
    total = rows.groupBy(group).agg(F.sum("weight").alias("t"), F.min("node").alias("least"))
    ids = numbered(total, F.desc("t"), "least", "community_id").select(group, F.col("community_id").cast("int").alias("community_id"))
    rank = F.row_number().over(W.partitionBy("community_id").orderBy(F.desc("weight"), "node"))
    return rows.join(ids, group).select("node", "community_id", rank.alias("community_rank"), "weight")


def community_summary(rows: DataFrame, least: int = 2) -> DataFrame:
    """(community_id, n_terms, total_weight, community_label, top_terms) of communities of at least `least` members; ids stay as they were numbered."""
    top = lambda k, sep: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("community_rank", "node"))), 1, k), lambda x: x["node"]), sep)
    return rows.groupBy("community_id").agg(F.count("*").alias("n_terms"), F.sum("weight").alias("total_weight"), top(4, ", ").alias("community_label"), top(8, "|").alias("top_terms")).where(F.col("n_terms") >= least)


def community_table(rows: DataFrame, nodes: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Communities and their members, from ranked() and (node, pooled_n, gap_pan_minus_eth).

    (community_id, n_terms, total_pooled_n, mean_gap_pan_minus_eth, community_tilt, community_label, top_terms), the tilt by the mean of
    gaps rounded to six places; and (node, community_id, community_rank_in_pooled_n, pooled_n, gap_pan_minus_eth) of the same
    communities. Ids stay as they were numbered before small communities were left out.
    """
    members = rows.select("node", "community_id", F.col("community_rank").alias("community_rank_in_pooled_n")).join(nodes.select("node", "pooled_n", F.round("gap_pan_minus_eth", 6).alias("gap_pan_minus_eth")), "node")
    top = lambda k, sep: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("community_rank_in_pooled_n", "node"))), 1, k), lambda x: x["node"]), sep)
    mean = F.avg("gap_pan_minus_eth")
    table = members.groupBy("community_id").agg(
        F.count("*").alias("n_terms"), F.sum("pooled_n").alias("total_pooled_n"), mean.alias("mean_gap_pan_minus_eth"), tilt(mean).alias("community_tilt"), top(4, ", ").alias("community_label"), top(8, "|").alias("top_terms")
    )
    table = table.where(F.col("n_terms") >= least)
    return table, members.join(table.select("community_id"), "community_id", "left_semi")


def legend(table: DataFrame, shown: DataFrame, most: int = 8) -> DataFrame:
    """The first `most` communities by id among those with a node in `shown`, (node, community_id)."""
    return table.join(shown.select("community_id").distinct(), "community_id", "left_semi").orderBy("community_id").limit(most)


def restricted(graph: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, w, community_a, community_b): edges with both ends in a community that was kept, with the communities of the ends."""
    end = lambda c: members.select(F.col("node").alias(c), F.col("community_id").alias(f"community_{c}"))
    return graph.join(end("a"), "a").join(end("b"), "b").select("a", "b", "w", "community_a", "community_b")


def core_nodes(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(node): the ends of the edges between terms; where there are none, the `most` nodes with the largest pan_n, ties by name."""
    ends = edges.where("edge_type = 'term_term'").select(F.explode(F.array("from_node", "to_node")).alias("node")).distinct()
    some = ends.agg(F.count("*").alias("n_ends"))
    top = nodes.orderBy(F.desc("pan_n"), "node").limit(most).select("node")
    return ends.unionByName(with_totals(top, some).where("n_ends = 0").select("node"))


def induced(graph: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among `kept` (node)."""
    ends = lambda c: kept.select(F.col("node").alias(c)).distinct()
    return graph.join(ends("a"), "a", "left_semi").join(ends("b"), "b", "left_semi").select("a", "b", "w")


def without(graph: DataFrame, dropped: list[str]) -> DataFrame:
    return graph.where(~F.col("a").isin(dropped) & ~F.col("b").isin(dropped))


def scaled(rows: DataFrame, value: str, name: str, low: float, high: float, power: float = 1.0) -> DataFrame:
    """Adds `name`: `value` from low to high over the table; the middle where all values are equal."""
    ends = with_totals(rows, rows.agg(F.min(value).alias("_least"), F.max(value).alias("_most")))
    x = F.try_divide(F.col(value) - F.col("_least"), F.col("_most") - F.col("_least"))
    return ends.withColumn(name, F.when(F.col("_most") <= F.col("_least"), F.lit((low + high) / 2)).otherwise(low + (high - low) * F.pow(x, F.lit(power)))).drop("_least", "_most")


def with_hub(nodes: DataFrame, hub: str, factor: float = 1.35) -> DataFrame:
    """(node, weight) and a row for the hub with `factor` times the largest weight; each node once."""
    top = nodes.agg(F.max("weight").alias("m")).where("m is not null").select(F.lit(hub).alias("node"), (factor * F.col("m")).alias("weight"))
    return nodes.select("node", F.col("weight").cast("double").alias("weight")).unionByName(top).groupBy("node").agg(F.max("weight").alias("weight"))


def layout(nodes: DataFrame) -> DataFrame:
    """(node, x, y): a column for each tilt, even slots by count, sideways in turns where there are more than five."""
    place = {"panethnic_tilt": -0.64, "shared": -0.02, "ethnic_tilt": 0.74}  # fixed values
    by = W.partitionBy("tilt")
    i = F.row_number().over(by.orderBy(F.desc("pooled_n"), "node")) - 1
    rows = nodes.withColumns({"i": i, "n": F.count("*").over(by)})
    x = F.element_at(F.create_map(*[F.lit(v) for kv in place.items() for v in kv]), F.col("tilt")) + F.when(F.col("n") > 5, 0.024 * ((F.col("i") % 2) * 2 - 1)).otherwise(0.0)
    y = F.when(F.col("n") == 1, 1.7).otherwise(1.7 - 3.4 * F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))) - 0.18
    return rows.select("node", x.alias("x"), y.alias("y"))


def nearest_vertex(points: DataFrame) -> DataFrame:
    """(node, distance, radius, inner): the distance to the nearest other point, the distance from the origin, and whether it is within the 45th percentile of these. For the few points of a drawing."""
    rows = with_totals(points.withColumn("radius", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)), points.agg(F.percentile(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2), F.lit(0.45)).alias("cut"), F.collect_list(F.struct("node", "x", "y")).alias("all")))
    others = F.filter("all", lambda o: o["node"] != F.col("node"))
    nearest = F.array_min(F.transform(others, lambda o: F.sqrt((o["x"] - F.col("x")) ** 2 + (o["y"] - F.col("y")) ** 2)))
    return rows.select("node", nearest.alias("distance"), "radius", (F.col("radius") <= F.col("cut")).alias("inner"))
