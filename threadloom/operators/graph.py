"""Connected components and the clusters made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import blank_to_null, cut
from threadloom.operators.distributed import checkpoint_with, first_n, lookup_by_key


def _rows() -> Column:
    return F.count(F.lit(1))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Connect the larger neighbours of each node to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), _rows().alias("degree"))
    linked = lookup_by_key(both, smallest, "u", "degree", 2 * n)
    return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"), _rows().alias("degree"))
    linked = lookup_by_key(edges, smallest, "u", "degree", n)
    siblings = linked.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return siblings.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of the edges (src, dst); component = smallest id.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected
    Components in MapReduce and Beyond" (SoCC 2014), until the edges no longer
    change. Each step is checkpointed, so a lost executor repeats little.
    """

    def kept(df: DataFrame) -> tuple[DataFrame, dict]:
        return checkpoint_with(df, n=_rows(), mark=F.bit_xor(F.xxhash64("u", "v")))

    # u > v throughout, and no step makes more edges than it gets.
    now, state = kept(
        edges.filter("src != dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        large = _large_star(now, state["n"]).checkpoint()
        previous = state
        now, state = kept(_small_star(large, state["n"]))
        if state == previous:
            break
    else:
        raise RuntimeError(f"no stable components after {max_rounds} rounds")
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def changed_components(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node whose component is new or another one after the edges (src, dst).

    ``stored`` has (id, component) of all earlier edges, component = smallest id. A
    stored component takes part as one node, linked with those of its members that new edges
    end at, so the rounds run over new edges only. The stored table is read for these
    ends and for the members of components that are joined. Merged into ``stored`` by
    id, the result makes it what ``connected_components`` gives over all edges. Edges that
    join nothing, repeated ones, loops and null ends give no rows.
    """
    stored = stored.select("id", "component")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = stored.join(ends, "id", "left_semi").checkpoint()
    ties = known.select(F.col("component").alias("src"), F.col("id").alias("dst"))
    found = connected_components(edges.select("src", "dst").unionByName(ties)).checkpoint()
    roots = known.select("component").distinct()
    old = known.select("id").unionByName(roots.withColumnRenamed("component", "id"))
    new = found.join(old, "id", "left_anti")
    moves = found.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    moves = moves.join(roots, "component", "left_semi").filter("component != _to").checkpoint()
    # A component may hold a third of all nodes.
    sizes, seen = checkpoint_with(stored.groupBy("component").agg(_rows().alias("n")), total=F.sum("n"))
    moved = lookup_by_key(stored, sizes.join(moves, "component"), "component", "n", seen["total"] or 0)
    return new.unionByName(moved.select("id", F.col("_to").alias("component")))


def build_clusters(components: DataFrame, issues: DataFrame) -> DataFrame:
    """One cluster per component, named after its head (the smallest id)."""
    sizes = components.groupBy(F.col("component").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    heads = issues.select("id", F.col("name").alias("head_name"))
    return (
        sizes.filter("n >= 2")
        .join(heads, "id", "left")
        .select(
            "id",
            F.coalesce(
                blank_to_null(cut(F.col("head_name"), 80)), F.concat(F.lit("cluster-"), "id")
            ).alias("name"),
            F.lit(None).cast("string").alias("description"),
            F.col("n").cast("int").alias("issue_count"),
        )
    )


def assign_clusters(issues: DataFrame, components: DataFrame) -> DataFrame:
    """Write the cluster id into member issues; others keep theirs."""
    return (
        issues.join(components.select("id", F.col("component").alias("_c")), "id", "left")
        .withColumn("duplicate_cluster_id", F.coalesce("_c", "duplicate_cluster_id"))
        .drop("_c")
    )


def cluster_members(clusters: DataFrame, issues: DataFrame, shown: int = 5) -> DataFrame:
    """The first members of each cluster."""
    members = issues.filter(F.col("duplicate_cluster_id").isNotNull()).select(
        F.col("duplicate_cluster_id").alias("cluster_id"), F.col("id").alias("issue_id"), "name", "created_at"
    )
    heads = first_n(members, ["cluster_id"], [F.asc("issue_id")], shown)
    named = clusters.select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster_name"), "issue_count")
    return named.join(heads, "cluster_id")
