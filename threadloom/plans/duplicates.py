"""The duplicate-detection job: embed, compare, connect, store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.filters import unclustered_issues
from threadloom.operators.graph import assign_clusters, build_clusters, changed_components, connected_components
from threadloom.operators.similarity import (
    THRESHOLD,
    TOP_K,
    Embedder,
    embed_issues,
    embed_text,
    knn_join,
    similarity_edges,
)
from threadloom.operators.terms import fit_terms, sparse_knn_join, term_vectors
from threadloom.sources.keyed import KeyedTable

# Rows of the table of members, keyed by id.
MEMBERS = T.StructType([T.StructField("id", T.StringType()), T.StructField("component", T.StringType())])


def grow_components(members: KeyedTable, links: DataFrame) -> DataFrame:
    """Add links (src, dst) to the stored components; all members of those that the links touch.

    Repeated after a failure it gives the same rows.
    """
    links = links.checkpoint()
    members.merge(changed_components(members.read(), links))
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    touched = members.of(ends).select("component").distinct()
    return members.read().join(touched, "component", "left_semi").select("id", "component").checkpoint()


def daily_clustering(
    issues: DataFrame,
    limit: int | None = None,
    k: int = TOP_K,
    threshold: float = THRESHOLD,
    embedder: Embedder | None = None,
    vectors: DataFrame | None = None,
    model: DataFrame | None = None,
    members: KeyedTable | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New clusters, and the issues with their cluster ids.

    All unclustered issues (with ``limit`` the oldest of them) are compared with all
    issues, so one of them can pull an already clustered issue into its new cluster. ``vectors``
    are the stored records of a model, ``embedder`` makes them anew. Without either,
    issues are compared by their weighted words, exactly; ``model`` is the stored
    table of ``fit_terms``, fitted here if there is none. With ``members``, the components of
    earlier days, new links extend these: an issue that resembles members of two clusters
    joins both, and the clusters returned are those that this run's links touch.
    """
    todo = unclustered_issues(issues, limit).select("id")
    if vectors is None and embedder is None:
        # Read twice, by the model and the vectors. A fixed number, as text is worth more tasks than its bytes.
        parts = int(issues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        texts = embed_text(issues).filter("text != ''").select("id", "text").repartition(parts, "id").checkpoint()
        model = fit_terms(texts).checkpoint() if model is None else model
        pool = term_vectors(texts, model).checkpoint()
        neighbours = sparse_knn_join(todo, pool, k, threshold)
    else:
        records = embed_issues(issues, embedder) if vectors is None else vectors
        # Embedding is costly and the vectors are read twice.
        pool = records.select(F.col("metadata.issueId").alias("id"), "values").checkpoint()
        neighbours = knn_join(pool.join(todo, "id", "left_semi"), pool, k, threshold)
    links = similarity_edges(neighbours)
    components = connected_components(links) if members is None else grow_components(members, links)
    return build_clusters(components, issues), assign_clusters(issues, components)
