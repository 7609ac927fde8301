"""The flows of the modes, from relations or text to a styled graph.

``communities`` is the community step: ``community.girvan_newman``, as the modes have it, or ``community.label_communities``, another measure
whose cost grows with the graph only. Girvan-Newman works at every size, but its cost grows with nodes times edges; which one runs is the caller's choice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import chunking, clean, concepts, entities, extract, merge, proximity
from weftgraph.operators.graph import build, community, rank, style
from weftgraph.schemas import CONCEPT, DIRECTED, NOTEBOOK, PIPELINE, Mode
from weftgraph.sources import files, html
from weftgraph.storage import cut


Communities = Callable[[DataFrame], DataFrame]


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    merged: DataFrame
    rank_label: str


def prepared(relations: DataFrame, mode: Mode, cached: bool = True) -> DataFrame:
    """Relations as the mode's later steps take them: from a file (``cached``) or fresh from an extractor."""
    if not cached:
        return clean.clean_relations(relations, mode.parsed_weight)
    old = "node_1" in relations.columns and "source" not in relations.columns
    rows = clean.with_defaults(clean.from_legacy(clean.from_cache(relations), mode.legacy_weight), mode.cached_weight)
    rows = clean.sanitize(rows, mode.normalize)
    if mode.normalize and not old:
        from weftgraph.functions.text import weight

        return rows.withColumn("weight", weight("weight", mode.cached_weight))
    return rows.withColumn("weight", F.col("weight").try_cast("double"))


def merged_edges(relations: DataFrame, mode: Mode, chunks: bool = True) -> DataFrame:
    """Direct and proximity edges merged to one per pair; without lists of chunks if told so (the notebook's have them always)."""
    if mode.name == NOTEBOOK.name:
        return merge.merge_counts(relations, proximity.proximity(relations, mode))
    return merge.rendered(merge.merge_half(relations, proximity.half(relations, chunks), mode, chunks), mode)


def directed_graph(relations: DataFrame, mode: Mode = DIRECTED, seed: int | None = None, communities: Communities = community.girvan_newman, chunks: bool = True) -> Graph:
    """Edges, ranks, communities and styles of the directed modes. ``chunks=False`` keeps every row bounded."""
    merged = cut(merged_edges(relations, mode, chunks), "edges")
    edges = build.edges_of(merged)
    ranks, label = rank.rank_or_fall_back(edges, mode=mode.name)
    groups = style.colours(communities(edges), seed, mode.palette)
    return Graph(style.styled(build.nodes_of(edges), ranks, groups, mode.name), edges, merged, label)


def undirected_graph(relations: DataFrame, seed: int | None = None, communities: Communities = community.girvan_newman) -> Graph:
    """The notebook mode: undirected edges, sizes by degree."""
    merged = cut(merged_edges(relations, NOTEBOOK), "edges")
    edges = build.last_written(merged).withColumns({"label": F.col("title"), "value": F.col("weight")})
    groups = style.colours(communities(edges), seed, NOTEBOOK.palette).withColumnRenamed("node", "id")
    nodes = build.degree(edges).join(groups, "id", "left").select("id", F.coalesce("group", F.lit(0)).alias("group"), F.coalesce("color", F.lit(style.DEFAULT_COLOUR)).alias("color"), F.col("degree").alias("size"))
    return Graph(nodes, edges, merged, "degree")


def concept_graph(rows: DataFrame, seed: int | None = None, communities: Communities = community.girvan_newman, over_connected: tuple[str, ...] = ()) -> Graph:
    """The concept mode: co-occurring concepts but ``over_connected`` ones, sizes by importance. Nodes seen only on the right have no size or colour."""
    pairs = cut(clean.drop_nodes(concepts.cooccurrence(clean.clean_concepts(rows)), over_connected), "concepts")
    ends = pairs.select(F.col("entity_L").alias("src"), F.col("entity_R").alias("dst"))
    groups = style.colours(communities(ends), seed, CONCEPT.palette)
    known = concepts.coloured(concepts.importance(pairs).withColumnRenamed("entity", "id"), groups, "id").withColumn("size", style.concept_size("importance"))
    nodes = build.nodes_of(ends).join(known, "id", "left")
    edges = build.last_written(pairs, "entity_L", "entity_R", 1.0, "chunks", "count").withColumns({"label": F.lit(None).cast("string"), "value": F.col("weight")})
    return Graph(nodes, edges, pairs, "importance")


def text_to_graph(
    spark: SparkSession, folder: str, factory: Callable[[], extract.Extractor], cache: str | None = None, regenerate: bool = False,
    mode: Mode = PIPELINE, size: int = 1500, overlap: int = 150, page: str | None = None, tasks: int | None = None,
    communities: Communities = community.girvan_newman,
) -> Graph:
    """Text files to a graph: chunks, extracted relations (kept in ``cache`` and read from there next time), graph, and an HTML page."""

    def relations() -> DataFrame:
        chunks = chunking.recursive_chunks(files.text_documents(spark, folder), size, overlap)
        return clean.clean_relations(extract.extract(chunks, factory, extract.RELATION, tasks=tasks), mode.parsed_weight)

    rows = files.cached(spark, cache, relations, regenerate) if cache else cut(relations(), "relations")
    graph = directed_graph(rows, mode, communities=communities)
    if page:
        html.write_page(graph.nodes, graph.edges, page)
    return graph


def entity_counts(documents: DataFrame, factory: Callable[[], extract.Extractor], size: int = 800, overlap: int = 100) -> DataFrame:
    """Named entities of chunked documents, counted per chunk."""
    chunks = chunking.recursive_chunks(documents, size, overlap)
    return entities.counts_by_chunk(clean.clean_entities(extract.entities_of_text(chunks, factory)))
