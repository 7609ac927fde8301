"""Queries over the test tables, one for each operator, and the same rows in DuckDB's SQL.

Mapping of tables to chunked relations: an order is a chunk, a line relates a supplier to a part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators import chunking, clean, concepts, entities, extract, merge, proximity
from weftgraph.operators.graph import betweenness, build, community, rank, style
from weftgraph.operators.graph.components import connected_components
from weftgraph.plans import flows
from weftgraph.schemas import DIRECTED, PIPELINE
from weftgraph.sources import files
from weftgraph.storage import cut, new_path
from weftgraph.streaming import proximity as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- relations of orders ------------------------------------------------------------------------------


def raw_relations(spark: SparkSession, d: str) -> DataFrame:
    """Lines as dirty relations: blanks, nulls, untrimmed mixed case, weights that are no numbers."""
    return relations_of(table(spark, d, "lineitem"))


def relations_of(lines: DataFrame) -> DataFrame:
    part = F.col("l_partkey")
    return lines.select(
        F.when(part % 97 == 0, "").when(part % 89 == 0, None).otherwise(F.concat(F.lit("\t S"), F.col("l_suppkey"), F.lit(" "))).alias("source"),
        F.when(part % 83 == 0, " ").otherwise(F.concat(F.lit("P"), part)).alias("target"),
        F.concat(F.lit("Supplies "), "l_returnflag").alias("relationship"),
        F.when(F.col("l_quantity") > 45, "high").when(F.col("l_quantity") < 3, None).otherwise(F.col("l_quantity").cast("int").cast("string")).alias("weight"),
        F.col("l_linestatus").alias("description"),
        F.col("l_orderkey").cast("string").alias("chunk_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


_RAW = r"""raw AS (SELECT CASE WHEN l_partkey % 97 = 0 THEN '' WHEN l_partkey % 89 = 0 THEN NULL ELSE chr(9) || ' S' || l_suppkey || ' ' END AS source,
  CASE WHEN l_partkey % 83 = 0 THEN ' ' ELSE 'P' || l_partkey END AS target, 'Supplies ' || l_returnflag AS relationship,
  CASE WHEN l_quantity > 45 THEN 'high' WHEN l_quantity < 3 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS weight,
  l_linestatus AS description, CAST(l_orderkey AS VARCHAR) AS chunk_id, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)"""


def _clean_sql(default: float) -> str:
    return rf"""clean AS (SELECT lower(trim(source, ' ' || chr(9))) AS source, lower(trim(target)) AS target, lower(trim(relationship)) AS relationship,
  greatest(1.0, least(10.0, coalesce(try_cast(weight AS DOUBLE), {default}))) AS weight, description, chunk_id, ord
  FROM raw WHERE source <> '' AND target <> '' AND relationship <> '')"""


_CLEAN = f"WITH {_RAW}, {_clean_sql(5.0)}"


@query(_CLEAN + " SELECT source, target, relationship, weight, description, chunk_id FROM clean")
def relations_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_relations(raw_relations(spark, d)).select("source", "target", "relationship", "weight", "description", "chunk_id")


@query(rf"WITH {_RAW} SELECT source, target, relationship, greatest(1.0, least(10.0, coalesce(try_cast(weight AS DOUBLE), 4.0))) AS weight, '' AS description, chunk_id FROM raw")
def legacy_remap(spark: SparkSession, d: str) -> DataFrame:
    old = raw_relations(spark, d).withColumnsRenamed({"source": "node_1", "target": "node_2", "relationship": "edge", "weight": "count"}).drop("description", "ord")
    return clean.from_legacy(old).select("source", "target", "relationship", "weight", "description", "chunk_id")


@query(r"""SELECT e, CASE WHEN e IN ('', ' ', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN NULL ELSE e END AS value, count(*) AS n
FROM (SELECT list_extract(['NA', 'na', 'None', 'none', 'n/a', '<NA>', '-', 'ok'], CAST(event_id % 8 AS INTEGER) + 1) AS e FROM events) GROUP BY ALL""")
def na_strings(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("NA", "na", "None", "none", "n/a", "<NA>", "-", "ok")])
    e = table(spark, d, "events").select(F.get(words, (F.col("event_id") % 8).cast("int")).alias("e"))
    return e.select("e", text.na_to_null("e").alias("value")).groupBy("e", "value").agg(F.count("*").alias("n"))


# -- proximity and merging ----------------------------------------------------------------------------

_NEAR = """m AS (SELECT chunk_id, node, count(*) AS m FROM (SELECT chunk_id, source AS node FROM clean UNION ALL SELECT chunk_id, target FROM clean) GROUP BY ALL),
near AS (SELECT a.node AS source, b.node AS target, sum(a.m * b.m) AS count, count(*) AS chunks, string_agg(rtrim(repeat(a.chunk_id || ',', CAST(a.m * b.m AS BIGINT)), ','), ',' ORDER BY a.chunk_id) AS chunk_id
  FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.node <> b.node GROUP BY ALL HAVING sum(a.m * b.m) > 1 AND a.node <> '' AND b.node <> '')"""


@query(f"{_CLEAN}, {_NEAR} SELECT source, target, CAST(count AS BIGINT) AS count, CAST(least(count, 3) AS DOUBLE) AS weight, 'contextual proximity' AS relationship FROM near")
def proximity_edges(spark: SparkSession, d: str) -> DataFrame:
    near = proximity.proximity(clean.clean_relations(raw_relations(spark, d)), chunks=False)
    return near.select("source", "target", "count", "weight", "relationship")


@query(f"{_CLEAN}, {_NEAR} SELECT source, target, CAST(count AS BIGINT) AS count, chunk_id FROM near")
def proximity_chunks(spark: SparkSession, d: str) -> DataFrame:
    near = proximity.proximity(clean.clean_relations(raw_relations(spark, d)))
    return near.select("source", "target", "count", F.array_join("chunk_ids", ",").alias("chunk_id"))


def _union(description: str) -> str:
    return f"""u AS (SELECT source, target, 0 AS branch, ord, chunk_id, relationship, weight, description FROM clean
  UNION ALL SELECT source, target, 1, NULL, chunk_id, 'contextual proximity', CAST(least(count, 3) AS DOUBLE), '{description}' FROM near)"""


def _once(column: str) -> str:
    return f"(SELECT source, target, string_agg({column}, ' | ' ORDER BY branch, ord) AS {column} FROM (SELECT source, target, {column}, min(branch) AS branch, min(ord) AS ord FROM u GROUP BY ALL) GROUP BY ALL)"


@query(f"""{_CLEAN}, {_NEAR}, {_union(DIRECTED.proximity_description)}
SELECT s.source, s.target, s.chunk_id, r.relationship, s.weight, e.description, split_part(r.relationship, ' | ', 1) AS label FROM
 (SELECT source, target, string_agg(chunk_id, ',' ORDER BY branch, ord) AS chunk_id, sum(weight) AS weight FROM u GROUP BY ALL) s
 JOIN {_once("relationship")} r USING (source, target) JOIN {_once("description")} e USING (source, target)""")
def merge_directed(spark: SparkSession, d: str) -> DataFrame:
    return flows.merged_edges(clean.clean_relations(raw_relations(spark, d)), DIRECTED)


_MERGED = f"""{_CLEAN}, {_NEAR}, {_union(DIRECTED.proximity_description)}, v AS (SELECT source, target, r.relationship, s.weight, e.description, split_part(r.relationship, ' | ', 1) AS label FROM
 (SELECT source, target, sum(weight) AS weight FROM u GROUP BY ALL) s JOIN {_once("relationship")} r USING (source, target) JOIN {_once("description")} e USING (source, target))"""


@query(f"{_MERGED} SELECT source AS src, target AS dst, description AS title, label, weight, weight AS value FROM v")
def digraph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with their attributes, merged without lists of chunks."""
    return build.edges_of(flows.merged_edges(clean.clean_relations(raw_relations(spark, d)), DIRECTED, chunks=False))


@query(f"{_MERGED} SELECT weight, source, target, substring(trim(split_part(relationship, '|', 1)), 1, 35) AS label FROM v ORDER BY weight DESC, source, target LIMIT 10")
def heaviest_edges(spark: SparkSession, d: str) -> DataFrame:
    """The summary's top ten, with labels split off the text and cut to 35 characters."""
    return merge.heaviest(flows.merged_edges(clean.clean_relations(raw_relations(spark, d)), DIRECTED, chunks=False))


@query(f"""{_CLEAN}, {_NEAR}, {_union(PIPELINE.proximity_description)}
SELECT source, target, string_agg(chunk_id, ',' ORDER BY branch, ord) AS chunk_id, string_agg(relationship, ',' ORDER BY branch, ord) AS relationship, sum(weight) AS weight,
 string_agg(description, ' | ' ORDER BY branch, ord) AS description, arg_min(relationship, branch * 1e18 + coalesce(ord, 0)) AS label FROM u GROUP BY source, target""")
def merge_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return flows.merged_edges(clean.clean_relations(raw_relations(spark, d)), PIPELINE)


_NOTEBOOK = f"""{_CLEAN}, {_NEAR}, {_union("")}, nb AS (SELECT source AS node_1, target AS node_2, string_agg(chunk_id, ',' ORDER BY branch, ord) AS chunk_id,
 string_agg(relationship, ',' ORDER BY branch, ord) AS edge, CAST(sum(CASE WHEN branch = 0 THEN 4 ELSE n END) AS BIGINT) AS count
 FROM (SELECT u.*, near.count AS n FROM u LEFT JOIN near USING (source, target)) GROUP BY source, target)"""


@query(f"{_NOTEBOOK} SELECT * FROM nb")
def merge_notebook(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.clean_relations(raw_relations(spark, d))
    return merge.merge_counts(rows, proximity.proximity(rows))


@query(f"""{_NOTEBOOK} SELECT least(node_1, node_2) AS src, greatest(node_1, node_2) AS dst, arg_max(edge, node_1) AS title, arg_max(count, node_1) / 4 AS weight FROM nb GROUP BY ALL""")
def undirected_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.clean_relations(raw_relations(spark, d))
    return merge.last_counts(rows, proximity.half(rows, chunks=False))


_DIRECT = f"{_CLEAN}, {_NEAR}, {_union('')}, e AS (SELECT source, target, sum(weight) AS weight FROM u GROUP BY ALL)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Merged edges with their weight alone."""
    rows = clean.clean_relations(raw_relations(spark, d))
    return merge.summed_half(rows, proximity.half(rows, chunks=False))


@query(f"{_DIRECT} SELECT * FROM e ORDER BY weight DESC, source, target LIMIT 10")
def top_edges(spark: SparkSession, d: str) -> DataFrame:
    return merge.top_edges(_edges(spark, d), 10)


@query(f"{_DIRECT} SELECT count(*) AS edges, min(weight) AS least_weight, max(weight) AS largest_weight, (SELECT count(DISTINCT n) FROM (SELECT source AS n FROM e UNION ALL SELECT target FROM e)) AS nodes FROM e")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return build.summary(_edges(spark, d).withColumnsRenamed({"source": "src", "target": "dst"}))


# -- concepts and entities ----------------------------------------------------------------------------


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("p_brand").alias("entity"), (1 + F.col("l_quantity").cast("int") % 5).alias("importance"), F.col("l_orderkey").cast("string").alias("chunk_id")
    )


_PAIRS = """WITH c AS (SELECT lower(p_brand) AS entity, 1 + CAST(l_quantity AS INTEGER) % 5 AS importance, CAST(l_orderkey AS VARCHAR) AS chunk_id FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT l.entity AS entity_L, r.entity AS entity_R, avg(l.importance) AS importance_L, avg(r.importance) AS importance_R, count(*) AS count
 FROM c l JOIN c r ON l.chunk_id = r.chunk_id AND l.entity <> r.entity WHERE l.importance >= 2 GROUP BY ALL)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return concepts.cooccurrence(clean.clean_concepts(_concepts(spark, d)), chunks=False)


@query(_PAIRS + " SELECT entity_L, entity_R, round(importance_L, 6) AS importance_L, round(importance_R, 6) AS importance_R, count FROM p")
def concept_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("entity_L", "entity_R", F.round("importance_L", 6).alias("importance_L"), F.round("importance_R", 6).alias("importance_R"), "count")


@query(_PAIRS + " SELECT entity_L AS entity, round(avg(importance_L), 6) AS importance, round(avg(importance_L) * 6, 6) AS size FROM p WHERE entity_L <> 'brand#11' AND entity_R <> 'brand#11' GROUP BY ALL")
def concept_importance(spark: SparkSession, d: str) -> DataFrame:
    nodes = concepts.importance(clean.drop_nodes(_pairs(spark, d), ("brand#11",)))
    return nodes.select("entity", F.round("importance", 6).alias("importance"), F.round(style.concept_size("importance"), 6).alias("size"))


@query(_PAIRS + ", n AS (SELECT entity_L AS entity, avg(importance_L) AS importance FROM p GROUP BY ALL) SELECT entity, round(importance, 6) AS importance, CASE WHEN entity >= 'brand#3' THEN '#112233' END AS color FROM n")
def concept_colours(spark: SparkSession, d: str) -> DataFrame:
    nodes = concepts.importance(_pairs(spark, d))
    groups = nodes.where("entity >= 'brand#3'").select(F.col("entity").alias("node"), F.lit("#112233").alias("color"))
    return concepts.coloured(nodes, groups).select("entity", F.round("importance", 6).alias("importance"), "color")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("name"), F.concat(F.lit("u"), F.col("user_id") % 50).alias("entity"), F.date_format("ts", "yyyy-MM-dd").alias("chunk_id"))


_ENTITIES = "WITH c AS (SELECT event_type AS name, 'u' || (user_id % 50) AS entity, strftime(ts, '%Y-%m-%d') AS chunk_id, count(*) AS count FROM events GROUP BY ALL)"


@query(_ENTITIES + " SELECT * FROM c")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return entities.counts_by_chunk(clean.clean_entities(_entities(spark, d)))


@query(_ENTITIES + " SELECT name, entity, CAST(sum(count) AS BIGINT) AS count, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_id FROM c GROUP BY ALL")
def entity_totals(spark: SparkSession, d: str) -> DataFrame:
    return entities.totals(entity_counts(spark, d))


@query(_ENTITIES + " SELECT name, entity, CAST(sum(count) AS BIGINT) AS count FROM c GROUP BY ALL ORDER BY count DESC, name, entity LIMIT 100")
def entity_top100(spark: SparkSession, d: str) -> DataFrame:
    return entities.top(entity_counts(spark, d))


# -- graphs -------------------------------------------------------------------------------------------


def nation_graph(spark: SparkSession, d: str) -> DataFrame:
    """Supplier's nation to customer's nation, weighted by lines: every line counts, every pair stays."""
    o, c, s, li = (table(spark, d, x) for x in ("orders", "customer", "supplier", "lineitem"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return rows.groupBy(F.col("s_nationkey").cast("string").alias("src"), F.col("c_nationkey").cast("string").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def heavy_pairs(edges: DataFrame, least: float = 1.0) -> DataFrame:
    """Edges that weigh at least ``least`` times the mean edge: all nations trade with each other, so communities need a threshold."""
    return edges.join(F.broadcast(edges.agg(F.avg("weight").alias("mean")))).where(F.col("weight") >= least * F.col("mean")).drop("mean")


_NATIONS = """g AS (SELECT CAST(s_nationkey AS VARCHAR) AS src, CAST(c_nationkey AS VARCHAR) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
n AS (SELECT src AS id FROM g UNION SELECT dst FROM g)"""


@query(f"WITH {_NATIONS} SELECT id FROM n")
def digraph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return build.nodes_of(nation_graph(spark, d))


@query(f"WITH {_NATIONS}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g) SELECT id, count(*) AS degree FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY ALL")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return build.degree(nation_graph(spark, d))


@query(f"WITH {_NATIONS} SELECT id, round((SELECT count(*) FROM g WHERE dst = id) / ((SELECT count(*) FROM n) - 1), 9) AS centrality FROM n")
def indegree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return build.in_degree_centrality(nation_graph(spark, d)).select("id", F.round("centrality", 9).alias("centrality"))


def _rank(rounds: int) -> str:
    """So many rounds of PageRank of the edges ``g`` between the nodes ``n``, the last of which is ``r<rounds>``."""
    return """o AS (SELECT src, sum(weight) AS total FROM g GROUP BY ALL), k AS (SELECT count(*) AS k FROM n), r0 AS (SELECT id, 1.0 / k AS r FROM n, k)""" + "".join(
        f""", r{i + 1} AS (SELECT n.id, 0.85 * (coalesce(x.got, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o)) / k) + 0.15 / k AS r
 FROM n CROSS JOIN k LEFT JOIN (SELECT g.dst AS id, sum(r{i}.r * g.weight / o.total) AS got FROM g JOIN o USING (src) JOIN r{i} ON r{i}.id = g.src GROUP BY g.dst) x ON x.id = n.id)"""
        for i in range(rounds)
    )


@query(f"WITH {_NATIONS}, {_rank(10)} SELECT id, round(r, 9) AS pagerank FROM r10")
def pagerank_fixed10(spark: SparkSession, d: str) -> DataFrame:
    ranks, _ = rank.pagerank(nation_graph(spark, d), fixed=10)
    return ranks.select("id", F.round("pagerank", 9).alias("pagerank"))


#: A dense matrix of steps, and rounds until the changes sum to less than a millionth of the number of nodes.
_CONVERGED = """o AS (SELECT src, sum(weight) AS total FROM g GROUP BY ALL), k AS (SELECT count(*) AS k FROM n),
m AS (SELECT a.id AS src, b.id AS dst, 0.85 * coalesce(g.weight / o.total, CASE WHEN o.total IS NULL THEN 1.0 / k ELSE 0 END) + 0.15 / k AS p
  FROM n a CROSS JOIN n b CROSS JOIN k LEFT JOIN o ON o.src = a.id LEFT JOIN g ON g.src = a.id AND g.dst = b.id),
t AS (SELECT 0 AS round, id, CAST(1.0 / k AS DOUBLE) AS r FROM n, k UNION ALL SELECT t.round + 1, m.dst, sum(t.r * m.p) FROM t JOIN m ON m.src = t.id WHERE t.round < 100 GROUP BY t.round, m.dst),
d AS (SELECT b.round, sum(abs(b.r - a.r)) AS x FROM t a JOIN t b ON a.id = b.id AND b.round = a.round + 1 GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_NATIONS}, {_CONVERGED} SELECT id, round(r, 9) AS pagerank FROM t WHERE round = (SELECT min(round) FROM d, k WHERE x < 1e-6 * k)")
def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    return rank.rank_or_fall_back(nation_graph(spark, d))[0].select("id", F.round("pagerank", 9).alias("pagerank"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages to the paths that they link to."""
    links = F.regexp_extract_all("html", F.lit(r'href="(/[^"#?]+)"'), 1)
    return table(spark, d, "pages").select(F.concat(F.lit("page "), "page_id").alias("src"), F.explode(links).alias("dst"))


_LINKS = r"""l AS (SELECT 'page ' || page_id AS src, unnest(regexp_extract_all(html, 'href="(/[^"#?]+)"', 1)) AS dst FROM pages)"""
_PARTS = """b AS (SELECT src AS id, dst AS peer FROM l UNION SELECT dst, src FROM l),
t AS (SELECT DISTINCT id, id AS component FROM b UNION SELECT b.peer, t.component FROM t JOIN b ON b.id = t.id WHERE t.component < b.peer),
parts AS (SELECT id, min(component) AS component FROM t GROUP BY id)"""


@query(f"WITH RECURSIVE {_LINKS}, {_PARTS} SELECT * FROM parts")
def components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(page_links(spark, d))


@query(f"WITH {_LINKS}, u AS (SELECT DISTINCT src AS a, dst AS b FROM l) SELECT id, count(*) AS degree FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY ALL")
def degree_links(spark: SparkSession, d: str) -> DataFrame:
    """Degrees in the graph of links, which grows with the pages."""
    return build.degree(page_links(spark, d))


_LINK_GRAPH = f"{_LINKS}, g AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM l GROUP BY ALL), n AS (SELECT src AS id FROM g UNION SELECT dst FROM g)"


def _link_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rank.pagerank(page_links(spark, d), weight=None, fixed=5)[0]


@query(f"WITH {_LINK_GRAPH}, {_rank(5)} SELECT id, round(r, 9) AS pagerank FROM r5")
def pagerank_links(spark: SparkSession, d: str) -> DataFrame:
    """Five rounds on the graph of links, which grows with the pages."""
    return _link_ranks(spark, d).select("id", F.round("pagerank", 9).alias("pagerank"))


#: Numbers of walks of each length: where a node is first reached, they are the shortest paths. No shortest path has more steps than there are other nodes.
_BETWEENNESS = """u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g WHERE src <> dst), e AS (SELECT a AS v, b AS w FROM u UNION ALL SELECT b, a FROM u),
t AS (SELECT DISTINCT v AS s, v, 0 AS d, CAST(1 AS DOUBLE) AS walks FROM e UNION ALL SELECT t.s, e.w, t.d + 1, sum(t.walks) FROM t JOIN e ON e.v = t.v WHERE t.d < (SELECT count(*) - 1 FROM n) GROUP BY t.s, e.w, t.d),
p AS (SELECT s, v, min(d) AS d, arg_min(walks, d) AS paths FROM t GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_NATIONS}, {_BETWEENNESS} SELECT u.a AS src, u.b AS dst, round(sum(x.paths * y.paths / z.paths) / 2, 6) AS betweenness FROM u
 JOIN e ON (e.v = u.a AND e.w = u.b) OR (e.v = u.b AND e.w = u.a) JOIN p x ON x.v = e.v JOIN p y ON y.v = e.w JOIN p z ON z.s = x.s AND z.v = y.s AND z.d = x.d + 1 + y.d GROUP BY ALL""")
def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return betweenness.edge_betweenness(nation_graph(spark, d)).select("src", "dst", F.round("betweenness", 6).alias("betweenness"))


@query()
def communities_gn(spark: SparkSession, d: str) -> DataFrame:
    return community.girvan_newman(heavy_pairs(cut(nation_graph(spark, d), "nations")))


#: Label propagation, all rounds of it: once it is settled, a round changes nothing. Every node is its own neighbour here, as its own label counts.
_LABELS = f"""u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM l WHERE src <> dst), x AS (SELECT a AS id, b AS peer FROM u UNION ALL SELECT b, a FROM u),
e AS (SELECT id, peer FROM x UNION ALL SELECT DISTINCT id, id FROM x),
t AS (SELECT DISTINCT 0 AS round, id, id AS label FROM x UNION ALL
 SELECT round + 1, id, CASE WHEN substr(md5(id || ':' || round), 1, 1) < '8' THEN min(label) FILTER (WHERE n = most) ELSE max(own) END FROM (
  SELECT *, max(n) OVER (PARTITION BY id) AS most FROM (
   SELECT t.round, e.id, t.label, count(*) AS n, max(CASE WHEN e.id = e.peer THEN t.label END) AS own FROM t JOIN e ON e.peer = t.id WHERE t.round < {community.MAX_ROUNDS} GROUP BY ALL)) GROUP BY round, id),
labels AS (SELECT id, label FROM t WHERE round = {community.MAX_ROUNDS}),
same AS (SELECT x.id, x.peer FROM x JOIN labels a ON a.id = x.id JOIN labels b ON b.id = x.peer WHERE a.label = b.label),
c AS (SELECT id, id AS component FROM labels UNION SELECT same.peer, c.component FROM c JOIN same ON same.id = c.id WHERE c.component < same.peer),
found AS (SELECT id, min(component) AS component FROM c GROUP BY id), every AS (SELECT src AS id FROM l UNION SELECT dst FROM l)"""


@query(f"""WITH RECURSIVE {_LINKS}, {_LABELS} SELECT id AS node, CAST(dense_rank() OVER (ORDER BY coalesce(component, id)) AS INTEGER) AS "group" FROM every LEFT JOIN found USING (id)""")
def communities_label(spark: SparkSession, d: str) -> DataFrame:
    return community.label_communities(page_links(spark, d))


@query()
def node_style(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(nation_graph(spark, d), "nations")
    ranks, _ = rank.rank_or_fall_back(edges)
    return style.styled(build.nodes_of(edges), ranks, style.colours(community.girvan_newman(heavy_pairs(edges))))


def _channel(shift: str) -> str:
    h, low, top = f"(hue + {shift} - floor(hue + {shift}))", "(2 * 0.55 - (0.55 + 0.75 - 0.55 * 0.75))", "(0.55 + 0.75 - 0.55 * 0.75)"
    return f"""CAST(trunc(255 * CASE WHEN {h} < 1/6 THEN {low} + ({top} - {low}) * {h} * 6 WHEN {h} < 0.5 THEN {top} WHEN {h} < 2/3 THEN {low} + ({top} - {low}) * (2/3 - {h}) * 6 ELSE {low} END) AS INTEGER)"""


_STYLE = f"""groups AS (SELECT id, dense_rank() OVER (ORDER BY component) AS k FROM parts), total AS (SELECT CAST(max(k) AS DOUBLE) AS total FROM groups),
hues AS (SELECT id, k, CAST(k - 1 AS DOUBLE) / total AS hue FROM groups, total), coloured AS (SELECT id, k, printf('#%02x%02x%02x', {_channel("1/3")}, {_channel("0.0")}, {_channel("-1/3")}) AS color FROM hues)"""


@query(f"""WITH RECURSIVE {_LINK_GRAPH}, {_rank(5)}, {_PARTS}, {_STYLE}, bounds AS (SELECT min(r) AS low, max(r) AS high FROM r5)
SELECT id, CAST(k AS INTEGER) AS "group", color, CAST(trunc(10 + 50 * ((r - low) / CASE WHEN high = low THEN 1.0 ELSE high - low END)) AS INTEGER) AS size FROM coloured JOIN r5 USING (id), bounds""")
def link_style(spark: SparkSession, d: str) -> DataFrame:
    """Groups, colours and sizes in the graph of links, with components as communities."""
    edges = page_links(spark, d)
    groups = community.numbered(connected_components(edges).withColumnRenamed("id", "node"))
    ranks = _link_ranks(spark, d)
    return style.styled(build.nodes_of(edges), ranks, style.colours(groups))


# -- text ---------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "text")


@query(r"""SELECT md5(doc_id || chr(1) || pos || chr(1) || text) AS chunk_id, doc_id, pos, source, text FROM (
 SELECT doc_id, source, CAST(k AS INTEGER) AS pos, substring(text, CAST(k * 1350 AS BIGINT) + 1, 1500) AS text
 FROM (SELECT *, unnest(range(greatest(0, length(text) - 151) // 1350 + 1)) AS k FROM documents WHERE text <> ''))""")
def chunks_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_chunks(_documents(spark, d))


_FIXED = r"""f AS (SELECT md5(doc_id || chr(1) || pos || chr(1) || text) AS chunk_id, doc_id, pos, source, text FROM (
 SELECT doc_id, source, CAST(k AS INTEGER) AS pos, substring(text, CAST(k * 1350 AS BIGINT) + 1, 1500) AS text
 FROM (SELECT *, unnest(range(greatest(0, length(text) - 151) // 1350 + 1)) AS k FROM documents WHERE text <> '')))"""


@query(f"WITH {_FIXED} SELECT chunk_id, pos, text FROM f WHERE pos >= 1 AND pos < 3")
def chunk_slice(spark: SparkSession, d: str) -> DataFrame:
    """The second and third chunk of each document."""
    return chunking.chunk_range(chunking.fixed_chunks(_documents(spark, d)), 1, 3).select("chunk_id", "pos", "text")


@query(f"WITH {_FIXED} SELECT chunk_id, source, text FROM f")
def chunks_csv(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as a delimited table and read back: quotes, separators and line breaks in texts survive."""
    path = new_path(spark, "chunks_csv")
    files.write_table(chunking.fixed_chunks(_documents(spark, d)).select("text", "source", "chunk_id"), path)
    return files.read_chunks(spark, path).select("chunk_id", "source", "text")


@query(_CLEAN + " SELECT source, target, relationship, weight, chunk_id FROM clean WHERE source <> '' AND target <> ''")
def relations_csv(spark: SparkSession, d: str) -> DataFrame:
    """Clean relations written as a delimited table, read back and prepared as the directed mode prepares them: empty nodes count as missing there."""
    path = new_path(spark, "relations_csv")
    files.write_table(relations_clean(spark, d), path)
    return flows.prepared(files.read_relations(spark, path), DIRECTED).select("source", "target", "relationship", "weight", "chunk_id")


@query(f"WITH {_RAW}, clean AS (SELECT * FROM raw WHERE source <> '' AND target <> ''), {_NEAR.replace('a.node <> b.node', 'a.node < b.node')} SELECT source AS node_1, target AS node_2, CAST(count AS BIGINT) AS count FROM near")
def stream_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Pair counts of a stream of relations in three batches, each with a part of every order, and a fourth that delivers the first again."""
    parts, table_path, checkpoint = new_path(spark, "stream_parts"), new_path(spark, "stream"), new_path(spark, "stream_checkpoint")
    lines = relations_of(table(spark, d, "lineitem")).select("chunk_id", "source", "target").where("source <> '' and target <> ''")
    lines = cut(lines.withColumn("line", F.monotonically_increasing_id()), "stream_lines")
    for part in (0, 1, 2, 0):
        lines.where(F.col("line") % 3 == part).write.mode("append").parquet(parts)
        stream.start(spark.readStream.schema(lines.schema).parquet(parts), table_path, checkpoint, key="line").awaitTermination()
    return stream.totals(spark, table_path)


@query()
def chunks_recursive(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive_chunks(_documents(spark, d))


@query(r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE event_id % 4 = 0""")
def json_strict(spark: SparkSession, d: str) -> DataFrame:
    """Of four kinds of answer (a list, a bare object, trailing text, a list with a number) only the first has rows."""
    props, kind = F.col("props"), F.col("event_id") % 4
    answer = F.when(kind == 0, F.concat(F.lit("["), props, F.lit("]"))).when(kind == 1, props).when(kind == 2, F.concat(F.lit("["), props, F.lit("] done"))).otherwise(F.concat(F.lit("["), props, F.lit(", 5]")))
    return extract.parse_rows(table(spark, d, "events").select("event_id", answer.alias("answer")), "answer", "array<struct<k:string>>")


#: Words of four letters and more, in their order; each but the last precedes the next.
_TERMS = r"""w AS (SELECT md5(doc_id || chr(1) || pos || chr(1) || text) AS chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]{4,}') AS words FROM (
 SELECT doc_id, CAST(k AS INTEGER) AS pos, substring(text, CAST(k * 1350 AS BIGINT) + 1, 1500) AS text
 FROM (SELECT *, unnest(range(greatest(0, length(text) - 151) // 1350 + 1)) AS k FROM documents WHERE text <> ''))),
r AS (SELECT chunk_id, words[i] AS source, words[i + 1] AS target FROM (SELECT chunk_id, words, unnest(range(1, len(words))) AS i FROM w))"""


@query(f"WITH {_TERMS} SELECT source, target, 'precedes' AS relationship, CAST(1 AS DOUBLE) AS weight, '' AS description, chunk_id FROM r")
def doc_term_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of neighbouring words in every chunk, by the deterministic extractor."""
    chunks = chunking.fixed_chunks(_documents(spark, d))
    return clean.clean_relations(extract.extract(chunks, lambda: extract.RegexRelations()))


@query(f"WITH {_TERMS} SELECT source AS src, target AS dst, CAST(count(*) AS DOUBLE) AS weight FROM r GROUP BY ALL")
def doc_term_graph(spark: SparkSession, d: str) -> DataFrame:
    """Terms of documents and how often one comes right before another in a chunk."""
    return doc_term_relations(spark, d).groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.sum("weight").alias("weight"))
