"""Queries about concepts: spelling, association, backbone, cores, retrieval. They register beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import tables
from weftgraph.operators import association, canonical, chunking, clean, extract
from weftgraph.operators.graph import backbone, betweenness, cores, layout, modularity, retrieve
from weftgraph.plans.queries import _BETWEENNESS, _CLEAN, _DIRECT, _FIXED, _LINKS, _NATIONS, _TERMS, _documents, _edges, nation_graph, page_links, query, raw_relations, relations_clean, table
from weftgraph.sources import extraction_cache, files, quoted_csv, tiles
from weftgraph.storage import apart, cut, new_path

#: Words of four letters and more, as the relations of terms have them.
WORD = r"[\p{L}\p{Nl}\p{No}]{4,}"


def _words(text: str) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def terms(spark: SparkSession, d: str) -> DataFrame:
    """The words of documents and how often each occurs."""
    return table(spark, d, "documents").select(F.explode(_words("text")).alias("name")).groupBy("name").agg(F.count("*").alias("mentions"))


_CANONICAL = r"""names AS (SELECT name, count(*) AS mentions FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]{4,}')) AS name FROM documents) GROUP BY name),
g AS (SELECT name, row_number() OVER (ORDER BY name) AS id, list_distinct(list_transform(range(1, length(name) - 2), lambda i: substring(name, i, 4))) AS s FROM names),
e AS (SELECT id, len(s) AS k, unnest(s) AS t FROM g),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.t = b.t AND a.id < b.id AND 100 * a.k >= 75 * b.k AND 100 * b.k >= 75 * a.k
 GROUP BY a.id, b.id HAVING 175 * count(*) >= 75 * (any_value(a.k) + any_value(b.k))),
q AS (SELECT a AS id, b AS peer FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT id, id AS component FROM g UNION SELECT q.peer, c.component FROM c JOIN q ON q.id = c.id WHERE c.component < q.peer),
k AS (SELECT id, min(component) AS component FROM c GROUP BY id),
o AS (SELECT name, mentions, first_value(name) OVER (PARTITION BY component ORDER BY mentions DESC, name) AS canonical, count(*) OVER (PARTITION BY component) AS n_names FROM k JOIN g USING (id) JOIN names USING (name))"""


@query(f"WITH RECURSIVE {_CANONICAL} SELECT name, canonical, mentions, n_names FROM o")
def concept_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Terms of documents that share three quarters of their runs of four letters are one concept."""
    return canonical.canonical_names(terms(spark, d))


def term_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each word of a chunk to the next one."""
    words = chunking.fixed_chunks(_documents(spark, d)).select(_words("text").alias("w"))
    pairs = F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("src"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("dst"))
    return words.select(F.inline(pairs)).withColumn("weight", F.lit(1.0))


@query(f"""WITH RECURSIVE {_TERMS}, {_CANONICAL} SELECT * FROM (SELECT coalesce(a.canonical, r.source) AS src, coalesce(b.canonical, r.target) AS dst, CAST(count(*) AS DOUBLE) AS weight, count(*) AS n_edges
FROM r LEFT JOIN o a ON a.name = r.source LEFT JOIN o b ON b.name = r.target GROUP BY ALL) WHERE src <> dst""")
def contracted_edges(spark: SparkSession, d: str) -> DataFrame:
    """The graph of neighbouring terms with concepts in place of names."""
    return canonical.contract(term_edges(spark, d), cut(concept_canonical(spark, d), "canonical"))


_ASSOCIATED = f"""{_CLEAN}, x AS (SELECT chunk_id, node FROM (SELECT chunk_id, source AS node FROM clean UNION SELECT chunk_id, target FROM clean) WHERE chunk_id IS NOT NULL AND node IS NOT NULL),
c AS (SELECT node, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY node), n AS (SELECT CAST(count(DISTINCT chunk_id) AS DOUBLE) AS n FROM x),
k AS (SELECT a.node AS node_1, b.node AS node_2, count(*) AS n_chunks FROM x a JOIN x b ON a.chunk_id = b.chunk_id AND a.node < b.node GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT k.*, a.c AS ca, b.c AS cb, n FROM k JOIN c a ON a.node = node_1 JOIN c b ON b.node = node_2, n)"""


def _cell(observed: str, row: str, column: str) -> str:
    return f"CASE WHEN {observed} > 0 THEN {observed} * ln({observed} * n / ({row} * {column})) ELSE 0 END"


@query(f"""{_ASSOCIATED} SELECT node_1, node_2, n_chunks, round(CASE WHEN n_chunks = n THEN 1 ELSE ln(n_chunks * n / (ca * cb)) / -ln(n_chunks / n) END, 6) AS npmi,
 round(2 * ({_cell("n_chunks", "ca", "cb")} + {_cell("(ca - n_chunks)", "ca", "(n - cb)")} + {_cell("(cb - n_chunks)", "(n - ca)", "cb")} + {_cell("(n - ca - cb + n_chunks)", "(n - ca)", "(n - cb)")}), 6) AS llr FROM t""")
def proximity_npmi(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts of orders, weighed against chance."""
    found = association.associations(clean.clean_relations(raw_relations(spark, d)))
    return found.select("node_1", "node_2", "n_chunks", F.round("npmi", 6).alias("npmi"), F.round("llr", 6).alias("llr"))


@query(f"""{_CLEAN}, x AS (SELECT node, chunk_id, count(*) AS m FROM (SELECT chunk_id, source AS node FROM clean UNION ALL SELECT chunk_id, target FROM clean) GROUP BY ALL),
t AS (SELECT node, CAST(sum(m) AS BIGINT) AS mentions, count(*) AS n_chunks, greatest(0, ln(sum(m)) - sum(m * ln(m)) / sum(m)) AS entropy FROM x GROUP BY node)
SELECT node, mentions, n_chunks, round(entropy, 6) AS entropy, round(entropy / ln((SELECT count(DISTINCT chunk_id) FROM x)), 6) AS evenness FROM t""")
def concept_spread(spark: SparkSession, d: str) -> DataFrame:
    found = association.spread(clean.clean_relations(raw_relations(spark, d)))
    return found.select("node", "mentions", "n_chunks", F.round("entropy", 6).alias("entropy"), F.round("evenness", 6).alias("evenness"))


@query(f"""{_DIRECT}, s AS (SELECT source, sum(weight) AS total, count(*) AS k FROM e GROUP BY source), r AS (SELECT target, sum(weight) AS total, count(*) AS k FROM e GROUP BY target),
b AS (SELECT source AS src, target AS dst, weight, least(CASE WHEN s.k > 1 THEN pow(1 - weight / s.total, s.k - 1) ELSE 1 END, CASE WHEN r.k > 1 THEN pow(1 - weight / r.total, r.k - 1) ELSE 1 END) AS chance
 FROM e JOIN s USING (source) JOIN r USING (target) WHERE weight > 0) SELECT src, dst, weight, round(chance, 9) AS chance FROM b WHERE chance < 0.05""")
def edge_backbone(spark: SparkSession, d: str) -> DataFrame:
    """Merged edges of suppliers and parts that are significant for one of their ends."""
    edges = _edges(spark, d).withColumnsRenamed({"source": "src", "target": "dst"})
    return backbone.backbone(edges, single=True).select("src", "dst", "weight", F.round("chance", 9).alias("chance"))


#: Rounds of h-indices; once they are settled a round changes nothing.
_CORES = f"""{_LINKS}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM l WHERE src <> dst), x AS (SELECT a AS id, b AS peer FROM u UNION ALL SELECT b, a FROM u),
t AS (SELECT 0 AS round, id, count(*) AS core FROM x GROUP BY id UNION ALL
 SELECT round + 1, id, list_max(list_transform(range(1, len(v) + 1), lambda i: least(i, v[i]))) FROM (
  SELECT t.round, x.id, list(t.core ORDER BY t.core DESC) AS v FROM t JOIN x ON x.peer = t.id WHERE t.round < 40 GROUP BY t.round, x.id))"""


@query(f"WITH RECURSIVE {_CORES} SELECT id, core FROM t WHERE round = 40")
def core_numbers(spark: SparkSession, d: str) -> DataFrame:
    return cores.core_numbers(page_links(spark, d))


def _pushed(rounds: int) -> str:
    return f"""{_LINKS}, y AS (SELECT src AS id, dst AS peer FROM l UNION ALL SELECT dst, src FROM l WHERE src <> dst), z AS (SELECT id, peer, CAST(count(*) AS DOUBLE) AS w FROM y GROUP BY ALL),
v AS (SELECT id, sum(w) AS degree FROM z GROUP BY id), r0 AS (SELECT DISTINCT src AS seed, src AS id, CAST(0 AS DOUBLE) AS score, CAST(1 AS DOUBLE) AS residual FROM l)""" + "".join(
        f""", r{i + 1} AS (SELECT seed, id, sum(score) AS score, sum(residual) AS residual FROM (
 SELECT seed, peer AS id, 0 AS score, 0.85 * residual * (w / degree) AS residual FROM r{i} JOIN v USING (id) JOIN z USING (id) WHERE residual > 0.001 * degree
 UNION ALL SELECT seed, id, score + CASE WHEN residual > 0.001 * degree THEN 0.15 * residual ELSE 0 END, CASE WHEN residual > 0.001 * degree THEN 0 ELSE residual END FROM r{i} JOIN v USING (id)) GROUP BY ALL)"""
        for i in range(rounds)
    )


@query(f"WITH {_pushed(5)} SELECT seed, CAST(row_number() OVER p AS INTEGER) AS rank, id AS node, round(score, 9) AS score FROM (SELECT seed, id, score + 0.15 * residual AS score FROM r5) WHERE id <> seed AND score > 0 WINDOW p AS (PARTITION BY seed ORDER BY round(score, 9) DESC, id) QUALIFY row_number() OVER p <= 10")
def retrieve_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten paths and pages nearest to each page by links, after five rounds of pushes."""
    edges = cut(page_links(spark, d), "links").withColumn("weight", F.lit(1.0))
    found = retrieve.retrieve_neighbours(edges, edges.select(F.col("src").alias("seed")), k=10, rounds=5)
    return found.select("seed", "rank", "node", F.round("score", 9).alias("score"))


@query()
def communities_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the graph of links between pages and paths."""
    return modularity.modularity_communities(page_links(spark, d), weight=None)


@query(f"""WITH RECURSIVE {_NATIONS}, {_BETWEENNESS}, chosen AS (SELECT id FROM n ORDER BY md5(id), id LIMIT 10),
f AS (SELECT u.a, u.b, sum(x.paths * y.paths / z.paths) / 2 * ((SELECT count(*) FROM n) / 10.0) AS found FROM u
 JOIN e ON (e.v = u.a AND e.w = u.b) OR (e.v = u.b AND e.w = u.a) JOIN p x ON x.v = e.v JOIN p y ON y.v = e.w JOIN p z ON z.s = x.s AND z.v = y.s AND z.d = x.d + 1 + y.d WHERE x.s IN (SELECT id FROM chosen) GROUP BY ALL)
SELECT u.a AS src, u.b AS dst, round(coalesce(found, 0), 6) AS betweenness, round((SELECT count(*) * (count(*) - 1) / 2 FROM n) * sqrt(ln(2 * (SELECT count(*) FROM u) / 0.05) / 20), 6) AS bound FROM u LEFT JOIN f USING (a, b)""")
def edge_betweenness_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Edge betweenness of the nation graph from ten of its nodes, with the bound of its error."""
    found = betweenness.sampled_betweenness(nation_graph(spark, d), sources=10)
    return found.select("src", "dst", F.round("betweenness", 6).alias("betweenness"), F.round("bound", 6).alias("bound"))


@query(f"WITH {_TERMS} SELECT source, target, 'precedes' AS relationship, chunk_id FROM r")
def cached_term_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of neighbouring words by way of the extraction cache: documents' first chunks are extracted first, then all, of which only the others are new."""
    chunks = chunking.fixed_chunks(_documents(spark, d)).select("chunk_id", "pos", "text")
    cache = extraction_cache.ExtractionCache(spark, new_path(spark, "extraction_cache"))
    for some in (chunks.where("pos = 0"), chunks):
        found = cache.extracted(some, extract.RegexRelations, "neighbours of four letters", fields=("source", "target", "relationship"))
    return found.select("source", "target", "relationship", "chunk_id")


@query(_CLEAN + " SELECT source, target, relationship, weight, chunk_id FROM clean")
def relations_csv_split(spark: SparkSession, d: str) -> DataFrame:
    """Clean relations written as a delimited table and read back in byte ranges of 64 KiB."""
    path = new_path(spark, "relations_csv")
    files.write_table(relations_clean(spark, d), path)
    found = quoted_csv.read_quoted(spark, path, ["source", "target", "relationship", "weight", "chunk_id"], split_bytes=1 << 16)
    return found.withColumn("weight", F.col("weight").cast("double"))


_SUCCESSIVE = """SELECT user_id, place, value, next FROM (SELECT user_id, row_number() OVER w AS place, event_type AS value, lead(event_type) OVER w AS next, lead(event_id) OVER w AS following
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE following IS NOT NULL"""


@query(_SUCCESSIVE)
def successive_sql(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events and the next ones, by a table function over partitions in order."""
    tables.register(spark)
    return spark.sql(
        "SELECT * FROM successive(TABLE(SELECT user_id, ts, event_id, event_type FROM {events}) PARTITION BY user_id ORDER BY (ts, event_id), 'user_id', 'event_type')", events=table(spark, d, "events")
    )


@query()
def chunks_sql(spark: SparkSession, d: str) -> DataFrame:
    """The recursive chunks, by a table function: equal to ``chunks_recursive``, as tests hold."""
    tables.register(spark)
    return spark.sql("SELECT * FROM chunks(TABLE(SELECT doc_id, source, text FROM {documents}), 1500, 150)", documents=_documents(spark, d))


@query(f"WITH {_TERMS} SELECT source, target, 'precedes' AS relationship, chunk_id FROM r")
def relations_sql(spark: SparkSession, d: str) -> DataFrame:
    """Relations of neighbouring words, by a table function over chunks."""
    tables.register(spark)
    return spark.sql("SELECT source, target, relationship, chunk_id FROM relations(TABLE(SELECT chunk_id, text FROM {chunks}), 4)", chunks=chunking.fixed_chunks(_documents(spark, d)))


@query(rf"""WITH {_FIXED}, e AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nl}}\p{{No}}]{{8,}}')) AS entity FROM f)
SELECT entity, CAST(least(5, count(*)) AS INTEGER) AS importance, 'concept' AS category, chunk_id, 'concept' AS type FROM e GROUP BY entity, chunk_id""")
def concepts_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of every chunk of documents with their importance, by the deterministic extractor."""
    return extract.concepts(chunking.fixed_chunks(_documents(spark, d)), extract.FrequentWords)


_ENTITIES = rf"""{_FIXED}, e AS (SELECT chunk_id, text, regexp_extract_all(text, '[A-Z][\p{{L}}\p{{N}}_''-]*(?: [A-Z][\p{{L}}\p{{N}}_''-]*)*') AS names FROM f)"""


@query(f"WITH {_ENTITIES} SELECT name, 'MISC' AS entity, chunk_id FROM (SELECT unnest(names) AS name, chunk_id FROM e)")
def entities_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Named entities of every chunk of documents: runs of capitalised words."""
    return extract.entities_of_text(chunking.fixed_chunks(_documents(spark, d)), extract.CapitalisedEntities)


@query(f"""WITH {_ENTITIES}, p AS (SELECT chunk_id, names[1] AS entity_1, names[2] AS entity_2, list_filter(regexp_split_to_array(text, '[.!?\\n]'), lambda s: contains(s, names[1]) AND contains(s, names[2])) AS shared
 FROM e WHERE len(names) > 1) SELECT chunk_id, entity_1, entity_2, coalesce(trim(shared[1], chr(32) || chr(9) || chr(13)), '') AS relationship, len(shared) > 0 AS related FROM p""")
def pairs_judged(spark: SparkSession, d: str) -> DataFrame:
    """The first two named entities of every chunk, judged by whether a sentence names both."""
    chunks = chunking.fixed_chunks(_documents(spark, d)).select("chunk_id", "text", F.regexp_extract_all("text", F.lit(r"[A-Z][\p{L}\p{N}_'-]*(?: [A-Z][\p{L}\p{N}_'-]*)*"), 0).alias("n"))
    pairs = chunks.where(F.size("n") > 1).select("chunk_id", "text", F.col("n")[0].alias("entity_1"), F.col("n")[1].alias("entity_2"))
    return extract.judged_pairs(pairs, extract.SameSentence).drop("text")


@query(f"""WITH {_LINKS}, n AS (SELECT src AS id FROM l UNION SELECT dst FROM l), k AS (SELECT count(*) AS n FROM n)
SELECT CAST(unnest(range(CAST(greatest(0, ceil(round(ln(n / 256.0) / ln(4), 9))) AS BIGINT) + 1)) AS INTEGER) AS z, n AS n_nodes FROM k""")
def graph_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The graph of links laid out and written as tiles; how many nodes the tiles of each zoom level show."""
    links = cut(page_links(spark, d).withColumn("weight", F.lit(1.0)), "links")
    places = layout.layout(links)
    weighed = places.join(apart(links.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("weight"))), "id", "left").select("id", "x", "y", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.lit("#4477aa").alias("color"))
    folder = new_path(spark, "tiles")
    tiles.write_tiles(weighed, links, folder)
    shown = spark.read.schema("k string, n long").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{folder}/tiles").withColumn("path", F.input_file_name())
    return shown.where("k = 'n'").groupBy(F.regexp_extract("path", "/tiles/([0-9]+)/", 1).cast("int").alias("z")).agg(F.sum("n").alias("n_nodes"))
