"""Cleaning of relations, concepts and entities.

The order of the steps matters: empty texts become null, incomplete rows go, and only then are texts
stripped and lower-cased. So a text of spaces survives as an empty one, unless ``strict_blank`` asks
for stripping first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import blank_to_null, na_to_null, tidy, weight

ENDS = ["source", "target", "relationship"]


def require(relations: DataFrame, columns: list[str] = ENDS) -> DataFrame:
    """The table itself; ``ValueError`` if a column is missing."""
    if missing := [c for c in columns if c not in relations.columns]:
        raise ValueError(f"relations lack {', '.join(missing)}")
    return relations


def with_defaults(relations: DataFrame, default_weight: float = 4.0) -> DataFrame:
    """Weight and description, where the table has none."""
    out = relations
    if "weight" not in out.columns:
        out = out.withColumn("weight", F.lit(float(default_weight)))
    if "description" not in out.columns:
        out = out.withColumn("description", F.lit(""))
    return out


def sanitize(relations: DataFrame, normalize: bool = True, strict_blank: bool = False) -> DataFrame:
    """Complete relations only; stripped and lower-cased if ``normalize``."""
    ends = {c: blank_to_null(tidy(c) if strict_blank else F.col(c)) for c in ENDS}
    out = require(relations).withColumns(ends).na.drop(subset=ENDS)
    return out.withColumns({c: tidy(c) for c in ENDS}) if normalize else out


def clean_relations(relations: DataFrame, default_weight: float = 5.0, strict_blank: bool = False) -> DataFrame:
    """Relations as parsed: complete, normalised, with a weight from 1 to 10 and a description."""
    out = with_defaults(sanitize(relations, True, strict_blank), default_weight)
    return out.withColumns({"weight": weight("weight", default_weight), "description": F.coalesce(F.col("description").cast("string"), F.lit(""))})


def from_cache(relations: DataFrame) -> DataFrame:
    """What a relation file says, with its texts for missing values as null."""
    return relations.withColumns({c: na_to_null(c) for c, kind in relations.dtypes if kind == "string"})


def from_legacy(relations: DataFrame, default_weight: float = 4.0) -> DataFrame:
    """Relations in the old schema (node_1, node_2, edge, perhaps count) in the new one; a table that has ``source`` is in the new one already.

    Weight comes from ``count`` or is the default, and the description is empty, whatever else the old table holds.
    """
    if "node_1" not in relations.columns or "source" in relations.columns:
        return relations
    value = weight("count", default_weight) if "count" in relations.columns else F.lit(float(default_weight))
    kept = relations.withColumns({"_weight": value}).drop("count", "weight", "description", "target", "relationship")
    out = kept.withColumnsRenamed({"node_1": "source", "node_2": "target", "edge": "relationship", "_weight": "weight"})
    return out.withColumn("description", F.lit(""))


def clean_concepts(concepts: DataFrame) -> DataFrame:
    """Concepts with an entity, lower-cased and not stripped; only the text of one space counts as missing."""
    columns = {c: blank_to_null(c, " ") for c, kind in concepts.dtypes if kind == "string"}
    return concepts.withColumns(columns).where("entity is not null").withColumn("entity", F.lower("entity"))


def clean_entities(entities: DataFrame) -> DataFrame:
    """Named entities with an entity; only the text of one space counts as missing."""
    columns = {c: blank_to_null(c, " ") for c, kind in entities.dtypes if kind == "string"}
    return entities.withColumns(columns).where("entity is not null")


def drop_nodes(edges: DataFrame, nodes: tuple[str, ...], left: str = "entity_L", right: str = "entity_R") -> DataFrame:
    """Edges that touch none of the nodes, which are those of the corpus at hand that touch too much to say anything (case matters)."""
    return edges.where(~F.col(left).isin(*nodes) & ~F.col(right).isin(*nodes))
