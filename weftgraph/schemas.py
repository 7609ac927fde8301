"""Tables at stage boundaries, and the settings in which the modes of the graph pipeline differ."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_s, _l, _d, _i = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


DOCUMENTS = _table(doc_id=_s, source=_s, text=_s)
CHUNKS = _table(chunk_id=_s, doc_id=_s, pos=_i, source=_s, text=_s)
CHUNKS_CSV = _table(text=_s, source=_s, chunk_id=_s)
RELATIONS = _table(source=_s, target=_s, relationship=_s, weight=_s, description=_s, chunk_id=_s)
LEGACY_RELATIONS = _table(node_1=_s, node_2=_s, edge=_s, count=_s, chunk_id=_s)
CONCEPTS = _table(entity=_s, importance=_i, category=_s, chunk_id=_s, type=_s)
ENTITIES = _table(name=_s, entity=_s, chunk_id=_s)

# Texts that a relation file means as missing.
NA_STRINGS = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class Mode:
    """One generation of the pipeline. ``separator`` joins relationships; ``distinct`` drops repeats when edges merge."""

    name: str
    directed: bool
    separator: str
    distinct: bool
    #: Weight where a parsed relation, a cached one, and one in the old schema has none.
    parsed_weight: float = 5.0
    cached_weight: float = 4.0
    legacy_weight: float = 4.0
    #: Whether cached relations are stripped, lower-cased and have their weights clipped.
    normalize: bool = True
    proximity_label: str = "contextual proximity"
    proximity_description: str = ""
    #: Which colours communities get: see ``style.colours``.
    palette: str = "soft"


# What proximity edges of the two directed modes say.
PIPELINE = Mode("pipeline", True, ",", False, normalize=False, proximity_description="These concepts co-occur in the same text chunk.")
DIRECTED = Mode("directed", True, " | ", True, proximity_description="Co-occurring concepts in the same text chunk.", palette="even")
NOTEBOOK = Mode("notebook", False, ",", False)
CONCEPT = Mode("concepts", False, ",", False)
MODES = {m.name: m for m in (PIPELINE, DIRECTED, NOTEBOOK, CONCEPT)}
