"""Extraction: text in, rows out.

An extractor turns a batch of texts into answers, each the JSON text of a list of objects. It is made once per
worker task by a factory, so that a model or an HTTP session is set up once. Answers are parsed strictly: a text whose
answer is anything but a list of objects gives no rows. The chunk's own columns win over keys of the same name. An extractor that finds
rows itself has a method ``rows`` that gives them as they are, without the way by JSON, or ``columns``, which gives the rows of many texts by column.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELATION = "array<struct<source:string, target:string, relationship:string, weight:string, description:string>>"
OLD_RELATION = "array<struct<node_1:string, node_2:string, edge:string>>"
CONCEPT = "array<struct<entity:string, importance:string, category:string>>"
TYPED_CONCEPT = "array<struct<entity:string, importance:string, type:string>>"
NAMED_ENTITY = "array<struct<name:string, entity:string>>"
# The kinds of concept that the concept prompt allows.
CATEGORIES = ("event", "concept", "place", "object", "document", "organisation", "condition", "misc")


class Extractor(Protocol):
    def __call__(self, texts: list[str]) -> list[str | None]: ...


#: Texts that an extractor gets at once, and rows of a batch that goes on.
TEXTS, ROWS = 256, 10_000


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _fields(schema: str) -> list[T.StructField]:
    return T.DataType.fromDDL(schema).elementType.fields


def strict_rows(text: str | None) -> list[dict] | None:
    """The objects of a JSON list of objects; None for any other text."""
    try:
        rows = json.loads(text)
    except (TypeError, ValueError):
        return None
    return rows if isinstance(rows, list) and all(isinstance(x, dict) for x in rows) else None


def strict_json(text: str | None) -> str | None:
    """The text itself if it is a JSON list of objects, with scalars as text; else null."""
    rows = strict_rows(text)
    return None if rows is None else json.dumps([{k: _text(v) for k, v in x.items()} for x in rows])


def _strict(column: Column) -> Column:
    @F.arrow_udf("string")
    def check(answers: pa.Array) -> pa.Array:
        return pa.array([strict_json(x) for x in answers.to_pylist()], pa.string())

    return check(column)


def parse_rows(table: DataFrame, column: str, schema: str, fail_fast: bool = False) -> DataFrame:
    """The table's columns but ``column``, and the fields of each object in it. Keys that the table has are ignored."""
    checked = _strict(F.col(column))
    if fail_fast:
        checked = F.coalesce(checked, F.raise_error(F.concat(F.lit("not a JSON list of objects: "), F.coalesce(F.col(column), F.lit("no answer")))))
    rest = [c for c in table.columns if c != column]
    rows = table.select(*rest, F.explode(F.from_json(checked, schema)).alias("_row"))
    names = [f.name for f in rows.schema["_row"].dataType.fields if f.name not in rest]
    return rows.select(*rest, *[F.col(f"_row.{n}").alias(n) for n in names])


def extract(chunks: DataFrame, factory: Callable[[], Extractor], schema: str = RELATION, column: str = "text", keep: tuple[str, ...] = ("chunk_id",), tasks: int | None = None, fail_fast: bool = False, lists: bool = False) -> DataFrame:
    """Rows extracted from each chunk. ``tasks`` bounds how many extractors run at once. With ``lists`` each chunk is one row, and a column has the list of its values.

    Answers are parsed where they are made, ``TEXTS`` at a time, and rows go on in batches of ``ROWS``, so a worker never holds
    the answers of a whole batch of chunks.
    """
    picked = chunks.select(*keep, column)
    if tasks:
        picked = picked.repartition(tasks)
    names = [f.name for f in _fields(schema) if f.name not in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = factory()
        for batch in batches:
            at, found = [], []
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                texts = [x or "" for x in part.column(len(keep)).to_pylist()]
                if hasattr(extractor, "columns"):
                    yield from listed(part, *extractor.columns(texts))
                    continue
                answers = extractor.rows(texts) if hasattr(extractor, "rows") else extractor(texts)
                for d, answer in enumerate(answers, i):
                    rows = answer if isinstance(answer, list) else strict_rows(answer)
                    if rows is None and fail_fast:
                        raise ValueError(f"not a JSON list of objects: {answer}")
                    for row in rows or ():
                        at.append(d)
                        found.append(row)
                    if len(found) >= ROWS and not lists:
                        yield made(batch, at, found)
                        at, found = [], []
                if lists:
                    yield gathered(part, [d - i for d in at], [pa.array([_text(x.get(n)) for x in found], pa.string()) for n in names])
                    at, found = [], []
            if not lists:
                yield made(batch, at, found)

    def listed(part: pa.RecordBatch, at: list[int], values: dict[str, list | str]) -> Iterator[pa.RecordBatch]:
        n = len(at)
        found = [pa.repeat(v, n) if isinstance(v, str) else pa.array(v, pa.string()) if v is not None else pa.nulls(n, pa.string()) for v in map(values.get, names)]
        if lists:
            yield gathered(part, at, found)
            return
        own = [c.take(pa.array(at, pa.int64())) for c in part.columns[: len(keep)]]
        whole = pa.RecordBatch.from_arrays([*own, *found], [*keep, *names])
        yield from (whole.slice(i, ROWS) for i in range(0, n, ROWS))

    def gathered(part: pa.RecordBatch, at: list[int], found: list[pa.Array]) -> pa.RecordBatch:
        n = Counter(at)  # rows are in order of their texts
        ends = pa.array(list(accumulate((n[d] for d in range(part.num_rows)), initial=0)), pa.int32())
        return pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *[pa.ListArray.from_arrays(ends, x) for x in found]], [*keep, *names])

    def made(batch: pa.RecordBatch, at: list[int], found: list[dict]) -> pa.RecordBatch:
        own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(keep)]]
        return pa.RecordBatch.from_arrays([*own, *[pa.array([_text(x.get(n)) for x in found], pa.string()) for n in names]], [*keep, *names])

    kinds = [f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep]
    return picked.mapInArrow(run, ", ".join([*kinds, *[f"`{n}` {'array<string>' if lists else 'string'}" for n in names]]))


def concepts(chunks: DataFrame, factory: Callable[[], Extractor], **options) -> DataFrame:
    """``(entity, importance, category, chunk_id, type)``."""
    rows = extract(chunks, factory, CONCEPT, **options)
    return rows.select("entity", F.col("importance").try_cast("int").alias("importance"), "category", "chunk_id", F.lit("concept").alias("type"))


def entities_of_text(chunks: DataFrame, factory: Callable[[], Extractor], **options) -> DataFrame:
    """``(name, entity, chunk_id)`` of a named-entity extractor over chunk texts."""
    return extract(chunks, factory, NAMED_ENTITY, **options).select("name", "entity", "chunk_id")


def entities_of_concepts(concept_rows: DataFrame, factory: Callable[[], Extractor]) -> DataFrame:
    """``(entity, category, chunk_id, type)`` of a named-entity extractor over each concept: its word and its kind."""
    rows = extract(concept_rows.select("chunk_id", F.col("entity").alias("_text")), factory, NAMED_ENTITY, "_text")
    return rows.select(F.col("name").alias("entity"), F.col("entity").alias("category"), "chunk_id", F.lit("entity").alias("type"))


def judged_pairs(pairs: DataFrame, factory: Callable[[], Extractor]) -> DataFrame:
    """``pairs`` (``entity_1``, ``entity_2``, ``text`` and others) with ``relationship`` and ``related`` as an extractor judges them.

    The extractor reads both entities and their context; its answer is one JSON object. Any other answer leaves both columns null.
    """
    rest = [c for c in pairs.columns if c not in ("relationship", "related")]
    asked = pairs.select(*rest, F.concat(F.lit("Entities: ['"), F.col("entity_1"), F.lit("', '"), F.col("entity_2"), F.lit("']. Context: ```"), F.col("text"), F.lit("```")).alias("_asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = factory()
        for batch in batches:
            answers = [pair_judgement(x) for x in extractor([x or "" for x in batch.column(len(rest)).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *[pa.array([a[k] for a in answers], t) for k, t in enumerate((pa.string(), pa.bool_()))]], [*rest, "relationship", "related"])

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in rest)
    return asked.mapInArrow(run, f"{kinds}, relationship string, related boolean")


def pair_judgement(answer: str | None) -> tuple[str | None, bool | None]:
    """Relationship and whether the entities are related, of an answer to ``PAIR_PROMPT``."""
    try:
        found = json.loads(answer)
        return str(found["Relationship"]), str(found["Related"]).strip().lower() in ("yes", "true")
    except (TypeError, ValueError, KeyError):
        return None, None


class RegexRelations:
    """Neighbouring words of at least ``length`` letters are related. Deterministic; for tests and offline runs."""

    def __init__(self, length: int = 4, relationship: str = "precedes"):
        self.word, self.relationship = re.compile(rf"[^\W\d_]{{{length},}}"), relationship

    def columns(self, texts: list[str]) -> tuple[list[int], dict[str, list | str]]:
        """The number of each row's text, and the rows' values by column: a text for a column is that of every row."""
        at, source, target = [], [], []
        for i, text in enumerate(texts):
            words = self.word.findall(text.lower())
            at += [i] * (len(words) - 1)
            source += words[:-1]
            target += words[1:]
        return at, {"source": source, "target": target, "relationship": self.relationship, "weight": "1", "description": ""}

    def rows(self, texts: list[str]) -> list[list[dict]]:
        found = [self.word.findall(text.lower()) for text in texts]
        return [[{"source": a, "target": b, "relationship": self.relationship, "weight": "1", "description": ""} for a, b in pairwise(words)] for words in found]

    def __call__(self, texts: list[str]) -> list[str]:
        return [json.dumps(x) for x in self.rows(texts)]


class CapitalisedEntities:
    """Runs of capitalised words are named entities of the kind ``MISC``. Deterministic; for tests and offline runs."""

    def __init__(self, kind: str = "MISC"):
        self.run, self.kind = re.compile(r"[A-Z][\w'-]*(?: [A-Z][\w'-]*)*"), kind

    def rows(self, texts: list[str]) -> list[list[dict]]:
        return [[{"name": x, "entity": self.kind} for x in self.run.findall(t)] for t in texts]

    def __call__(self, texts: list[str]) -> list[str]:
        return [json.dumps(x) for x in self.rows(texts)]


class FrequentWords:
    """Words of at least ``length`` letters are concepts, as important as they are frequent in the text, up to 5. Deterministic."""

    def __init__(self, length: int = 8, category: str = "concept"):
        self.word, self.category = re.compile(rf"[^\W\d_]{{{length},}}"), category

    def rows(self, texts: list[str]) -> list[list[dict]]:
        counted = [Counter(self.word.findall(t.lower())) for t in texts]
        return [[{"entity": w, "importance": min(5, n), "category": self.category} for w, n in c.items()] for c in counted]

    def __call__(self, texts: list[str]) -> list[str]:
        return [json.dumps(x) for x in self.rows(texts)]


class SameSentence:
    """Judges two entities to be related if one sentence of the context names both. Deterministic; reads what ``judged_pairs`` asks."""

    asked = re.compile(r"Entities: \['(.*?)', '(.*?)'\]\. Context: ```(.*)```", re.DOTALL)

    def __call__(self, texts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for text in texts:
            if found := self.asked.fullmatch(text):
                a, b, context = found.groups()
                both = [s.strip() for s in re.split(r"[.!?\n]", context) if a in s and b in s]
                out.append(json.dumps({"Entity 1": a, "Entity 2": b, "Relationship": both[0] if both else "", "Related": "Yes" if both else "No"}))
            else:
                out.append(None)
        return out


class ModelEntities:
    """Named entities of a token-classification model, loaded once per worker task. Needs the ``transformers`` package and the model's files."""

    def __init__(self, model: str):
        from transformers import pipeline

        self.find = pipeline("token-classification", model=model, aggregation_strategy="simple")

    def __call__(self, texts: list[str]) -> list[str]:
        return [json.dumps([{"name": x["word"], "entity": x["entity_group"]} for x in found]) for found in self.find(texts)]


RELATION_PROMPT = (
    "Read the passage between the fences and list how its terms act on each other. Answer with a JSON list and nothing else. Each object has "
    '"source" (the term that acts), "target" (the term acted on), "relationship" (a short active predicate), "weight" (1 for implied to 10 for '
    'central) and "description" (one sentence from the passage). Terms are short, lower case and spelled alike throughout; state nothing that the passage does not.'
)
CONCEPT_PROMPT = (
    "List the concepts of the text as a JSON list of objects and nothing else: \"entity\", \"importance\" from 1 to 5, and \"category\", one of "
    + ", ".join(CATEGORIES) + ". Break compound concepts into simple ones and leave persons out."
)
OLD_RELATION_PROMPT = 'List pairs of related terms of the passage as a JSON list of objects with "node_1", "node_2" and "edge" (one sentence on how they are related), and nothing else.'
PAIR_PROMPT = 'Say whether the two entities are directly related in the context, and only there. Answer with one JSON object: "Entity 1", "Entity 2", "Relationship" (one sentence) and "Related" ("Yes" or "No").'


class ServerExtractor:
    """Asks a local model server; a text whose request fails has no answer."""

    def __init__(self, model: str, system: str = RELATION_PROMPT, url: str | None = None):
        from weftgraph.sources.model_server import Client

        self.client, self.model, self.system = Client(url), model, system

    def __call__(self, texts: list[str]) -> list[str | None]:
        return [self.client.generate(self.model, f"context: ```{t}```\n\noutput:", system=self.system)[0] for t in texts]
