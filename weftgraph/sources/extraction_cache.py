"""A cache of extractions that grows by what is new, read in whole versions.

What an extractor finds in a text is kept under the SHA-256 of the extractor's name and the text, so a chunk is asked for again only if its text
or the extractor changes, and equal texts are asked for once. What a run adds is a part, written under a new name: a table with a row for each text, its key and the lists of
its rows' values, so that a key is written and shuffled once for all rows of its text. (Older parts have a table of keys and one of rows, and are read too.) A version
is a manifest, the list of its parts; it is written aside and renamed, so a reader sees a whole version or the one before. A writer that dies leaves a part
that no manifest names: nobody reads it, and ``vacuum`` deletes it. Two writers at once both add their parts: the second finds its number taken and goes one further.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators import extract


class ExtractionCache:
    """The cache in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str = extract.RELATION):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fields = [f.name for f in T.DataType.fromDDL(schema).elementType.fields if f.name != "key"]

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _listed(self, name: str) -> list:
        path = self._path(name)
        files = path.getFileSystem(self._conf)
        return list(files.listStatus(path)) if files.exists(path) else []

    def version(self) -> int:
        """The number of the latest version; 0 where there is none."""
        names = [x.getPath().getName() for x in self._listed("manifests")]
        return max((int(x.removesuffix(".json")) for x in names if x.endswith(".json") and not x.startswith(".")), default=0)

    def parts(self, version: int | None = None) -> list[str]:
        """Names of a version's parts; of the latest where none is given."""
        version = self.version() if version is None else version
        if not version:
            return []
        text = self.spark.read.text(f"{self.folder}/manifests/{version:012}.json", wholetext=True).first()[0]
        return json.loads(text)["parts"]

    def _table(self, part: str, kind: str, value: str) -> DataFrame:
        return self.spark.read.schema(", ".join(["key string", *[f"`{n}` {value}" for n in self._fields]])).parquet(f"{self.folder}/parts/{part}/{kind}")

    def _lists(self, parts: list[str]) -> DataFrame:
        """``key`` and a list for each field. A key of an older part has a row for each of its rows."""
        tables = [
            self._table(x, "rows", "string").select("key", *[F.array(f"`{n}`").alias(n) for n in self._fields]) if self._listed(f"parts/{x}/rows") else self._table(x, "lists", "array<string>") for x in parts
        ]
        return reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], ", ".join(["key string", *[f"`{n}` array<string>" for n in self._fields]]))

    def keys(self, version: int | None = None) -> DataFrame:
        tables = [self.spark.read.schema("key string").parquet(f"{self.folder}/parts/{x}/{'keys' if self._listed(f'parts/{x}/keys') else 'lists'}") for x in self.parts(version)]
        return reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], "key string")

    def rows(self, version: int | None = None) -> DataFrame:
        """``key`` and what was extracted, all as text. A text in which nothing was found has a key and no row."""
        return self._lists(self.parts(version)).select("key", self._inline(self._fields))

    @staticmethod
    def _inline(fields: list[str]) -> Column:
        return F.inline(F.arrays_zip(*[F.col(f"`{n}`") for n in fields]))

    def _commit(self, part: str) -> int:
        aside = self._path("manifests", f".{uuid.uuid4().hex}")
        files = aside.getFileSystem(self._conf)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
        no_option = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        while True:
            version = self.version()
            out = files.create(aside, True)
            out.write(bytearray(json.dumps({"parts": [*self.parts(version), part]}).encode()))
            out.close()
            target = self._path("manifests", f"{version + 1:012}.json")
            try:
                context.rename(aside, target, no_option)
                return version + 1
            except Exception:
                if not files.exists(target):  # else another writer was first
                    raise

    def extracted(self, chunks: DataFrame, factory: Callable[[], extract.Extractor], name: str, column: str = "text", keep: tuple[str, ...] = ("chunk_id",), fields: tuple[str, ...] | None = None, **options) -> DataFrame:
        """Rows of every chunk, as ``extract.extract`` gives them, or these ``fields`` of them; the extractor, known by ``name``, reads only texts that the cache lacks.

        Chunks of a null text give no rows. Failed answers count as empty and are kept, so name an extractor anew to ask again.
        """
        keyed = chunks.where(F.col(column).isNotNull()).select(*keep, F.col(column), F.sha2(F.concat(F.lit(name + "\x01"), F.col(column)), 256).alias("#key"))
        texts = keyed.select(F.col("#key").alias("key"), column).dropDuplicates(["key"])
        part = uuid.uuid4().hex
        extract.extract(texts.join(self.keys(), "key", "left_anti"), factory, self.schema, column, keep=("key",), lists=True, **options).write.parquet(f"{self.folder}/parts/{part}/lists")
        if self._table(part, "lists", "array<string>").isEmpty():
            path = self._path("parts", part)
            path.getFileSystem(self._conf).delete(path, True)
        else:
            self._commit(part)
        names = [n for n in self._fields if n not in keep and (fields is None or n in fields)]
        lists = self._lists(self.parts()).where(F.size(f"`{names[0]}`") > 0)
        # A list whose values have no line break goes as one text: it shuffles in a quarter of the bytes of an array.
        plain = {n: F.forall(f"`{n}`", lambda x: x.isNotNull() & ~x.contains("\n")) for n in names}
        texts_of = [F.when(plain[n], F.array_join(f"`{n}`", "\n")).alias(f"#text {n}") for n in names]
        rest = [F.when(~plain[n], F.col(f"`{n}`")).alias(f"#list {n}") for n in names]
        found = keyed.select(*keep, "#key").join(lists.select(F.col("key").alias("#key"), *texts_of, *rest), "#key")
        whole = found.select(*keep, *[F.coalesce(f"`#list {n}`", F.split(F.col(f"`#text {n}`"), "\n", -1)).alias(f"#{n}") for n in names])
        return whole.select(*keep, self._inline([f"#{n}" for n in names])).toDF(*keep, *names)

    def vacuum(self, versions: int = 1, older_than: float = 86_400.0) -> list[str]:
        """Delete manifests but the latest ``versions``, and parts that none of these names and that nobody has written to for so many seconds."""
        latest = self.version()
        for x in self._listed("manifests"):
            name = x.getPath().getName()
            if name.endswith(".json") and not name.startswith(".") and int(name.removesuffix(".json")) <= latest - versions:
                x.getPath().getFileSystem(self._conf).delete(x.getPath(), False)
        used = {p for v in range(max(1, latest - versions + 1), latest + 1) for p in self.parts(v)}
        gone = []
        for x in self._listed("parts"):
            name = x.getPath().getName()
            if name not in used and x.getModificationTime() / 1000 <= time.time() - older_than:
                x.getPath().getFileSystem(self._conf).delete(x.getPath(), True)
                gone.append(name)
        return gone
