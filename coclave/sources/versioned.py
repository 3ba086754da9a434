"""A table in parts that can be written while it is read: new folders first, then a list of them, published last.

The list of each version is a file of its own, put in place by one rename that fails if the version is there already. Readers take
the newest list, so they see a version whole or not at all; a writer that dies leaves folders that no list names, and one that comes
second is told so and can try again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Versioned:
    """`part` gives the part of a row, a text; without it the table is one part."""

    def __init__(self, spark: SparkSession, path: str, part: Callable[[], Column] | None = None):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part or (lambda: F.lit("all"))
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    def version(self) -> int:
        """The number of the newest list, 0 before the first."""
        folder = self._at(f"{self.path}/_versions")
        if not self._files.exists(folder):
            return 0
        names = [x.getPath().getName() for x in self._files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def _read_list(self, version: int) -> dict:
        if not version:
            return {"schema": None, "parts": {}}
        rows = self.spark.read.text(self._list(version), wholetext=True).collect()
        return json.loads(rows[0]["value"])

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame | None:
        """The rows of a version, the newest if none is named, of these parts or all; None before the first."""
        listed = self._read_list(self.version() if version is None else version)
        if listed["schema"] is None:
            return None
        schema = StructType.fromJson(listed["schema"])
        folders = [f"{self.path}/{f}" for p, f in sorted(listed["parts"].items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def replace(self, rows: DataFrame, since: int | None = None, whole: bool = False) -> int:
        """Put these rows in place of the parts that they have, or of all parts, and return the new version.

        The version must follow on `since`, the one that the rows were made from; else nothing changes and FileExistsError is raised.
        """
        since = self.version() if since is None else since
        listed = {"parts": {}} if whole else self._read_list(since)
        folder = f"data-{uuid.uuid4().hex}"
        rows.withColumn("__part", F.coalesce(self.part().cast("string"), F.lit(""))).write.partitionBy("__part").parquet(f"{self.path}/{folder}")
        unescaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        for status in self._files.listStatus(self._at(f"{self.path}/{folder}")):
            name = status.getPath().getName()
            if name.startswith("__part="):
                value = unescaped(name[len("__part=") :])
                listed["parts"]["" if value == "__HIVE_DEFAULT_PARTITION__" else value] = f"{folder}/{name}"
        listed["schema"] = json.loads(rows.schema.json())
        self._publish(json.dumps(listed), since + 1)
        return since + 1

    def _publish(self, text: str, version: int) -> None:
        made, final = self._at(f"{self.path}/_versions/.{uuid.uuid4().hex}"), self._at(self._list(version))
        out = self._files.create(made, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        # A local file system would rename over a file that is there.
        if self._files.exists(final) or not self._files.rename(made, final):
            self._files.delete(made, False)
            raise FileExistsError(f"version {version} of {self.path} is there already")

    def upsert(self, new: DataFrame, keys: list[str]) -> int:
        """Rows of `new` in place of those with their keys, the others as they are; only parts that `new` touches are written again.

        A row must stay in its part as long as its keys are the same.
        """
        from coclave.sources.sinks import upsert

        since = self.version()
        touched = [r["p"] for r in new.select(F.coalesce(self.part().cast("string"), F.lit("")).alias("p")).distinct().collect()]
        old = self.read(since, touched)
        return self.replace(new if old is None else upsert(old, new, keys), since)
