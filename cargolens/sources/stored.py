"""Tables of immutable parts behind a small manifest, so that a change is seen whole or not at all.

A write puts its rows beside those that are there, in a folder of its own with one partition
for each value of the partition column. Then one rename puts a new manifest in place, which
names the folders of each value. Readers take the last manifest: they see all of a write or
nothing of it, a failed job leaves what was there, and values can be replaced, extended or
emptied. A write can carry the number of its batch; a batch that is in the manifest already is
not written again, which makes repeated batches of a stream harmless. One writer at a time: of
two that start from the same manifest the second fails and can be run again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

FOLDER = "stored_part"


class Stored:
    """``schema`` holds all columns with the partition column ``by``, a string or an integer."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, by: str = "namespace"):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.jvm = spark.sparkContext._jvm
        self.fs = self._file("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._file(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def manifest(self) -> dict:
        """version, parts (partition -> folders) and batches (writer -> last number)."""
        versions = [n for n in self._names("manifest") if n.endswith(".json")]
        if not versions:
            return {"version": 0, "parts": {}, "batches": {}}
        stream = self.fs.open(self._file(f"manifest/{versions[-1]}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        manifest["version"] += 1
        beside, final = self._file(f"manifest/{uuid.uuid4().hex}.tmp"), self._file(f"manifest/{manifest['version']:012d}.json")
        stream = self.fs.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            stream.close()
        if self.fs.exists(final) or not self.fs.rename(beside, final):
            self.fs.delete(beside, False)
            raise RuntimeError(f"another writer changed {self.path}; run this write again")

    def _partition(self, value) -> str:
        escaped = self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))
        return f"{self.by}={escaped}"

    def write(self, rows: DataFrame, replace: bool = True, values: list | None = None, batch: tuple[str, int] | None = None, **options: str) -> bool:
        """Replaces the values of the partition column that stand in ``rows``, or adds to them.

        ``values`` are replaced also if they have no rows: they are empty then. ``batch`` is a
        writer and a number that rises; False if that batch is there already. ``options`` go to
        the Parquet writer; rows keep their order.
        """
        manifest = self.manifest()
        if batch is not None and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return False
        folder = uuid.uuid4().hex
        columns = [f.name for f in self.schema if f.name != self.by]
        rows.select(*columns, self.by).write.options(**options).partitionBy(self.by).parquet(f"{self.path}/data/{FOLDER}={folder}")
        if replace:
            for value in values or []:
                manifest["parts"].pop(self._partition(value), None)
        for name in self._names(f"data/{FOLDER}={folder}"):
            if name.startswith(f"{self.by}="):
                manifest["parts"][name] = [folder] if replace else [*manifest["parts"].get(name, []), folder]
        if batch is not None:
            manifest["batches"][batch[0]] = batch[1]
        self._commit(manifest)
        return True

    def read(self) -> DataFrame:
        """All rows; a condition on the partition column reads its partitions only."""
        base = f"{self.path}/data"
        paths = [f"{base}/{FOLDER}={f}/{name}" for name, folders in self.manifest()["parts"].items() for f in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", base).parquet(*paths)
        return rows.select(*(F.col(f"`{f.name}`") for f in self.schema))

    def vacuum(self) -> list[str]:
        """Deletes folders and manifests that the last manifest does not need; for times without readers of older ones."""
        manifest = self.manifest()
        used = {f"{FOLDER}={f}" for folders in manifest["parts"].values() for f in folders}
        gone = [n for n in self._names("data") if n not in used]
        for n in gone:
            self.fs.delete(self._file(f"data/{n}"), True)
        for n in self._names("manifest"):
            if n != f"{manifest['version']:012d}.json":
                self.fs.delete(self._file(f"manifest/{n}"), False)
        return gone

    def drop(self) -> None:
        self.fs.delete(self._file(""), True)
