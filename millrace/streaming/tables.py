"""Tables that micro-batches write: exact under retries, and with a bounded number of files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEPT = 16  # batches that lie beside the base before they are folded into it


class BatchTable:
    """Rows of micro-batches below ``path``: a base, the parts of the batches since, and a manifest that names both.

    A batch writes a part under a new name and then publishes a manifest, so readers see all of a batch or nothing, and
    a retried batch replaces its part as a whole.  With ``keys`` a row replaces older rows of its key (an upsert table);
    without, rows are appended.  Every ``KEPT`` batches the parts are folded into a new base, so a reader opens a bounded number of
    parts and, with keys, stored rows follow the number of keys.  What the last two manifests do not name is removed; a reader
    that planned its scan before that has one more batch to finish.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), kept: int = KEPT) -> None:
        self.spark, self.path, self.keys, self.kept = spark, path, list(keys), kept
        self._home = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._home.getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names("log") if n.endswith(".json")]

    def _load(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/log/{name}", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        """The manifest gets its name only once it is whole."""
        number = f"{manifest['version']:012d}"
        unnamed, named = self._place("log", f"_{number}-{uuid.uuid4().hex}"), self._place("log", f"{number}.json")
        out = self._fs.create(unnamed, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(unnamed, named):
            raise OSError(f"{named} was written by someone else")

    def _rows(self, manifest: dict, schema: StructType) -> DataFrame:
        named = [n for n in (manifest["base"], *manifest["parts"].values()) if n]
        stored = StructType([*schema.fields]).add("_batch", "long")
        if not named:
            return self.spark.createDataFrame([], stored)
        rows = self.spark.read.schema(stored).parquet(*[f"{self.path}/data/{n}" for n in named])
        if not self.keys:
            return rows
        rest = [c for c in rows.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
        return newest.select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*stored.names)

    def write(self, rows: DataFrame, batch: int) -> None:
        """The rows of one batch (with ``keys``, one for each key).  Batches come in order; the last may come again."""
        versions = self._manifests()
        manifest = self._load(versions[-1]) if versions else {"version": -1, "folded": -1, "base": None, "parts": {}}
        if batch <= manifest["folded"]:
            return  # the base holds it; a retried batch has the rows it had
        name = f"{batch:010d}-{uuid.uuid4().hex}"
        rows.withColumn("_batch", F.lit(batch).cast("long")).write.parquet(f"{self.path}/data/{name}")
        manifest = {**manifest, "version": manifest["version"] + 1, "parts": {**manifest["parts"], str(batch): name}}
        if len(manifest["parts"]) >= self.kept:
            base = f"base-{batch:010d}-{uuid.uuid4().hex}"
            self._rows(manifest, rows.schema).write.parquet(f"{self.path}/data/{base}")
            manifest = {**manifest, "folded": batch, "base": base, "parts": {}}
        self._publish(manifest)
        self._clean(manifest, versions)

    def _clean(self, manifest: dict, versions: list[str]) -> None:
        used = [manifest, *map(self._load, versions[-1:])]
        named = {n for m in used for n in (m["base"], *m["parts"].values())}
        for name in self._names("data"):
            if name not in named:
                self._fs.delete(self._place("data", name), True)
        for name in versions[:-1]:
            self._fs.delete(self._place("log", name), False)

    def read(self, schema: StructType) -> DataFrame:
        """All rows, with ``keys`` the newest of each key; none before the first batch.  ``schema`` is that of the batches."""
        versions = self._manifests()
        manifest = self._load(versions[-1]) if versions else {"base": None, "parts": {}}
        return self._rows(manifest, schema).drop("_batch")
