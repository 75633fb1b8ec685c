"""Tables whose parts (runs, buckets) are replaced together or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """Several Parquet tables below a folder, all made of parts that a column names.

    A commit stages the parts of all its tables under a new version, writes a
    manifest, the table of which version each part has now, and makes both
    visible by renaming one small file. Until then, and after a killed job, readers see
    the state before. Parts that a commit doesn't name stay. Two commits at
    once can't both take the same number: the second one fails.

    folders: each part is a folder of its own, so parts that a later commit
    replaced are not read; for few parts, as every task writes a file for each
    part that it has. Without folders files hold many parts, sorted by them,
    and their number doesn't grow with that of the parts.
    """

    def __init__(self, spark: SparkSession, root: str, part: str, folders: bool = True):
        self.spark, self.root, self.part, self.folders = spark, root.rstrip("/"), part, folders
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        fs, at = self._system(), self._path("_commits")
        return sorted(int(x.getPath().getName().split(".")[0]) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def _read_commit(self, number: int) -> dict:
        stream = self._system().open(self._path(f"_commits/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def state(self) -> dict:
        """The last commit: number, manifest, tables, label; an empty one at first."""
        found = self._commits()
        return self._read_commit(found[-1]) if found else {"number": 0, "manifest": None, "tables": {}, "label": None}

    def manifest(self) -> DataFrame:
        """(part, version) now."""
        at = self.state()["manifest"]
        if at is None:
            return self.spark.createDataFrame([], f"`{self.part}` string, version string")
        return self.spark.read.schema(f"`{self.part}` string, version string").parquet(f"{self.root}/{at}")

    def commit(self, tables: dict[str, DataFrame], parts: DataFrame | None = None, label=None) -> int:
        """Replaces parts in all tables; their number. parts: (part), those to replace, also if no row has them any more; by default those that tables name. label: what state() tells of this commit."""
        was, version = self.state(), uuid.uuid4().hex
        named = None
        for name, df in tables.items():
            at = f"{self.root}/{name}/version={version}"
            if self.folders:
                df.write.partitionBy(self.part).parquet(at)
            else:
                df.withColumn(self.part, F.col(self.part).cast("string")).sortWithinPartitions(self.part).write.parquet(at)
            if parts is None:
                here = df.select(F.col(self.part).cast("string").alias(self.part))
                named = here if named is None else named.union(here)
        new = (named if parts is None else parts.select(F.col(self.part).cast("string").alias(self.part))).distinct().withColumn("version", F.lit(version))
        old = self.manifest().join(new.select(self.part), self.part, "left_anti")
        at = f"_manifests/{version}"
        old.unionByName(new).write.parquet(f"{self.root}/{at}")
        number = was["number"] + 1
        schemas = was["tables"] | {name: df.schema.json() for name, df in tables.items()}
        self._publish(number, {"number": number, "manifest": at, "tables": schemas, "label": label})
        return number

    def _publish(self, number: int, content: dict) -> None:
        jvm, fs = self.spark.sparkContext._jvm, self._system()
        staged, final = self._path(f"_commits/.{uuid.uuid4().hex}"), self._path(f"_commits/{number:012d}.json")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(staged, final, keep)  # fails if another job took the number

    def read(self, name: str) -> DataFrame:
        """A table's rows now. Versions and parts that the manifest doesn't name are neither listed in the result nor read."""
        from pyspark.sql.types import StructType

        state = self.state()
        schema = StructType.fromJson(json.loads(state["tables"][name]))
        manifest = self.manifest()
        versions = [r["version"] for r in manifest.select("version").distinct().collect()]
        there = [v for v in versions if self._system().exists(self._path(f"{name}/version={v}"))]
        kind = schema[self.part].dataType
        if not there:
            return self.spark.createDataFrame([], schema)
        file_schema = StructType([f for f in schema.fields if f.name != self.part]).add("version", "string").add(self.part, "string")
        rows = self.spark.read.schema(file_schema).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/version={v}" for v in there])
        return rows.join(manifest, [self.part, "version"], "left_semi").select(*[F.col(self.part).cast(kind).alias(self.part) if c == self.part else F.col(c) for c in schema.names])

    def vacuum(self) -> int:
        """Deletes versions that no part has now, those of killed jobs included, and earlier manifests; how many folders. Only while no job writes or reads an earlier state."""
        fs, state = self._system(), self.state()
        used = {r["version"] for r in self.manifest().select("version").distinct().collect()}
        gone = 0
        for name in [*state["tables"], "_manifests"]:
            at = self._path(name)
            for x in fs.listStatus(at) if fs.exists(at) else []:
                found = x.getPath().getName()
                if f"{name}/{found}" != state["manifest"] if name == "_manifests" else found.removeprefix("version=") not in used:
                    fs.delete(x.getPath(), True)
                    gone += 1
        return gone
