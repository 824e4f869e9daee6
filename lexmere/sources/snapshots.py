"""Versioned tables: immutable Parquet layers and a manifest of versions, tags and branches.

A table is a list of layers. A layer adds rows, and may first take away the rows of earlier layers that
agree with it in some columns; so a commit writes its own rows and keys, whatever the table's size. Reading joins the
layers' keys against the older rows; after MOST_LAYERS of them a commit writes the table anew as one layer.

Every commit adds one version to the manifest. Manifests are numbered files: each is written beside and renamed to the next
number, which fails where another writer was first, and the newest one counts; a writer that stops at any point leaves the one before in force.
Reading a version reads its layers; restoring appends a version with an old one's layers; a branch has its own head. Files go
through Hadoop's file system, so any store that Spark knows will do.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere import schemas
from lexmere.operators.relational import keyed_merge, null_safe

MOST_LAYERS = 16
#: Older manifests that are kept.
KEPT = 20


class ConflictError(RuntimeError):
    """Another writer committed in between."""


@dataclass(frozen=True)
class Change:
    """rows are added after the rows that agree with gone in its columns are taken away; whole: nothing older stays."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    whole: bool = False


class Store:
    def __init__(self, spark: SparkSession, path: str, branch: str = "main") -> None:
        self.spark, self.path, self.branch = spark, path.rstrip("/"), branch
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._folder = f"{self.path}/manifests"
        self._fs.mkdirs(self._path(self._folder))
        if not self._numbers():
            try:
                self._write({"versions": [], "tags": {}, "branches": {"main": 0}, "serial": 0})
            except ConflictError:
                pass  # another one has made the store meanwhile

    def _numbers(self) -> list[int]:
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(self._folder)))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))

    def _read(self) -> dict[str, Any]:
        stream = self._fs.open(self._path(f"{self._folder}/{self._numbers()[-1]}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _write(self, manifest: dict[str, Any]) -> None:
        """The manifest under its serial number, or a conflict if there is one."""
        jvm, number = self.spark._jvm, manifest["serial"]
        new, to = self._path(f"{self._folder}/new-{uuid.uuid4().hex}"), self._path(f"{self._folder}/{number}.json")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(manifest, indent=1).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs.makeQualified(new), self._fs.makeQualified(to), options)  # never over a file
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise ConflictError(f"manifest {number} was written by another writer") from None
        self._fs.delete(self._path(f"{self._folder}/{number - KEPT}.json"), False)

    def _changed(self, manifest: dict[str, Any]) -> None:
        self._write(manifest | {"serial": manifest["serial"] + 1})

    def _append(self, manifest: dict[str, Any], operation: str, tables: dict[str, Any]) -> int:
        number = max([0, *(v["version"] for v in manifest["versions"])]) + 1
        manifest["versions"].append({"version": number, "at": dt.datetime.now(dt.UTC).isoformat(), "operation": operation, "branch": self.branch, "tables": tables})
        manifest["branches"][self.branch] = number
        self._changed(manifest)
        return number

    def _version(self, manifest: dict[str, Any], ref: int | str | None) -> dict[str, Any] | None:
        if ref is None:
            ref = manifest["branches"][self.branch]
        elif isinstance(ref, str):
            ref = manifest["branches"].get(ref, manifest["tags"].get(ref))
            if ref is None:
                raise KeyError("no such tag or branch")
        if ref == 0:
            return None
        return next(v for v in manifest["versions"] if v["version"] == ref)

    def _rows(self, name: str, folder: str) -> DataFrame:
        return self.spark.read.schema(schemas.TABLES[name]).parquet(f"{self.path}/{folder}")

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], schemas.TABLES[name])

    def _merged(self, name: str, layers: list[dict[str, Any]]) -> DataFrame:
        added = [(i, self._rows(name, x["rows"])) for i, x in enumerate(layers) if x.get("rows")]
        if not added:
            return self._empty(name)
        if len(layers) == 1:
            return added[0][1]
        rows = reduce(DataFrame.unionByName, (df.withColumn("__at", F.lit(i)) for i, df in added))
        of = dict(self._empty(name).dtypes)
        for on in sorted({tuple(x["on"]) for x in layers if x.get("gone")}):
            schema = ", ".join(f"__{c} {of[c]}" for c in on)
            gone = [self.spark.read.schema(schema).parquet(f"{self.path}/{x['gone']}").withColumn("__since", F.lit(i)) for i, x in enumerate(layers) if x.get("gone") and tuple(x["on"]) == on]
            last = reduce(DataFrame.unionByName, gone).groupBy(*[f"__{c}" for c in on]).agg(F.max("__since").alias("__since"))
            rows = rows.join(last, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on)) & (F.col("__at") < F.col("__since")), "left_anti")
        return rows.drop("__at")

    def table(self, name: str, version_as_of: int | str | None = None) -> DataFrame:
        """A table as of a version number, tag or branch; the branch's head if none is named. Never written: empty."""
        version = self._version(self._read(), version_as_of)
        return self._merged(name, (version or {"tables": {}})["tables"].get(name, []))

    def stamp(self, name: str, ref: int | str | None = None) -> str | None:
        """Which commit wrote a table's last layer: the same for all tables that it changed; None for a table that was never written."""
        layers = (self._version(self._read(), ref) or {"tables": {}})["tables"].get(name)
        return None if not layers else re.search(r"/(?:rows|gone|whole)-(.*)", layers[-1].get("rows") or layers[-1]["gone"])[1]

    def change(self, changes: dict[str, Change], operation: str) -> int:
        """Writes the layers and adds one version that has all of them or none."""
        before = self._read()
        tables = dict((self._version(before, None) or {"tables": {}})["tables"])
        mark = f"{before['serial'] + 1}-{uuid.uuid4().hex[:8]}"
        for name, c in changes.items():
            layer: dict[str, Any] = {}
            old = [] if c.whole else tables.get(name, [])
            if c.gone is not None and old:
                layer |= {"gone": f"{name}/gone-{mark}", "on": c.gone.columns}
                c.gone.distinct().toDF(*[f"__{x}" for x in c.gone.columns]).write.parquet(f"{self.path}/{layer['gone']}")
            if c.rows is not None:
                layer["rows"] = f"{name}/rows-{mark}"
                c.rows.select(*self._empty(name).columns).write.parquet(f"{self.path}/{layer['rows']}")
            layers = [*old, layer] if layer else old
            if len(layers) > MOST_LAYERS:
                whole = f"{name}/whole-{mark}"
                self._merged(name, layers).write.parquet(f"{self.path}/{whole}")
                layers = [{"rows": whole}]
            tables[name] = layers
        return self._append(before, operation, tables)

    def commit(self, changed: dict[str, DataFrame], operation: str) -> int:
        """The tables whole, in one version."""
        return self.change({n: Change(df, whole=True) for n, df in changed.items()}, operation)

    def merge(self, name: str, delta: DataFrame, mode: str = "update") -> Change:
        """The change that keyed_merge of a delta into the table by its natural key would make."""
        keys = list(schemas.KEYS[name])
        latest = keyed_merge(self._empty(name), delta, keys)
        if mode == "update":
            return Change(latest, latest.select(*keys))
        known = self.table(name)
        if mode == "ignore":
            return Change(null_safe(latest, known, keys, "left_anti"))
        return Change(keyed_merge(null_safe(known, latest, keys, "left_semi"), latest, keys, mode), latest.select(*keys))

    def upsert(self, deltas: dict[str, DataFrame], operation: str, mode: str = "update") -> int:
        """Merges each delta by its table's natural key and commits all at once."""
        return self.change({n: self.merge(n, d, mode) for n, d in deltas.items()}, operation)

    def versions(self) -> list[dict[str, Any]]:
        """Newest first, with the tags of each."""
        m = self._read()
        return [v | {"tags": sorted(t for t, n in m["tags"].items() if n == v["version"])} for v in reversed(m["versions"])]

    def tag(self, name: str, version: int | None = None) -> None:
        m = self._read()
        m["tags"][name] = m["branches"][self.branch] if version is None else version
        self._changed(m)

    def create_branch(self, name: str, version: int | str | None = None) -> None:
        m = self._read()
        if name in m["branches"]:
            raise ValueError("the branch exists")
        at = self._version(m, version)
        m["branches"][name] = at["version"] if at else 0
        self._changed(m)

    def branches(self) -> dict[str, int]:
        return self._read()["branches"]

    def on_branch(self, name: str) -> Store:
        if name not in self.branches():
            raise KeyError("no such branch")
        return Store(self.spark, self.path, name)

    def restore(self, version: int | str) -> int:
        """A new version with an old one's tables."""
        m = self._read()
        old = self._version(m, version)
        return self._append(m, f"restore {version}", dict(old["tables"]) if old else {})

    def size(self) -> int:
        """Bytes of all snapshots."""
        return self._fs.getContentSummary(self._path(self.path)).getLength()
