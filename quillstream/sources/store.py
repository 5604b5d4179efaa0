"""Tables of rows by key that readers always see whole: versions of changed rows, and a manifest that names the ones that count.

A commit writes the changed rows of one or several tables into folders of their
own, and then one small manifest, created only if its number is free. What a
killed write leaves is in no manifest, and a manifest that is cut short is passed
over, so readers see a commit of all its tables or nothing of it. Reading takes
the newest row of each key over the folders of the last manifest; ``compact``
writes those into one folder, ``vacuum`` deletes what no kept manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Labels of commits that are remembered, so that a batch done again is not committed twice.
LABELS = 1000


class ConcurrentCommit(RuntimeError):
    """Another writer took the manifest's number."""


class VersionedTables:
    """keys: table -> the columns that name its rows."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, number: int) -> dict | None:
        """A manifest, or None if its writer was stopped."""
        stream = self._fs.open(self._path(f"{self.path}/manifests/{number:012d}.json"))
        try:
            raw = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        try:
            return json.loads(raw)
        except ValueError:
            return None

    def current(self) -> tuple[int, dict]:
        """The last whole manifest and its number; 0 and an empty one before the first commit."""
        for n in reversed(self._numbers()):
            if (found := self._load(n)) is not None:
                return n, found
        return 0, {"tables": {}, "labels": []}

    def _publish(self, base: int, manifest: dict) -> int:
        number = max([base, *self._numbers()]) + 1
        if self.current()[0] != base:
            raise ConcurrentCommit(f"{self.path}: manifest {self.current()[0]} came while one after {base} was written")
        target = self._path(f"{self.path}/manifests/{number:012d}.json")
        try:
            out = self._fs.create(target, False)
        except Exception as e:
            raise ConcurrentCommit(f"{self.path}: manifest {number} is taken") from e
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        return number

    # -- rows

    def _write(self, table: str, rows: DataFrame) -> str:
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, changes: dict[str, DataFrame], label: str | None = None) -> int:
        """Adds the changed rows of all given tables at once; returns the manifest's number. A label that is known changes nothing."""
        base, manifest = self.current()
        if label is not None and label in manifest["labels"]:
            return base
        tables = {t: list(parts) for t, parts in manifest["tables"].items()}
        for table, rows in changes.items():
            if table not in self.keys:
                raise KeyError(table)
            # of a commit's own rows of one key one counts, as its columns are ordered last
            order = [F.col(f"`{c}`").desc_nulls_last() for c in rows.columns if c not in self.keys[table]] or [F.lit(1)]
            one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*self.keys[table]).orderBy(*order))).filter("_n = 1").drop("_n")
            tables.setdefault(table, []).append({"folder": self._write(table, one), "version": base + 1})
        labels = [*manifest["labels"], *([label] if label is not None else [])][-LABELS:]
        return self._publish(base, {"tables": tables, "labels": labels})

    def read(self, table: str, number: int | None = None) -> DataFrame | None:
        """The newest row of each key, as of a manifest; None before the table's first commit."""
        manifest = self.current()[1] if number is None else self._load(number)
        parts = (manifest or {"tables": {}})["tables"].get(table)
        if not parts:
            return None
        out = None
        for p in parts:
            own = self.spark.read.parquet(f"{self.path}/{p['folder']}").withColumn("_version", F.lit(p["version"]))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        if len(parts) == 1:
            return out.drop("_version")
        newest = Window.partitionBy(*self.keys[table]).orderBy(F.col("_version").desc())
        return out.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_version")

    def compact(self, *tables: str) -> int:
        """Writes the tables' newest rows into one folder each; readers of older manifests go on undisturbed."""
        base, manifest = self.current()
        new = dict(manifest["tables"])
        for table in tables or tuple(new):
            if len(new.get(table, ())) > 1:
                new[table] = [{"folder": self._write(table, self.read(table)), "version": base + 1}]
        return self._publish(base, manifest | {"tables": new}) if new != manifest["tables"] else base

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders and manifests that none of the last ``keep`` manifests needs; returns how many folders went.

        Not for a moment at which another writer is at work: its folders are in no manifest yet.
        """
        numbers = self._numbers()
        whole = [n for n in numbers if self._load(n) is not None][-keep:]
        used = {p["folder"] for n in whole for parts in self._load(n)["tables"].values() for p in parts}
        gone = 0
        for table in self.keys:
            folder = self._path(f"{self.path}/{table}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                if f"{table}/{s.getPath().getName()}" not in used:
                    gone += bool(self._fs.delete(s.getPath(), True))
        for n in numbers:
            if whole and n < whole[0]:
                self._fs.delete(self._path(f"{self.path}/manifests/{n:012d}.json"), False)
        return gone
