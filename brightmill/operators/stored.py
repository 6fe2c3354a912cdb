"""Stored tables that are changed in whole steps.

A store is a folder with data files, which never change, and numbered manifests. A manifest names, for each table, the
folders that make up each of its partitions. A write stages new files aside, and then one rename makes its manifest the
newest: readers see all of it or nothing, over all tables of the store. A write that fails before that leaves the last version
as it was; a write with a number that its writer has committed already changes nothing, so retries and restarts are safe.
Only partitions that a write touches are written anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brightmill.operators.merge import upsert

PART = "store_part"


class Conflict(RuntimeError):
    """Another writer has committed this version first."""


class Store:
    """Tables in `folder`; `layout` has the partition of a row for each table (a column of few values: a day, a bucket)."""

    def __init__(self, spark: SparkSession, folder: str, layout: dict[str, Column]):
        self.spark, self.folder, self.layout = spark, folder.rstrip("/"), layout
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def manifest(self, version: int | None = None) -> dict:
        """The newest version, or an older one: its number, each writer's last number, and of each table the schema and partitions."""
        if version is None:
            version = max((int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json")), default=0)
        if not version:
            return {"version": 0, "writers": {}, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/v{version:012d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        """The manifest is written aside and renamed, which fails where that version is there already."""
        aside = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no overwriting
        try:
            context.rename(aside, self._path(f"manifests/v{manifest['version']:012d}.json"), keep)
        except Exception as error:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {manifest['version']} of {self.folder}") from error
            raise

    def _stage(self, table: str, rows: DataFrame, writer: str, sequence: int) -> dict[str, list[str]]:
        """Writes rows aside; their folders by partition. Large partitions are split over tasks."""
        where = f"data/{writer}-{sequence}-{uuid.uuid4().hex[:8]}/{table}"
        rows.withColumn(PART, self.layout[table].cast("string")).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.folder}/{where}")
        return {n.removeprefix(f"{PART}="): [f"{where}/{n}"] for n in self._names(where) if n.startswith(f"{PART}=")}

    def commit(self, writer: str, sequence: int, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, drop: dict[str, Iterable[str]] | None = None, base: dict | None = None) -> bool:
        """One step over all tables: `drop` takes partitions out, `replace` gives every partition that it has rows of (and that
        `drop` names) new contents, `append` adds rows. False, with nothing changed, where the writer has committed that number. What was made from the rows of
        a version is committed on that version (`base`), or not at all if there is a newer one (Conflict)."""
        old = base or self.manifest()
        if old["writers"].get(writer, -1) >= sequence:
            return False
        tables = {t: {"schema": x["schema"], "parts": dict(x["parts"])} for t, x in old["tables"].items()}
        for table, names in (drop or {}).items():
            for name in names:
                tables.get(table, {"parts": {}})["parts"].pop(name, None)
        for rows_of, adding in ((replace or {}, False), (append or {}, True)):
            for table, rows in rows_of.items():
                own = tables.setdefault(table, {"schema": rows.schema.json(), "parts": {}})
                if StructType.fromJson(json.loads(own["schema"])).simpleString() != rows.schema.simpleString():
                    raise ValueError(f"{table}: {rows.schema.simpleString()} isn't the stored schema")
                for name, paths in self._stage(table, rows, writer, sequence).items():
                    own["parts"][name] = own["parts"].get(name, []) + paths if adding else paths
        self._publish({"version": old["version"] + 1, "writers": old["writers"] | {writer: sequence}, "tables": tables})
        return True

    def parts(self, table: str) -> list[str]:
        return sorted(self.manifest()["tables"].get(table, {"parts": {}})["parts"])

    def read(self, table: str, parts: Iterable[str] | None = None, base: dict | None = None) -> DataFrame:
        """The table's rows in the newest version (or `base`), or those of some partitions, of which alone files are opened."""
        own = (base or self.manifest())["tables"][table]
        wanted = own["parts"] if parts is None else {p: own["parts"][p] for p in parts if p in own["parts"]}
        paths = [f"{self.folder}/{x}" for p in sorted(wanted) for x in wanted[p]]
        schema = StructType.fromJson(json.loads(own["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def added(self, table: str, since: dict, base: dict | None = None) -> DataFrame:
        """The rows of files that the newest version (or `base`) has and `since` had not: what was appended or written anew."""
        own = (base or self.manifest())["tables"][table]
        old = since["tables"].get(table, {"parts": {}})["parts"]
        parts = {p: [x for x in paths if x not in old.get(p, [])] for p, paths in own["parts"].items()}
        return self.read(table, base={"tables": {table: own | {"parts": parts}}})

    def touched(self, table: str, rows: DataFrame) -> list[str]:
        """The partitions that rows fall into: at most as many as the layout has."""
        return [r[0] for r in rows.select(self.layout[table].cast("string").alias(PART)).distinct().collect()]

    def rewrite(self, writer: str, sequence: int, table: str, parts: list[str], change: Callable[[DataFrame], DataFrame]) -> bool:
        """Commits `change` of the rows of some partitions, which must leave rows where they are. Partitions without rows go."""
        base = self.manifest()
        return self.commit(writer, sequence, replace={table: change(self.read(table, parts, base))}, drop={table: parts}, base=base)

    def upsert(self, writer: str, sequence: int, table: str, rows: DataFrame, keys: list[str], always: list[str], on_insert: list[str]) -> bool:
        """Upsert by keys, which the layout must be made of."""
        return self.rewrite(writer, sequence, table, self.touched(table, rows), lambda old: upsert(old, rows, keys, always, on_insert).drop("change").select(old.columns))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last `keep` manifests, and data that none of these names; the number of folders deleted. Not to be
        run while a write is staged or an older version is read."""
        versions = sorted(n for n in self._names("manifests") if n.endswith(".json"))
        kept = [json.loads(self.spark.read.text(f"{self.folder}/manifests/{n}", wholetext=True).first()[0]) for n in versions[-keep:]]
        named = {p.split("/")[1] for m in kept for t in m["tables"].values() for paths in t["parts"].values() for p in paths}
        gone = [f"manifests/{n}" for n in versions[:-keep]] + [f"data/{n}" for n in self._names("data") if n not in named]
        for name in gone:
            self._fs.delete(self._path(name), True)
        return len(gone)


def bucket(*columns: str, buckets: int = 16) -> Column:
    """A layout by a hash of columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets))


def day(column: str) -> Column:
    """A layout by day."""
    return F.date_format(column, "yyyy-MM-dd")


def expire(store: Store, writer: str, sequence: int, table: str, first_kept: str, partial: Column | None = None) -> bool:
    """Retention of a table laid out by day: partitions before `first_kept` are dropped from the manifest, no row is read. With
    `partial`, only the rows for which it holds expire, and only those partitions are rewritten."""
    old = [p for p in store.parts(table) if p < first_kept]
    if partial is None:
        return store.commit(writer, sequence, drop={table: old})
    return store.rewrite(writer, sequence, table, old, lambda df: df.where(~F.coalesce(partial, F.lit(False))))
