"""Stored tables that change by whole versions: a manifest names the folders of every bucket, and a commit is one new manifest.

Rows lie in buckets by the hash of a table's key. A commit writes the buckets that it
touches to a new folder and then a manifest; readers see the last whole manifest, so a
writer that is killed leaves the table as it was. A manifest may also hold the last batch
that each source has committed, so a batch that is given again is skipped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.tables import upsert

#: Buckets of a new table. A commit lists at most so many to the driver.
BUCKETS = 16
END = "end"


class Conflict(RuntimeError):
    """Another writer has committed since this one read the manifest."""


class VersionedTables:
    """Tables below one path that are committed together."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._fs = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _manifests(self) -> list[str]:
        folder = self._place(f"{self.path}/manifest")
        return sorted((f.getPath().getName() for f in self._fs.listStatus(folder)), reverse=True) if self._fs.exists(folder) else []

    def _read(self, name: str) -> dict | None:
        """A manifest, or None if it wasn't written to its end."""
        stream = self._fs.open(self._place(f"{self.path}/manifest/{name}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if found.get(END) else None

    def manifest(self, version: int | None = None) -> dict:
        """The newest whole manifest, or that of a version; an empty one for no tables."""
        for name in self._manifests():
            if version is None or int(name.split(".")[0]) == version:
                found = self._read(name)
                if found is not None:
                    return found
        return {"version": 0, "tables": {}, "batches": {}}

    def read(self, name: str, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The table as of a version, or the newest one; None where there is no such table."""
        return self._table(self.manifest(version), name, only)

    def _table(self, manifest: dict, name: str, only: list[int] | None = None) -> DataFrame | None:
        held = manifest["tables"].get(name)
        if held is None:
            return None
        folders = [f"{self.path}/{f}" for bucket, parts in sorted(held["buckets"].items()) if only is None or int(bucket) in only for f in parts]
        reader = self.spark.read.schema(held["schema"])
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], held["schema"])

    def committed(self, source: str) -> int:
        """The last batch that a source has committed, -1 before the first."""
        return self.manifest()["batches"].get(source, -1)

    def _bucket(self, key: list[str]):
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, key: list[str]) -> dict[str, list[str]]:
        """Folders of each bucket of df, newly written; small files are put together, large buckets split."""
        folder = f"data/{uuid.uuid4().hex}"
        out = df.withColumn("_bucket", self._bucket(key)).hint("rebalance", "_bucket")
        out.write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._place(f"{self.path}/{folder}"))]
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in names if n.startswith("_bucket=")}

    def commit(self, changes: list[tuple[str, str, DataFrame, list[str]]], source: str | None = None, batch: int | None = None) -> dict[str, dict[str, int]]:
        """Makes changes (table, how, rows, key) all at once and counts the rows that each created, updated and removed.

        How is `append`; `upsert`, rows of a known key take the old ones' place; `users`,
        all old rows of a key that occurs in the rows are replaced; `replace`, all rows
        are. Only touched buckets are rewritten. With a source, a batch up to its last
        committed one changes nothing. Raises Conflict if another commit came between.
        """
        before = self.manifest()
        if source is not None and batch is not None and batch <= before["batches"].get(source, -1):
            return {}
        after = {"version": before["version"] + 1, "tables": dict(before["tables"]), "batches": dict(before["batches"])}
        counts = {}
        for name, how, df, key in changes:
            held = after["tables"].get(name, {"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "buckets": {}})
            buckets = dict(held["buckets"])
            df = df.select(*self.spark.createDataFrame([], held["schema"]).columns)
            old_rows = updated = 0
            if how in ("upsert", "users") and buckets:
                touched = [r[0] for r in df.select(self._bucket(key).alias("b")).distinct().collect()]  # BUCKETS at most
                old = self._table(after, name, touched)
                old_rows = old.count()
                known = df.select(*key).distinct()
                updated = old.join(known, key, "left_semi").count()
                df = upsert(old, df, key).select(df.columns) if how == "upsert" else old.join(known, key, "left_anti").select(df.columns).unionByName(df)
                for b in touched:
                    buckets.pop(str(b), None)
            elif how == "replace":
                buckets = {}
            written = self._write(df, key)
            for b, folders in written.items():
                buckets[b] = buckets.get(b, []) + folders if how == "append" else folders
            after["tables"][name] = {"schema": held["schema"], "buckets": buckets}
            rows = self.spark.read.schema(held["schema"]).parquet(*[f"{self.path}/{f}" for fs in written.values() for f in fs]).count() if written else 0
            removed = updated if how == "users" else 0
            counts[name] = {"created": rows - old_rows + removed, "updated": updated if how == "upsert" else 0, "removed": removed}
        if source is not None and batch is not None:
            after["batches"][source] = batch
        self._publish(after)
        return counts

    def _publish(self, manifest: dict) -> None:
        """Writes a manifest of the next version; a file that can't be created is another writer's."""
        names = self._manifests()
        newest = self.manifest()["version"]
        if newest != manifest["version"] - 1:
            raise Conflict(f"version {newest} was committed in between")
        number = max([manifest["version"], *(int(n.split(".")[0]) + 1 for n in names[:1])])
        manifest["version"] = number
        try:
            stream = self._fs.create(self._place(f"{self.path}/manifest/{number:012d}.json"), False)
        except Exception as error:
            raise Conflict(f"version {number} was committed in between") from error
        stream.write(bytearray(json.dumps(manifest | {END: True}).encode()))
        stream.close()

    def vacuum(self, keep: int = 2) -> None:
        """Deletes data folders that none of the newest `keep` whole manifests names, and all other manifests; no writer may run meanwhile."""
        names = self._manifests()
        whole = [n for n in names if self._read(n)][:keep]
        used = {f.split("/")[1] for n in whole for t in self._read(n)["tables"].values() for fs in t["buckets"].values() for f in fs}
        for name in set(names) - set(whole):
            self._fs.delete(self._place(f"{self.path}/manifest/{name}"), False)
        folder = self._place(f"{self.path}/data")
        for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if f.getPath().getName() not in used:
                self._fs.delete(f.getPath(), True)


def ledger_sink(tables: VersionedTables, name: str, key: list[str], source: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each micro-batch by key; a batch that was committed before is skipped, whatever the stream's own log knows.

    Of rows with one key in a batch one is kept, the last by all columns in their order. The
    sink's batches are numbered by the stream, so `source` belongs to one checkpoint.
    """

    def write(df: DataFrame, batch: int) -> None:
        rows = df.groupBy(*key).agg(F.max(F.struct(*df.columns)).alias("_row")).select("_row.*")
        tables.commit([(name, "upsert", rows, key)], source, batch)

    return write


def process_pending(tables: VersionedTables, raw: DataFrame, source: str | None = None, batch: int | None = None) -> dict[str, dict[str, int]]:
    """One resumed run: pings that aren't processed yet go through the stored states; points and states are committed together.

    A run that is repeated finds no pending pings and changes nothing.
    """
    from tracewell.operators.track import resume

    made, states = resume(raw, tables.read("processed"), tables.read("states"))
    if made.isEmpty():
        return {}
    return tables.commit([("processed", "append", made, ["user_id"]), ("states", "replace", states, ["user_id"])], source, batch)
