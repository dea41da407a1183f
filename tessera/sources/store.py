"""Named tables in a folder: documents, vectors and whatever else, as Parquet snapshots.

A write makes a new snapshot and then moves the pointer file to it, so that a reader has either the
old table or the new one. Old snapshots stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.ranks import ranked
from tessera.sources import ingest


class Store:
    """Tables by name below one folder, which may be in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _current(self, name: str) -> str:
        pointer = f"{self.root}/{name}/_current"
        if not self._exists(pointer):
            raise KeyError(f"no table {name}")
        fs, at = self._fs(pointer)
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["snapshot"]
        finally:
            stream.close()

    def _point(self, name: str, snapshot: str) -> None:
        jvm = self.spark.sparkContext._jvm
        fs, at = self._fs(f"{self.root}/{name}/_current")
        _, new = self._fs(f"{self.root}/{name}/_next_{snapshot}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"snapshot": snapshot}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(new), context.makeQualified(at), options)

    def tables(self) -> list[str]:
        fs, at = self._fs(self.root)
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and self._exists(f"{s.getPath()}/_current"))

    def create(self, name: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> None:
        if self._exists(f"{self.root}/{name}/_current"):
            raise ValueError(f"table {name} exists")
        self.replace(name, rows, partition_by)

    def replace(self, name: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> None:
        snapshot = uuid.uuid4().hex
        writer = rows.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/{snapshot}")
        self._point(name, snapshot)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{self._current(name)}")

    def drop(self, name: str) -> None:
        self._current(name)
        fs, at = self._fs(f"{self.root}/{name}")
        fs.delete(at, True)

    def vacuum(self, name: str) -> int:
        """Delete all snapshots but the current one; gives their number."""
        now, n = self._current(name), 0
        fs, at = self._fs(f"{self.root}/{name}")
        for s in fs.listStatus(at):
            if s.isDirectory() and s.getPath().getName() != now:
                n += bool(fs.delete(s.getPath(), True))
        return n

    def upsert(self, name: str, rows: DataFrame, key: str = "id") -> None:
        """Rows replace those with the same key; of new rows with one key, any one counts."""
        now = self.read(name)
        if "vec" in now.columns and "vec" in rows.columns:
            same_dimension(now, rows)
        self.replace(name, upserted(now, rows, key))

    def update(self, name: str, rows: DataFrame, key: str = "id") -> None:
        """As ``upsert``, but every key must be there already."""
        new = rows.join(self.read(name).select(key), key, "left_anti").limit(1).count()
        if new:
            raise KeyError(f"{name} lacks a row to update")
        self.upsert(name, rows, key)

    def delete(self, name: str, keys: DataFrame, key: str = "id") -> None:
        self.replace(name, without(self.read(name), keys, key))

    def get(self, name: str, keys: Sequence | DataFrame, key: str = "id") -> DataFrame:
        """The rows with any of ``keys``: a few values, or a table with the key column."""
        if isinstance(keys, DataFrame):
            return self.read(name).join(keys.select(key).distinct(), key, "left_semi")
        return self.read(name).where(F.col(key).isin(list(keys)))

    def counts(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in self.tables()}

    def backup(self, name: str, folder: str) -> None:
        self.read(name).write.parquet(f"{folder}/{name}")

    def backups(self, folder: str) -> DataFrame:
        """``name`` and ``rows`` of the backups in a folder, by name."""
        fs, at = self._fs(folder)
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []
        out = self.spark.createDataFrame([], "name string, rows long")
        for n in names:
            out = out.unionByName(self.spark.read.parquet(f"{folder}/{n}").agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows"))
        return out

    def restore(self, name: str, folder: str, saved_as: str | None = None) -> None:
        self.replace(name, self.spark.read.parquet(f"{folder}/{saved_as or name}"))

    def import_increment(self, name: str, rows: DataFrame, key: str, time_col: str) -> int:
        """Add rows newer than the table's newest; the mark is the newest time that the table holds."""
        if name not in self.tables():
            self.create(name, rows)
            return self.read(name).count()
        mark = self.read(name).agg(F.max(time_col)).first()[0]
        new = ingest.changed_since(rows, time_col, mark)
        n = new.count()
        if n:
            self.upsert(name, new, key)
        return n


def same_dimension(now: DataFrame, rows: DataFrame, vec: str = "vec") -> None:
    """Raise if any new vector is of another length than those there."""
    first = now.select(F.size(vec)).first()
    if first and rows.where(F.size(vec) != first[0]).limit(1).count():
        raise ValueError(f"vectors need {first[0]} components")


def upserted(now: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return without(now, rows, key).unionByName(rows.dropDuplicates([key]))


def without(now: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return now.join(keys.select(key).distinct(), key, "left_anti")


def with_score_ids(rows: DataFrame, key: str, after: int = 0) -> DataFrame:
    """``rows`` with ``score_id``: gapless from ``after + 1`` in the order of the key."""
    return ranked(rows, [], [key], "_place").withColumn("score_id", F.col("_place") + after).drop("_place")


def encrypted(value: Column, key: Column) -> Column:
    """AES in GCM mode; a null stays null."""
    return F.aes_encrypt(value, key, F.lit("GCM"))


def decrypted(value: Column, key: Column) -> Column:
    return F.aes_decrypt(value, key, F.lit("GCM"))


def page(rows: DataFrame, number: int, size: int, order: Sequence[str]) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows."""
    return rows.orderBy(*order).offset(number * size).limit(size)
