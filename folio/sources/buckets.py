"""Tables that are changed bucket by bucket: appends add files, deletes and upserts rewrite the buckets that they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Heads = set[tuple[int, int]]


class Buckets:
    """A table of ``schema`` in folders by version and bucket of the hash of its ``keys``.

    Change number v writes ``rows/version=v`` and then ``heads/version=v``, which names the folders (bucket, version) that make up the
    table; it has some rows a bucket, the only thing that the driver holds. A change that is repeated, as by a restarted stream, starts
    from the heads before it and gives the same. Folders that neither the new heads nor those before name are removed; readers of the
    last version are safe.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def heads(self, version: int) -> Heads:
        """The folders of the table as of a version; none before the first."""
        if version < 0 or not self._there(f"{self.path}/heads/version={version}/_SUCCESS"):
            return set()
        return {tuple(r) for r in self.spark.read.schema("bucket int, head int").parquet(f"{self.path}/heads/version={version}").collect()}

    def read(self, version: int, keys: DataFrame | None = None) -> DataFrame:
        """All rows as of a version, or those of ``keys``, for which only their buckets are read."""
        heads = self.heads(version)
        if keys is None:
            return self._rows(heads)
        asked = self._touched(keys)
        return self._rows({h for h in heads if h[0] in asked}).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def append(self, rows: DataFrame, version: int) -> None:
        """Adds rows; nothing is read or rewritten."""
        self._commit(version, self.heads(version - 1) | {(b, version) for b in self._write(rows, version)})

    def change(self, rows: DataFrame, version: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Puts ``merge(old rows, rows)`` in place of the buckets that ``rows`` (with the keys) fall into."""
        heads, touched = self.heads(version - 1), self._touched(rows)
        written = self._write(merge(self._rows({h for h in heads if h[0] in touched}), rows), version) if touched else set()
        self._commit(version, {h for h in heads if h[0] not in touched} | {(b, version) for b in written})

    def delete(self, keys: DataFrame, version: int) -> None:
        """Removes the rows of ``keys``."""
        self.change(keys, version, lambda old, gone: old.join(gone.select(*self.keys).distinct(), self.keys, "left_anti"))

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def _rows(self, heads: Heads) -> DataFrame:
        if not heads:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(heads)]
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _write(self, rows: DataFrame, version: int) -> set[int]:
        """The buckets that got rows. Adaptive execution splits large buckets over several tasks and files."""
        path = f"{self.path}/rows/version={version}"
        made = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        made.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return {r[0] for r in self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).select("bucket").distinct().collect()}

    def _commit(self, version: int, heads: Heads) -> None:
        self.spark.createDataFrame(sorted(heads), "bucket int, head int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/heads/version={version}")
        before, kept = self.heads(version - 2), heads | self.heads(version - 1)
        for b, v in before - kept:
            self._remove(f"{self.path}/rows/version={v}/bucket={b}")
        self._remove(f"{self.path}/heads/version={version - 2}")

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _there(self, path: str) -> bool:
        files, p = self._folder(path)
        return files.exists(p)

    def _remove(self, path: str) -> None:
        files, p = self._folder(path)
        files.delete(p, True)
