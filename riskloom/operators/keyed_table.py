"""A stored table in hash buckets of its key, where an upsert or delete rewrites the buckets it touches and no others.

A change joins its keys with the rows of the touched buckets only and writes these buckets anew, into a folder of its own. One
small file of the log, written last, then says for each of them which change holds its rows. Until it is there, readers see
the table as before; what an attempt that failed has left is never read. One writer at a time.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

#: Rows of a bucket, about: what a change of one key costs to rewrite.
BUCKET_ROWS = 1_000_000
_LOG = "version int, buckets int, bucket int, change string"  # change: null for a bucket without rows


class KeyedTable:
    """The table below ``path``; ``schema`` is its DDL and ``key`` the column its rows are told apart by, which is never null."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id") -> None:
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.refresh()

    def refresh(self) -> None:
        """Takes notice of changes that others have made."""
        try:
            found = (self.spark.read.schema(_LOG).json(os.path.join(self.path, "log")).groupBy("bucket", "buckets")
                     .agg(F.max("version").alias("version"), F.max_by("change", "version").alias("change")).collect())  # one row a bucket
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            found = []
        self.version = max((r.version for r in found), default=-1)
        self.buckets = found[0].buckets if found else None
        self._current = {r.bucket: r.change for r in found if r.change}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _folder(self, change: str) -> str:
        return os.path.join(self.path, "rows", f"change={change}")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows in force, of all buckets or of some."""
        chosen = [b for b in (self._current if buckets is None else buckets) if b in self._current]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(
            *[os.path.join(self._folder(self._current[b]), f"_bucket={b}") for b in chosen])

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys, from the buckets of these keys."""
        wanted = keys.select(self.key).distinct()
        return self.rows(self._touched(wanted)).join(wanted, self.key, "left_semi")

    def _touched(self, keys: DataFrame) -> list[int]:
        if self.buckets is None:
            return []
        return sorted(r[0] for r in keys.filter(F.col(self.key).isNotNull()).select(self._bucket()).distinct().collect())  # at most one row a bucket

    # --- changes --------------------------------------------------------------------------

    def upsert(self, new: DataFrame, order: Column | None = None) -> list[int]:
        """Rows of ``new`` take the place of those with their key; returns the buckets that were rewritten.

        Of rows with equal keys the one of greatest ``order`` counts, of equals the one whose JSON text is greatest. A null key is an error.
        """
        columns = self.spark.createDataFrame([], self.schema).columns
        new = new.select(*columns).withColumn(self.key, F.when(F.col(self.key).isNull(), F.raise_error("A row has no key")).otherwise(F.col(self.key)))
        row, rank = F.struct(*columns), F.lit(0) if order is None else order
        best = F.max_by(row, F.struct(rank.alias("rank"), F.to_json(row).alias("text")))
        new = cut_lineage(new.groupBy(F.col(self.key).alias("_key")).agg(best.alias("_row")).select("_row.*"))
        if self.buckets is None:
            if not (count := new.count()):
                return []
            self.buckets = -(-count // BUCKET_ROWS)
        touched = self._touched(new)
        kept = self.rows(touched).join(new.select(self.key), self.key, "left_anti").select(*columns)
        return self._replace(touched, kept.unionByName(new))

    def update(self, changes: DataFrame) -> list[int]:
        """Non-null columns of ``changes`` (one row a key) are set on the rows that are there; unknown keys are left out."""
        changed = [c for c in changes.columns if c != self.key]
        new = cut_lineage(changes.groupBy(self.key).agg(*[F.max(c).alias(f"_new_{c}") for c in changed]))
        touched = [b for b in self._touched(new) if b in self._current]
        columns = self.spark.createDataFrame([], self.schema).columns
        merged = self.rows(touched).join(new, self.key, "left").select(*[
            F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in columns])
        return self._replace(touched, merged)

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows of these keys go; returns the buckets that were rewritten."""
        gone = cut_lineage(keys.select(self.key).distinct())
        touched = [b for b in self._touched(gone) if b in self._current]
        return self._replace(touched, self.rows(touched).join(gone, self.key, "left_anti"))

    def _replace(self, touched: list[int], rows: DataFrame) -> list[int]:
        if not touched:
            return touched
        version, change = self.version + 1, uuid.uuid4().hex
        dealt = rows.withColumn("_bucket", self._bucket()).repartition(min(len(touched), self._width()), "_bucket")
        dealt.sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(self._folder(change))
        written = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(self._folder(change)).select("_bucket").distinct()
        kept = {r[0] for r in written.collect()}  # at most the touched buckets
        log = self.spark.createDataFrame([(version, self.buckets, b, change if b in kept else None) for b in touched], _LOG)
        log.coalesce(1).write.json(os.path.join(self.path, "log", f"entry={change}"))
        self.version = version
        self._current = {b: c for b, c in self._current.items() if b not in touched} | dict.fromkeys(kept, change)
        return touched

    def _width(self) -> int:
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
