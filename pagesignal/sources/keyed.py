"""Keyed tables as logs: batches append, reads merge by key, and the base is written anew when the appended outgrow it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """``delta=<batch>`` holds what a batch brought, ``base=<batch>`` all keys as they were once that batch was in.

    A batch writes its own rows only, so what it costs grows with the batch and not with the table. A reader takes the newest whole
    base and the deltas after it, and ``merged`` makes one row of each key's rows. When the deltas outgrow ``growth`` times the base, the batch
    writes a new base after its delta; as the base at least doubles between two of these, a row is rewritten a few times in all, however many
    batches come. A base lies in buckets by a hash of the key, twice as many whenever they pass ``bucket_bytes``, so reads for known
    keys open few files and no file grows without bound.

    ``merged`` must give the same whatever the order and split of the rows, and for rows that come twice: then a batch that is run again, even after
    its base, changes nothing. What a base replaces is deleted when a later batch begins, so readers that began before go on.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], merged: Callable[[DataFrame], DataFrame], *, growth: float = 1.0, bucket_bytes: int = 128 << 20) -> None:
        self.spark, self.path, self.key, self.merged = spark, path.rstrip("/"), list(key), merged
        self.growth, self.bucket_bytes = growth, bucket_bytes

    def _fs(self) -> tuple[Any, Any]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self) -> tuple[dict[int, str], dict[int, str]]:
        """The whole bases and deltas by their batch."""
        path, fs = self._fs()
        found: dict[str, dict[int, str]] = {"base": {}, "delta": {}}
        if fs.exists(path(self.path)):
            for status in fs.listStatus(path(self.path)):
                at = status.getPath()
                kind, _, batch = at.getName().partition("=")
                if kind in found and fs.exists(path(at, "_SUCCESS")):
                    found[kind][int(batch)] = at.toString()
        return found["base"], found["delta"]

    def size(self, folder: str) -> int:
        path, fs = self._fs()
        return fs.getContentSummary(path(folder)).getLength()

    def live(self) -> tuple[int | None, list[int]]:
        """The newest base and the deltas after it."""
        bases, deltas = self.parts()
        newest = max(bases, default=None)
        return newest, sorted(b for b in deltas if newest is None or b > newest)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int")

    def _rows(self, wanted: DataFrame | None = None) -> DataFrame | None:
        bases, deltas = self.parts()
        newest, after = self.live()
        found = []
        if newest is not None:
            base = self.spark.read.parquet(bases[newest])
            if wanted is not None:
                n = base.agg(F.max("__buckets")).first()[0]
                # There are no more buckets than the base has files.
                base = base.where(F.col("__bucket").isin([r[0] for r in wanted.select(self._bucket(n)).distinct().collect()]))
            found.append(base.drop("__bucket", "__buckets"))
        if after:
            found.append(self.spark.read.parquet(*[deltas[b] for b in after]))
        rows = None
        for part in found:
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def read(self, wanted: DataFrame | None = None) -> DataFrame | None:
        """One row for each key, or for those of ``wanted(key)``, from the buckets that hold them; None before the first batch."""
        rows = self._rows(wanted)
        if rows is None:
            return None
        if wanted is not None:
            same = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in self.key]
            rows = rows.alias("r").join(wanted.select(*self.key).distinct().alias("w"), same, "left_semi")
        return self.merged(rows)

    def append(self, rows: DataFrame, batch: int) -> int:
        """Take in a batch; returns the bytes that it wrote. Batches are numbered upwards; one that is run again replaces what it wrote."""
        path, fs = self._fs()
        bases, deltas = self.parts()
        kept = max((b for b in bases if b < batch), default=None)
        for held, gone in ((bases, lambda b: b < kept), (deltas, lambda b: b <= kept)):
            for b, folder in held.items() if kept is not None else ():
                if gone(b):
                    fs.delete(path(folder), True)
        folder = f"{self.path}/delta={batch}"
        self.merged(rows).write.mode("overwrite").parquet(folder)
        return self.size(folder) + self._compact(batch)

    def _compact(self, batch: int) -> int:
        bases, deltas = self.parts()
        newest, after = self.live()
        base = 0 if newest is None else self.size(bases[newest])
        total = sum(self.size(deltas[b]) for b in after)
        if newest is None and len(after) < 2 or total <= self.growth * base:
            return 0
        n = 1
        while n * self.bucket_bytes < base + total:
            n *= 2
        folder = f"{self.path}/base={batch}"
        whole = self.merged(self._rows()).withColumn("__bucket", self._bucket(n)).withColumn("__buckets", F.lit(n))
        whole.repartition(n, "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(folder)
        return self.size(folder)
