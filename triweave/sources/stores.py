"""Keyed stores on plain files: a version is a manifest of the live folder of each bucket, written last.

Rows lie in buckets by the hash of their key. A change reads and rewrites the buckets that it meets and no others, so
the files read for a batch do not grow with the store. What it wrote counts once the next manifest is there, which is
created exclusively: a job killed before leaves the last version whole, and a second writer of one version fails.
Readers pin a version and are not disturbed by later ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triweave.operators import snapshots, survivorship
from triweave.plans import uploads
from triweave.storage import files, names, read_text, write_new

BUCKETS = 64  # of a new store; ``rebucket`` follows its growth
ROWS_PER_FILE = 5_000_000


class Conflict(RuntimeError):
    """Another writer changed the store since this change began."""


class KeyedStore:
    """Rows of one schema, one for each key after every ``merge`` whose ``combine`` keeps it so."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self._buckets = spark, path.rstrip("/"), keys, buckets

    def _versions(self) -> list[int]:
        return [int(x) for x in names(self.spark, f"{self.path}/manifests") if x.isdigit()]

    def manifest(self, version: int | None = None) -> dict | None:
        """Of a version, or of the newest whole one; a manifest that was not written to its end does not count."""
        for v in sorted(self._versions(), reverse=True) if version is None else [version]:
            try:
                return json.loads(read_text(self.spark, f"{self.path}/manifests/{v:012}")) | {"version": v}
            except ValueError:
                continue
        return None

    def bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int")

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None, schema: T.StructType | None = None) -> DataFrame:
        """Rows of a version, of some buckets or of all; ``schema`` is that of a store that is still empty."""
        m = self.manifest(version)
        if m is None and schema is None:
            raise ValueError(f"{self.path} has no version yet")
        kind = T.StructType.fromJson(m["schema"]) if m else schema
        live = [f"{self.path}/{p}" for b, p in m["live"].items() if buckets is None or int(b) in set(buckets)] if m else []
        return self.spark.read.schema(kind).parquet(*live) if live else self.spark.createDataFrame([], kind)

    def met(self, rows: DataFrame) -> list[int]:
        """Buckets that some keys lie in: at most as many as the store has."""
        count = (self.manifest() or {"buckets": self._buckets})["buckets"]
        return [r.b for r in rows.select(self.bucket(count).alias("b")).distinct().collect()]

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        """Replace the buckets that ``changes`` meet by ``combine(stored rows of them, changes)``; the new version.

        ``changes`` hold the keys and whatever ``combine`` reads. ``batch``: a stream's name and the number of its batch;
        one that the store has already is left out.
        """
        before = set(self._versions())
        m = self.manifest() or {"version": 0, "buckets": self._buckets, "live": {}, "schema": None, "batches": {}}
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return m["version"]
        some = self.met(changes)
        kind = T.StructType.fromJson(m["schema"]) if m["schema"] else None
        stored = self.read(m["version"], some) if kind else None
        out = combine(stored, changes) if stored is not None else combine(self.spark.createDataFrame([], changes.schema), changes)
        live = {b: p for b, p in m["live"].items() if int(b) not in some} | self._write(out, m["buckets"])
        batches = m["batches"] | ({batch[0]: batch[1]} if batch else {})
        return self._commit(before, m | {"live": live, "schema": (kind or out.schema).jsonValue(), "batches": batches})

    def rebucket(self, count: int) -> int:
        """The same rows in another number of buckets."""
        before, m = set(self._versions()), self.manifest()
        return self._commit(before, m | {"live": self._write(self.read(m["version"]), count), "buckets": count})

    def _write(self, rows: DataFrame, count: int) -> dict[str, str]:
        place = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self.bucket(count)).repartition("_bucket").sortWithinPartitions("_bucket", *self.keys)
        dealt.write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("_bucket").parquet(f"{self.path}/{place}")
        return {x.split("=")[1]: f"{place}/{x}" for x in names(self.spark, f"{self.path}/{place}") if x.startswith("_bucket=")}

    def _commit(self, before: set[int], m: dict) -> int:
        now = set(self._versions())
        if now != before:
            raise Conflict(f"{self.path} was changed meanwhile")
        version = max(before, default=0) + 1
        text = json.dumps({k: v for k, v in m.items() if k != "version"})
        if not write_new(self.spark, f"{self.path}/manifests/{version:012}", text):
            raise Conflict(f"version {version} of {self.path} is another writer's")
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` versions uses, and older manifests; readers of those lose them. Number of folders."""
        last = sorted(self._versions())[-keep:]
        used = {p.split("/")[1] for v in last for p in (self.manifest(v) or {"live": {}})["live"].values()}
        gone = [x for x in names(self.spark, f"{self.path}/data") if x not in used]
        for path in [f"data/{x}" for x in gone] + [f"manifests/{v:012}" for v in self._versions() if v not in last]:
            fs, place = files(self.spark, f"{self.path}/{path}")
            fs.delete(place, True)
        return len(gone)


def upsert_invoices(store: KeyedStore, new: DataFrame, now) -> int:
    """Records into a store by (source, content_hash), all of a batch or none: fields replaced, ``created_at`` kept."""
    stamp = F.lit(now).cast("timestamp")
    blank = new.select("*", stamp.alias("created_at"), stamp.alias("updated_at")).where("false")
    return store.merge(new, lambda stored, some: snapshots.upsert(stored if "created_at" in stored.columns else blank, some, now))


def put_outcomes(store: KeyedStore, plan: DataFrame, outcomes: DataFrame) -> int:
    """Upload ledger by file after a run; what was not sent leaves no entry."""
    fresh = uploads.apply_outcomes(outcomes.select("file_sha256", F.lit("").alias("state"), F.lit(0).alias("period_year"), F.lit(0).alias("period_month")).where("false"), plan, outcomes)
    return store.merge(fresh, lambda stored, some: stored.join(some.select("file_sha256"), "file_sha256", "left_anti").unionByName(some))


def save_overrides(store: KeyedStore, new: DataFrame) -> int:
    """Overrides by record: fields merge, the newer one wins, an override without fields is deleted."""
    return store.merge(new.select("content_hash", "override"), survivorship.merge_overrides)
