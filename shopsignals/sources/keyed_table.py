"""A table of the latest row per key, fed by micro-batches.

A batch is reduced to its latest row per key and written as one delta file per
key bucket. ``manifest/<version>.json`` names the files of a version, bucket by
bucket from the oldest to the newest; it is written whole and renamed, so that
a version is there completely or not at all, and names the last batch it holds,
so that a replayed batch changes nothing. Readers take the newest version and
merge its files: the latest row per key.

After each batch the newest files of a bucket are merged into one as far as the
next older one is not FACTOR times their size. Sizes so fall geometrically: a
bucket has at most about log2(table / batch) files, which hold at most twice the
bytes of its largest, and a row is rewritten at most about as many times. What a
batch costs follows its own size, not the table's.

Files that a version no longer names stay for KEEP versions, for readers that
have begun. Data folders are named by batch, so a failed attempt is written over
by the next one. One writer at a time: a second one fails at its rename.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, FACTOR, KEEP = 16, 2, 4


class _Files:
    """The few file operations of a manifest, on whatever store Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def sizes(self, folder: str) -> list[tuple[str, int]]:
        """(path below ``folder``, bytes) of all Parquet files under it."""
        p, out = self.path(folder), []
        if self.fs.exists(p):
            base = str(self.fs.makeQualified(p).toString()).rstrip("/") + "/"
            it = self.fs.listFiles(p, True)
            while it.hasNext():
                s = it.next()
                if s.getPath().getName().endswith(".parquet"):
                    out.append((s.getPath().toString().removeprefix(base), s.getLen()))
        return out

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> None:
        """Write ``name`` whole; an existing one is left alone and is an error."""
        tmp = self.path(f"{name}.tmp")
        stream = self.fs.create(tmp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self.path(name)) or not self.fs.rename(tmp, self.path(name)):
            raise RuntimeError(f"{name}: another writer has committed this version")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def to_merge(sizes: list[int], factor: int = FACTOR) -> int:
    """How many of the newest files (``sizes`` from the oldest) become one."""
    n, total = 1, sizes[-1] if sizes else 0
    while n < len(sizes) and sizes[-n - 1] < factor * total:
        n += 1
        total += sizes[-n]
    return n if n > 1 else 0


class KeyedTable:
    """The latest row per ``key`` by ``order`` (the largest wins) under ``path``.

    With ``ttl_seconds`` a row is gone that long after its ``time_col``: readers
    leave it out as of the newest row, or of a time they name, and merges drop it.
    The number of buckets is fixed by the first batch; columns may be added by
    later ones. Rows with a null in the key are left out.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str] | str | None = None, order: list[str] | None = None,
                 buckets: int = BUCKETS, ttl_seconds: int | None = None, time_col: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = _Files(spark, path)
        self.key, self.order, self.buckets = [key] if isinstance(key, str) else key, order, buckets
        self.ttl, self.time = ttl_seconds, time_col

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        vs = self.versions()
        if version is None and not vs:
            return None
        return json.loads(self.files.read(f"{self.path}/manifest/{vs[-1] if version is None else version:020d}.json"))

    @staticmethod
    def _bucket(key: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets)).cast("int")

    @staticmethod
    def _latest(df: DataFrame, m: dict) -> DataFrame:
        others = [c for c in df.columns if c not in m["key"]]
        rows = df.groupBy(*m["key"]).agg(F.max_by(F.struct(*others), F.struct(*m["order"])).alias("_r"))
        return rows.select(*[F.col(f"_r.{c}").alias(c) if c in others else F.col(c) for c in df.columns])

    def _alive(self, df: DataFrame, m: dict, as_of=None) -> DataFrame:
        until = F.unix_micros(F.lit(as_of).cast("timestamp")) if as_of is not None else F.lit(m["newest"])
        if m["ttl"] is None or (as_of is None and m["newest"] is None):
            return df
        return df.where(F.coalesce(F.unix_micros(F.col(m["time"]).cast("timestamp")) + m["ttl"] * 1_000_000 > until, F.lit(True)))

    def _write(self, df: DataFrame, m: dict, folder: str) -> dict[int, list]:
        """``df`` as one file per bucket under ``folder``: bucket -> [[name, bytes]]."""
        at = f"{self.path}/{folder}"
        b = self._bucket(m["key"], m["buckets"])
        df.withColumn("_bucket", b).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(at)
        out: dict[int, list] = {}
        for name, size in self.files.sizes(at):
            out.setdefault(int(name.split("/")[0].removeprefix("_bucket=")), []).append([f"{folder}/{name}", size])
        return out

    def _scan(self, m: dict, names: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _next(self, batch: DataFrame, batch_id: int) -> dict | None:
        """The manifest to fill for this batch; None where it is in already."""
        m = self.manifest()
        fields = T.StructType([T.StructField(f.name, f.dataType) for f in batch.schema])
        if m is None:
            return {"version": 0, "batch_id": batch_id, "key": self.key, "order": self.order, "buckets": self.buckets, "ttl": self.ttl,
                    "time": self.time, "newest": None, "schema": fields.jsonValue(), "files": {}, "gone": []}
        if batch_id <= m["batch_id"]:
            return None
        known = {f.name: f for f in T.StructType.fromJson(m["schema"])}
        for f in fields:
            if known.setdefault(f.name, f).dataType != f.dataType:
                raise ValueError(f"column {f.name}: {f.dataType} in the batch, {known[f.name].dataType} in the table")
        return m | {"version": m["version"] + 1, "batch_id": batch_id, "schema": T.StructType(list(known.values())).jsonValue()}

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Take the rows of one batch; ids ascend, an id known already is skipped."""
        m = self._next(batch, batch_id)
        if m is None:
            return
        files = {int(b): [list(f) for f in fs] for b, fs in m["files"].items()}
        batch = batch.where(" and ".join(f"`{k}` is not null" for k in m["key"]))
        seen = Observation()
        if m["ttl"] is not None:
            batch = batch.observe(seen, F.max(F.unix_micros(F.col(m["time"]).cast("timestamp"))).alias("newest"))
        delta = self._write(self._latest(batch, m), m, f"data/batch={batch_id}")
        if m["ttl"] is not None and delta:
            m["newest"] = max((x for x in (m["newest"], seen.get["newest"]) if x is not None), default=None)
        for b, fs in delta.items():
            files.setdefault(b, []).extend(fs)
        worn = {b: fs[-n:] for b, fs in files.items() if (n := to_merge([size for _, size in fs]))}
        if worn:
            old = self._scan(m, [name for fs in worn.values() for name, _ in fs])
            merged = self._write(self._alive(self._latest(old, m), m), m, f"data/merge={batch_id}")
            for b, fs in worn.items():
                files[b] = files[b][:-len(fs)] + merged.get(b, [])
        m["files"] = {str(b): fs for b, fs in sorted(files.items()) if fs}
        gone = m["gone"] + [[m["version"], name] for fs in worn.values() for name, _ in fs]
        due = [name for v, name in gone if v <= m["version"] - KEEP]
        m["gone"] = [g for g in gone if g[0] > m["version"] - KEEP]
        self.files.commit(f"{self.path}/manifest/{m['version']:020d}.json", json.dumps(m))
        for name in due:
            self.files.delete(f"{self.path}/{name}")
        for v in self.versions():
            if v <= m["version"] - KEEP:
                self.files.delete(f"{self.path}/manifest/{v:020d}.json")

    def read(self, keys: DataFrame | None = None, as_of=None, version: int | None = None) -> DataFrame | None:
        """The rows of one version (the newest), None before the first. With ``keys``
        (the key columns) only these rows, from the buckets that can hold them."""
        m = self.manifest(version)
        if m is None:
            return None
        files = {int(b): fs for b, fs in m["files"].items()}
        if keys is not None:
            keys = keys.select(*m["key"])
            wanted = keys.select(F.collect_set(self._bucket(m["key"], m["buckets"]))).first()[0]  # at most the buckets
            files = {b: fs for b, fs in files.items() if b in wanted}
        rows = self._scan(m, [name for fs in files.values() for name, _ in fs])
        if keys is not None:
            rows = rows.join(keys.distinct(), m["key"], "left_semi").select(*rows.columns)
        return self._alive(self._latest(rows, m), m, as_of)
