"""A keyed table that takes upserts: small sorted-out runs under a manifest, merged level by level."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "run string, level int, epoch long"


class VersionedTable:
    """Rows by key in the folder `path`, for one writer and any number of readers.

    A write is one run: a Parquet folder with one row for each key, dealt to `buckets` folders by
    the key's hash. A manifest names the runs that count; it is a new table at each commit, and the
    newest complete one holds, so a writer lost halfway leaves the table as it was. `fanout` runs of
    a level are merged to one of the next, so a row is rewritten once a level and a read meets
    less than `fanout` runs of each level. Of a key's rows that of the last epoch wins. Writing an
    epoch again replaces it while it has not been merged, and is left out after: a stream may repeat
    its last trigger.

    Null keys are one key. Extra columns are as in the first write; their names must not start with
    an underscore. `buckets` stays as it was when the table was made.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, fanout: int = 8) -> None:
        if fanout < 2:
            raise ValueError("fanout is at least 2")
        self.spark, self.path, self.key, self.buckets, self.fanout = spark, path.rstrip("/"), key, buckets, fanout

    def _commits(self) -> list[tuple[int, bool]]:
        """Numbers of the manifests that have been begun, and whether each is complete."""
        to = self.spark._jvm.org.apache.hadoop.fs.Path
        at = to(f"{self.path}/manifests")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted((int(n[2:]), fs.exists(to(f"{self.path}/manifests/{n}/_SUCCESS"))) for n in names if n.startswith("n="))

    def runs(self) -> list[tuple[str, int, int]]:
        """(run, level, epoch of its newest row) of the runs that count, newest first."""
        done = [n for n, complete in self._commits() if complete]
        if not done:
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/n={done[-1]}").collect()
        return sorted(((r.run, r.level, r.epoch) for r in rows), key=lambda r: -r[2])

    def _commit(self, runs: list[tuple[str, int, int]]) -> None:
        n = max((n for n, _ in self._commits()), default=-1) + 1
        self.spark.createDataFrame(runs, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifests/n={n}")

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _rows(self, runs: list[tuple[str, int, int]], buckets: list[int] | None = None) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/runs/{r}") for r, _, _ in runs]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return df if buckets is None else df.where(F.col("_bucket").isin(buckets))

    def _newest(self, df: DataFrame) -> DataFrame:
        names = [c for c in df.columns if c not in (self.key, "_bucket")]
        return df.groupBy("_bucket", self.key).agg(F.max_by(F.struct(*names), "_epoch").alias("_row")).select("_bucket", self.key, "_row.*")

    def _write(self, df: DataFrame) -> str:
        """df as a run, its rows sorted by bucket and key so that a task has few open files and lookups skip row groups."""
        run = uuid.uuid4().hex
        df.repartition("_bucket", F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(4))).sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.path}/runs/{run}")
        return run

    def put(self, batch: DataFrame, epoch: int, order: str | None = None) -> None:
        """Writes batch as epoch. Of a key's rows in it the one of largest `order` wins, ties and no order by the largest row; an empty batch commits nothing."""
        runs = self.runs()
        if any(level > 0 and epoch <= e for _, level, e in runs):
            return
        clash = [c for c in batch.columns if c.startswith("_")]
        if clash:
            raise ValueError(f"columns may not start with an underscore: {clash}")
        names = [c for c in batch.columns if c not in (self.key, order)]
        row = F.struct(*([order] if order else []), *names)
        last = batch.groupBy(self.key).agg(F.max_by(F.struct(*names), row).alias("_row")).select(self.key, "_row.*", F.lit(epoch).cast("long").alias("_epoch"), self._bucket(self.key).alias("_bucket"))
        if last.isEmpty():
            return
        runs = [r for r in runs if r[2] != epoch] + [(self._write(last), 0, epoch)]
        self._commit(runs)
        self._merge(runs)

    def _merge(self, runs: list[tuple[str, int, int]]) -> None:
        """Merges full levels from the lowest up; each merge is a commit of its own."""
        level = 0
        while any(r[1] >= level for r in runs):
            full = [r for r in runs if r[1] == level]
            if len(full) >= self.fanout:
                merged = (self._write(self._newest(self._rows(full))), level + 1, max(e for _, _, e in full))
                runs = [r for r in runs if r[1] != level] + [merged]
                self._commit(runs)
            level += 1

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The newest row of every key, or of the keys in `keys` (a table whose column of the key's name is looked up; only their buckets are read)."""
        runs = self.runs()
        if not runs:
            raise ValueError(f"no table at {self.path}")
        if keys is None:
            return self._newest(self._rows(runs)).drop("_bucket", "_epoch")
        asked = keys.select(self.key).distinct()
        found = [r[0] for r in asked.select(self._bucket(self.key)).distinct().collect()]
        rows = self._rows(runs, found)
        met = rows.join(asked.withColumnRenamed(self.key, "_asked"), F.col(self.key).eqNullSafe(F.col("_asked")), "left_semi")
        return self._newest(met).drop("_bucket", "_epoch")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes runs that none of the newest `keep` manifests names, and older manifests; returns how many runs went. Not while a write is under way."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        commits = self._commits()
        done = [n for n, complete in commits if complete][-max(1, keep) :]
        if not done:
            return 0
        held = {r.run for r in self.spark.read.schema(_MANIFEST).parquet(*(f"{self.path}/manifests/n={n}" for n in done)).collect()}
        at = jvm.Path(f"{self.path}/runs")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in held]
        for n, _ in commits:
            if n < done[0]:
                fs.delete(jvm.Path(f"{self.path}/manifests/n={n}"), True)
        for p in old:
            fs.delete(p, True)
        return len(old)
