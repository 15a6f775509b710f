"""A keyed Parquet table for micro-batches: upserts that rewrite only the buckets they touch, each batch applied once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "store_bucket"
MODES = ("replace", "update", "absent")


class KeyedStore:
    """One row a key under ``path``, a folder that driver and executors share.

    Rows lie in ``buckets`` by their key's hash. A batch is merged with the buckets that its keys are in, these are written to a new
    folder, and a commit of one small file then names the folder of every bucket: readers see all of a batch or nothing
    of it, and read live rows only, however long the history is. A commit also names the last batch of each ``writer``, so
    a batch that comes again after a failure changes nothing. One batch is written at a time.

    ``files`` splits a bucket's rows among so many tasks and files; what the driver holds is a name a bucket. The number of
    buckets is that of the first commit. A null key is a key as any other. Repeated keys of a batch count once: the greatest
    ``sequence`` (the least with ``absent``), then the greatest (least) JSON text.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = 64, files: int = 1) -> None:
        if key not in schema.names or BUCKET in schema.names:
            raise ValueError(f"the schema needs the key {key} and may not hold {BUCKET}")
        self.spark, self.path, self.key, self.schema, self.files = spark, path.rstrip("/"), key, schema, files
        self.buckets = self._last()["buckets"] or buckets

    def read(self) -> DataFrame:
        """All rows as of the last commit."""
        return self._rows(self.spark, self._last()["folders"])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys (a column named as the key); other buckets are not read."""
        wanted = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()}  # a number a bucket
        rows = self._rows(self.spark, {b: f for b, f in self._last()["folders"].items() if b in wanted})
        k = keys.select(F.col(self.key).alias("_wanted")).distinct()
        return rows.join(k, F.col(self.key).eqNullSafe(F.col("_wanted")), "left_semi")

    def apply(self, rows: DataFrame, batch: int, writer: str = "stream", mode: str = "replace", columns: Iterable[str] | None = None, sequence: Column | None = None) -> bool:
        """Merge a batch; False, and nothing is done, if this writer's batch of that number or a later one is in already.

        ``replace``: the new row stands for the old one, columns that it lacks are null. ``update``: only ``columns`` (all that the
        batch has, if None) of rows that exist change, other keys are inserted. ``absent``: only keys that the store lacks are inserted.
        """
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if unknown := set(rows.columns) - set(self.schema.names):
            raise ValueError(f"columns that the store lacks: {sorted(unknown)}")
        last = self._last()
        if last["applied"].get(writer, -1) >= batch:
            return False
        given = [c for c in self.schema.names if c in rows.columns]
        changed = set(given if columns is None else columns)
        row = F.struct(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in given))
        order = F.struct((F.lit(0) if sequence is None else sequence).alias("at"), F.to_json(row, {"ignoreNullFields": "false"}).alias("text"))
        pick = F.min_by if mode == "absent" else F.max_by
        # aggregated on the way to the shuffle, so a hot key sends a row a task
        new = rows.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key), row.alias("_new"), order.alias("_order")).groupBy(self.key).agg(pick("_new", "_order").alias("_new")).withColumn(BUCKET, self._bucket()).persist()
        try:
            touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
            old = self._rows(rows.sparkSession, {b: f for b, f in last["folders"].items() if int(b) in touched})
            old = old.select(self.key, F.struct(*self.schema.names).alias("_old"), self._bucket().alias(BUCKET))
            place = [BUCKET, "_file"]
            both = old.unionByName(new, allowMissingColumns=True).withColumn("_file", F.pmod(F.hash(self.key), F.lit(self.files)))
            both = both.repartition(max(1, len(touched)) * self.files, *place).groupBy(*place, self.key).agg(F.any_value("_old", True).alias("_old"), F.any_value("_new", True).alias("_new"))
            is_old, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()

            def value(c: str) -> Column:
                before = F.col(f"_old.{c}")
                after = F.col(f"_new.{c}") if c in given else F.lit(None).cast(self.schema[c].dataType)
                if mode == "absent":
                    return F.when(is_old, before).otherwise(after)
                if mode == "update" and c not in changed:
                    return F.when(is_old, before).otherwise(after)
                return F.when(is_new, after).otherwise(before)

            # the key of a row is that of its group in every mode
            merged = both.select(BUCKET, *(F.col(c) if c == self.key else value(c).alias(c) for c in self.schema.names))
            self._commit(last, merged, touched, {writer: batch})
        finally:
            new.unpersist()
        return True

    def remove(self, condition: Column) -> int:
        """Take out the rows for which ``condition`` is true, such as expired marks; only their buckets are rewritten. How many went."""
        last = self._last()
        gone = {r[0]: r["n"] for r in self._rows(self.spark, last["folders"]).where(condition).groupBy(self._bucket().alias(BUCKET)).agg(F.count(F.lit(1)).alias("n")).collect()}
        if gone:
            kept = self._rows(self.spark, {b: f for b, f in last["folders"].items() if int(b) in gone}).where(~F.coalesce(condition, F.lit(False)))
            place = [self._bucket().alias(BUCKET), F.pmod(F.hash(self.key), F.lit(self.files)).alias("_file")]
            self._commit(last, kept.select(*place, *self.schema.names).repartition(len(gone) * self.files, BUCKET, "_file").drop("_file"), list(gone), {})
        return sum(gone.values())

    def sink(self, writer: str = "stream", **how) -> Callable[[DataFrame, int], None]:
        """A step for ``cycle.run_cycles``; with ``fail_fast`` a batch that failed is replayed when the query starts again."""
        return lambda rows, number: self.apply(rows, number, writer, **how) and None

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` commits and the folders that none of these names, and return their names.

        Readers of older commits fail afterwards; don't run it while a batch is written, whose folder has no commit yet.
        """
        commits = [n for n in self._names("commits") if self._whole(n)]
        stay = commits[-max(1, keep):]
        used = {f for n in stay for f in self._manifest(n)["folders"].values()}
        old = [f"commits/{n}" for n in self._names("commits") if n not in stay] + [f"data/{n}" for n in self._names("data") if n not in used]
        for name in old:
            at, fs = self._at(name)
            fs.delete(at, True)
        return old

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _rows(self, spark: SparkSession, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}/{BUCKET}={b}" for b, f in sorted(folders.items())))

    def _commit(self, last: dict, rows: DataFrame, touched: list[int], applied: dict[str, int]) -> None:
        """Write the touched buckets to a folder of their own, then the file that makes them the current ones."""
        folders = {b: f for b, f in last["folders"].items() if int(b) not in touched}
        if touched:
            folder = uuid.uuid4().hex
            rows.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
            folders |= {n.split("=")[1]: folder for n in self._names(f"data/{folder}") if n.startswith(f"{BUCKET}=")}
        text = json.dumps({"buckets": self.buckets, "applied": last["applied"] | applied, "folders": folders}, sort_keys=True)
        number = int((self._names("commits") or ["-1"])[-1]) + 1
        self.spark.range(1, numPartitions=1).select(F.lit(text).alias("value")).write.text(f"{self.path}/commits/{number:012d}")

    def _last(self) -> dict:
        for name in reversed(self._names("commits")):
            if self._whole(name):
                return self._manifest(name)
        return {"buckets": None, "applied": {}, "folders": {}}

    def _manifest(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/commits/{name}").first()[0])

    def _whole(self, name: str) -> bool:
        """Whether a commit was ended: its one file gets its place by a rename."""
        return any(n.startswith("part-") for n in self._names(f"commits/{name}"))

    def _names(self, folder: str) -> list[str]:
        at, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())
