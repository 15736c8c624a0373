"""Keyed state of a stream in shared storage: buckets of keys, folded together as they grow."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bucket -> (version, rows) of its folders, oldest first
Layout = dict[int, list[tuple[int, int]]]


def file_system(spark: SparkSession, folder: str):
    """Spark's own handle of the store that holds a folder, and the folder as its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def numbered_folders(spark: SparkSession, folder: str, name: str) -> dict[int, str]:
    """Sub-folders `name=<number>` of a folder by their number; none if it does not exist."""
    system, path = file_system(spark, folder)
    found = [s.getPath() for s in system.listStatus(path)] if system.exists(path) else []
    return {int(p.getName().split("=")[1]): p.toString() for p in found
            if p.getName().startswith(f"{name}=")}


def remove_folder(spark: SparkSession, folder: str) -> None:
    system, path = file_system(spark, folder)
    system.delete(path, True)


class KeyedState:
    """Rows by key that a stream adds to, in `buckets` groups of keys by the hash of the key.

    A micro-batch is one version. It reads only the buckets its keys fall into, and writes only
    those to which it adds rows. A bucket's folder is folded into the new one as soon as the newer
    ones together hold as many rows, so a bucket has at most as many folders as its row count has
    binary digits, and a row is rewritten as often at most. What `fold` leaves out (rows past
    their time) goes then.

    A layout table says which folders make up the state after a version. The last two layouts and
    their folders are kept: a micro-batch that is repeated starts from the layout before it and
    replaces its own folders, so it cannot apply twice. Other folders are removed.

    Rows of null keys are in a bucket like any other. An empty batch leaves the layout as it is.
    `buckets` must stay the same for a folder; choose it so that a bucket fits a few tasks.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64
    ):
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.buckets = list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """State rows with `state_version`, of all buckets or `only` some."""
        layout = self._layout(before)
        chosen = layout if only is None else set(only) & layout.keys()
        return self._rows([(b, version) for b in chosen for version, _ in layout[b]])

    def near(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """State before a micro-batch, of the buckets that its `rows` fall into."""
        touched = rows.select(self.bucket().alias("b")).distinct().collect()  # `buckets` at most
        return self.read(batch_id, [r.b for r in touched])

    def append(
        self, rows: DataFrame, batch_id: int,
        fold: Callable[[DataFrame], DataFrame] | None = None,
    ) -> None:
        """Add `rows` as the version of a micro-batch. `fold` takes state rows with their
        `state_version` and returns those that are kept; it is applied to what is rewritten."""
        layout = self._layout(batch_id)
        added = rows.groupBy(self.bucket().alias("b")).count().collect()  # `buckets` at most
        outgrown = []
        for bucket, total in added:
            folders = layout.setdefault(bucket, [])
            while folders and folders[-1][1] <= total:
                version, held = folders.pop()
                outgrown.append((bucket, version))
                total += held
        everything = rows.withColumn("state_version", F.lit(batch_id).cast("long")).unionByName(
            self._rows(outgrown))
        kept = (fold(everything) if fold else everything).drop("state_version")
        folder = f"{self.path}/state_version={batch_id}"
        if added:
            kept.withColumn("state_bucket", self.bucket()).hint(
                "rebalance", "state_bucket").write.mode("overwrite").partitionBy(
                "state_bucket").parquet(folder)
            sizes = self.spark.read.schema(f"{self.schema}, state_bucket int").parquet(
                folder).groupBy("state_bucket").count().collect()
            for bucket, held in sizes:
                layout[bucket].append((batch_id, held))
        self._save(layout, batch_id)

    def _rows(self, places: Sequence[tuple[int, int]]) -> DataFrame:
        typed = f"{self.schema}, state_version long, state_bucket int"
        if not places:
            return self.spark.createDataFrame([], typed).drop("state_bucket")
        paths = [f"{self.path}/state_version={v}/state_bucket={b}" for b, v in sorted(places)]
        return self.spark.read.schema(typed).option("basePath", self.path).parquet(
            *paths).drop("state_bucket")

    def _layout(self, before: int | None = None) -> Layout:
        saved = numbered_folders(self.spark, f"{self.path}/layout", "batch_id")
        known = [n for n in saved if before is None or n < before]
        return self._load(saved[max(known)]) if known else {}

    def _load(self, folder: str) -> Layout:
        layout = defaultdict(list)
        rows = self.spark.read.schema("bucket int, version long, held long").parquet(folder)
        for bucket, version, held in rows.orderBy("bucket", "version").collect():
            layout[bucket].append((version, held))
        return dict(layout)

    def _save(self, layout: Layout, batch_id: int) -> None:
        rows = [(b, v, n) for b, folders in layout.items() for v, n in folders]
        folder = f"{self.path}/layout/batch_id={batch_id}"
        self.spark.createDataFrame(rows, "bucket int, version long, held long").coalesce(
            1).write.mode("overwrite").parquet(folder)
        saved = numbered_folders(self.spark, f"{self.path}/layout", "batch_id")
        before = [n for n in saved if n < batch_id]
        needed = {(b, v) for b, folders in layout.items() for v, _ in folders}
        if before:
            last = self._load(saved[max(before)])
            needed |= {(b, v) for b, folders in last.items() for v, _ in folders}
        for number in before:
            if number != max(before):
                remove_folder(self.spark, saved[number])
        for version, folder in numbered_folders(self.spark, self.path, "state_version").items():
            held = numbered_folders(self.spark, folder, "state_bucket")
            gone = [b for b in held if (b, version) not in needed]
            for bucket in gone:
                remove_folder(self.spark, held[bucket])
            if len(gone) == len(held):
                remove_folder(self.spark, folder)
