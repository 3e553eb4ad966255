"""Sharding by size-tiered compaction under a versioned manifest.

A store is a folder: ``data/`` with immutable Parquet files (shards), ``manifests/`` with one table of shards for each
version, ``versions/`` with one small file for each committed version that names its manifest.

Arrivals are appended as they come, each task writing small shards of ``shard_rows`` rows, without a shuffle. Compaction puts
shards into tiers by the logarithm of their size; shards of one tier are similar in size, and once a tier has
``fan_in`` of them they are packed, in path order, into runs of about the target size, and each run becomes one file. What has
half the target or more, or has too few companions, stays as it is. A tier's shards are dealt over lanes first, so the running
sums that pack them never meet in one task. The manifest is a table, never a list in the driver: a version is read by its
folders, one for each append or compaction that still has a shard in force, joined with the manifest's paths. Runs are dealt to
MERGE_TASKS tasks at most, each of which writes its runs one after the other. A run has a folder of its own, so a later compaction
reads the remainders that it merges and none of the full shards beside them. ``expire`` deletes what only old versions need.

A version becomes visible by one rename of a finished file to ``versions/<number>``, which fails if another writer was
first; files that no manifest names are never read, so a job that dies leaves the last version in force, and
``compact`` can be run again.

Edges: nulls and empty texts are stored as they are; repeated rows are all kept; long texts make a shard larger, not several;
all columns are kept, also those named ``_metadata``, and the run column is renamed if a column has its name in any case;
appending an empty table adds no shards (and reading a store without shards gives no rows, with the columns of the
first append; a store that has had none can't be read).
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelogs.llm.common import materialize, new_path, read_table

SHARD_ROWS = 1000
TARGET_BYTES = 64 << 20
FAN_IN = 4
TIER_BASE = 64 << 10
#: Targets that one lane packs.
LANE_TARGETS = 64
#: Shards that a compaction names one by one, where it doesn't merge all of a folder; beyond that it reads such folders whole and drops the rest.
NAMED_SHARDS = 10_000
#: Tasks of a compaction.
MERGE_TASKS = 10_000
CODEC = "zstd"
#: A shard's folder below ``data/``, and its name in that folder.
FOLDER = r"^.*/data/([ac]-[0-9a-f]+)/(.*)$"
MANIFEST = "path string, n_docs long, bytes long, version long"


class ShardStore:
    """A versioned set of Parquet shards under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- versions -------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, path, text: str) -> None:
        out = self._fs().create(path, False)
        out.write(bytearray(text.encode()))
        out.close()

    def version(self) -> int:
        """The last committed version, 0 if there is none."""
        fs, at = self._fs(), self._path("versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        name = self.spark.read.text(f"{self.root}/versions/{version:012d}").first()["value"]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def commit(self, manifest: DataFrame, base: int) -> int:
        """Make ``manifest`` the version after ``base``; fails if that version exists."""
        jvm, name, version = self.spark._jvm, f"m-{uuid.uuid4().hex}", base + 1
        manifest.select("path", "n_docs", "bytes", "version").write.parquet(f"{self.root}/manifests/{name}")
        fs, draft, final = self._fs(), self._path(f"drafts/{name}"), self._path(f"versions/{version:012d}")
        fs.mkdirs(final.getParent())
        self._put(draft, name)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(draft, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return version

    # --- data -----------------------------------------------------------------------------------------------

    def _shards_in(self, folder: str, version: int) -> DataFrame:
        """Manifest rows of the files in a folder, from the files' own metadata."""
        stored = self.spark.read.parquet(folder)
        files = stored.select(stored.metadataColumn("_metadata").alias("m")).select(F.col("m.file_path").alias("path"), F.col("m.file_size").alias("bytes"))
        return files.groupBy("path").agg(F.count("*").alias("n_docs"), F.max("bytes").alias("bytes")).withColumn("version", F.lit(version).cast("long"))

    def append(self, docs: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
        """Add rows as small shards; returns the new version."""
        base, folder = self.version(), f"{self.root}/data/a-{uuid.uuid4().hex}"
        docs.write.option("compression", CODEC).option("maxRecordsPerFile", shard_rows).parquet(folder)
        schema = self._path("schema")
        if not self._fs().exists(schema):
            self._put(schema, docs.schema.json())
        return self.commit(self.manifest(base).unionByName(self._shards_in(folder, base + 1)), base)

    def plan(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
        """(path, run): the shards that a compaction merges and the run each goes to."""
        small = self.manifest().filter(F.col("bytes") * 2 < target)
        tier = F.floor(F.log(4.0, F.greatest(F.col("bytes") / TIER_BASE, F.lit(1.0)))).cast("int")
        tiered = small.select("path", "bytes", tier.alias("tier"))
        sizes = tiered.groupBy("tier").agg(F.sum("bytes").alias("total"), F.count("*").alias("n")).filter(F.col("n") >= fan_in)
        lanes = F.ceil(F.col("total") / (target * LANE_TARGETS)).cast("int")
        laned = tiered.join(sizes, "tier").withColumn("lane", F.pmod(F.xxhash64("path"), lanes).cast("int"))
        upto = F.sum("bytes").over(Window.partitionBy("tier", "lane").orderBy("path"))
        packed = laned.withColumn("k", F.floor((upto - F.col("bytes") / 2) / target).cast("int"))
        return packed.select("path", F.concat_ws("-", F.lit("t"), "tier", "lane", "k").alias("run"))

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> int:
        """Merge similar shards into target-sized files and commit; returns the version in force."""
        base = self.version()
        plan = materialize(self.plan(target, fan_in), "plan")
        runs = plan.select("run").distinct()
        n_runs = runs.count()
        if not n_runs:
            return base
        tasks = min(n_runs, MERGE_TASKS)
        # A row a target-sized file: it numbers the runs, so that each task gets as many as the others.
        plan = plan.join(runs.select("run", ((F.row_number().over(Window.orderBy("run")) - 1) % tasks).alias("task")), "run")
        docs, folder = self._planned(plan, base), f"{self.root}/data/c-{uuid.uuid4().hex}"
        run, taken = "run", {c.casefold() for c in docs.columns}
        while {run, f"{run}_path", f"{run}_task"} & taken:
            run += "_"
        moved = docs.withColumn(f"{run}_path", docs.metadataColumn("_metadata")["file_path"]).join(plan.select(F.col("path").alias(f"{run}_path"), F.col("run").alias(run), F.col("task").alias(f"{run}_task")), f"{run}_path").drop(f"{run}_path")
        # Each run is in one task, and is written by it as one file.
        moved.repartitionById(tasks, F.col(f"{run}_task")).drop(f"{run}_task").write.option("compression", CODEC).partitionBy(run).parquet(folder)
        rest = self.manifest(base).join(plan, "path", "left_anti")
        return self.commit(rest.unionByName(self._shards_in(folder, base + 1)), base)

    def _planned(self, plan: DataFrame, base: int) -> DataFrame:
        """The rows of the planned shards: folders that are planned whole (an append's, a remainder's) by their names, other shards one by one."""
        home = F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("home")
        planned = self.manifest(base).select("path", home).join(plan.select("path", F.lit(1).alias("p")), "path", "left")
        homes = materialize(planned.groupBy("home").agg(F.count("*").alias("n"), F.count("p").alias("k")).filter("k > 0"), "plan")
        split = homes.filter("k < n")
        named = split.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()["k"] <= NAMED_SHARDS
        paths = [r["home"] for r in (homes.filter("k = n") if named else homes).collect()]  # one an append or remainder
        if named:
            paths += [r["path"] for r in planned.filter("p = 1").join(split.select("home"), "home").select("path").collect()]
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*sorted(map(unquote, paths)))

    def expire(self, keep: int = 1) -> int:
        """Delete the versions before the last ``keep``, with their manifests and the shards that no later version names; returns the number
        of versions deleted. Files of jobs that died are deleted too, so no other job may be writing."""
        last, fs = self.version(), self._fs()
        names = sorted(int(s.getPath().getName()) for s in fs.listStatus(self._path("versions")) if s.getPath().getName().isdigit()) if last else []
        kept, old = [v for v in names if v > last - keep], [v for v in names if v <= last - keep]
        manifest_of = lambda v: self.spark.read.text(f"{self.root}/versions/{v:012d}").first()["value"]
        named = {manifest_of(v) for v in kept}
        in_force = self.manifest(last) if kept else None
        for v in kept[:-1]:
            in_force = in_force.union(self.manifest(v))
        if in_force is None:
            return 0
        in_force = materialize(in_force.select("path", F.regexp_extract("path", FOLDER, 1).alias("folder")).distinct(), "in_force")
        folders = {r["folder"] for r in in_force.select("folder").distinct().collect()}  # one a commit
        for v in old:
            gone = self.manifest(v).select("path").join(in_force, "path", "left_anti").filter(F.regexp_extract("path", FOLDER, 1).isin(*folders))
            for r in gone.toLocalIterator():  # remainders that were merged since
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(unquote(r["path"])), False)
        for status in fs.listStatus(self._path("data")):
            if status.getPath().getName() not in folders:
                fs.delete(status.getPath(), True)
        for status in fs.listStatus(self._path("manifests")):
            if status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)
        for v in old:
            fs.delete(self._path(f"versions/{v:012d}"), False)
        return len(old)

    def _stored(self, manifest: DataFrame) -> DataFrame:
        """All rows in the folders that the manifest's shards lie in, those of other shards as well."""
        folders = [r["f"] for r in manifest.select(F.regexp_extract("path", FOLDER, 1).alias("f")).distinct().collect()]  # one a commit at most
        if folders:
            return self.spark.read.option("recursiveFileLookup", "true").parquet(*[f"{self.root}/data/{f}" for f in sorted(folders)])
        fields = json.loads(self.spark.read.text(f"{self.root}/schema", wholetext=True).first()["value"])
        empty = f"{self.root}/data/empty-{uuid.uuid4().hex}"
        self.spark.createDataFrame([], T.StructType.fromJson(fields)).write.parquet(empty)
        return self.spark.read.parquet(empty)

    def _in_force(self, version: int | None) -> tuple[DataFrame, DataFrame]:
        """The stored rows as (row, file), and the manifest."""
        manifest = self.manifest(version)
        stored = self._stored(manifest)
        return stored.select(F.struct(*[stored[c] for c in stored.columns]).alias("row"), stored.metadataColumn("_metadata")["file_path"].alias("file")), manifest

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        stored, manifest = self._in_force(version)
        return stored.join(manifest.select(F.col("path").alias("file")), "file", "left_semi").select("row.*")

    def placed(self) -> DataFrame:
        """(doc_id, shard, shard_docs, shard_bytes, version), one row a stored row."""
        stored, manifest = self._in_force(None)
        shards = manifest.select(F.col("path").alias("file"), F.regexp_extract("path", FOLDER, 2).alias("shard"), F.col("n_docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"), "version")
        return stored.select("row.doc_id", "file").join(shards, "file").drop("file")


def shard_documents(docs: DataFrame, root: str, **options) -> DataFrame:
    """Append documents to the store at ``root``, compact it, and tell where each row lies."""
    store = ShardStore(docs.sparkSession, root)
    store.append(docs)
    store.compact(**options)
    return store.placed()


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), new_path(spark, "shards"))
