"""Tables that are published as a whole: Parquet folders under a manifest that only ever gets a next version.

A writer puts its data into folders that no reader knows, then the manifest of the next
version beside the earlier ones, if that version is not there yet. Of two writers that
started from one version one wins and the other gets ``Conflict``; a writer that dies
leaves folders without a manifest, which ``sweep`` deletes. Readers keep the version
they opened. The put is a rename that refuses an existing target: atomic in HDFS and
its like; a local file system, used in tests, has a moment between look and rename,
and object stores need a committer of their own.
"""

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer published the version first."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Manifests:
    """Numbered JSON documents below ``root``; each number is written once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names("manifests") if n.endswith(".json"))

    def at(self, version: int | None = None) -> dict:
        """The content of a version, the last one by default; before the first it is empty, with version 0."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return {"version": 0}
        stream = self.fs.open(self._path(f"manifests/{version:020d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, base: int, content: dict) -> int:
        """Publish ``content`` as the version after ``base``; Conflict if that is there already."""
        version = base + 1
        target, draft = self._path(f"manifests/{version:020d}.json"), self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(content | {"version": version}).encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(draft, target, options)
        except Exception as error:
            self.fs.delete(draft, False)
            if self.fs.exists(target):
                raise Conflict(f"version {version} of {self.root} is published already") from error
            raise
        return version

    def sweep(self, keep: int, named: Callable[[dict], set[str]]) -> list[str]:
        """Delete all but the last ``keep`` versions and every data folder that no version left names.

        Run it while no writer works: a folder that is still being written has no manifest yet.
        """
        versions = self.versions()
        for version in versions[:-keep]:
            self.fs.delete(self._path(f"manifests/{version:020d}.json"), False)
        used = set().union(*[named(self.at(v)) for v in versions[-keep:]])
        gone = [n for n in self.names("data") if n not in used]
        for name in gone:
            self.fs.delete(self._path(f"data/{name}"), True)
        return gone


class Table:
    """Rows with a unique key in hashed buckets; a publication rewrites the buckets of changed keys only.

    A manifest names one folder a bucket and epoch, so its size is that of the buckets and
    not of the rows. The serving epoch is read; another can be filled beside it and take over.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: T.StructType, buckets: int = 64):
        self.spark, self.keys, self.schema, self.buckets = spark, keys, schema, buckets
        self.manifests = Manifests(spark, root)

    def state(self, version: int | None = None) -> dict:
        found = self.manifests.at(version)
        return {"serving": 0, "building": None, "epochs": {"0": {}}} | found

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket_")

    def _rows(self, parts: dict[str, str], buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.manifests.root}/data/{p}" for b, p in sorted(parts.items()) if p and (buckets is None or int(b) in buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None, epoch: int | None = None) -> DataFrame:
        """All rows of a version (the last one by default), which later publications do not change."""
        state = self.state(version)
        return self._rows(state["epochs"].get(str(state["serving"] if epoch is None else epoch), {}))

    def draft(self, changes: DataFrame, base: dict | None = None, epoch: int | None = None, merge=None) -> dict:
        """The state after ``changes``, with its data written and nothing published.

        changes: the table's columns, one row a key; rows with a true ``deleted`` column remove their key.
        ``merge(old, changes)`` may make the new rows of the touched buckets in another way.
        """
        base = self.state() if base is None else base
        epoch = base["serving"] if epoch is None else epoch
        parts = base["epochs"].get(str(epoch), {})
        changes = changes.withColumn("bucket_", self._bucket())
        changes.write.parquet(staged := f"{self.manifests.root}/data/staged-{uuid.uuid4().hex}")
        changes = self.spark.read.parquet(staged)
        touched = [r.bucket_ for r in changes.select("bucket_").distinct().collect()]  # at most the buckets
        changes = changes.drop("bucket_")
        if not touched:
            return base
        rows = (merge or self._replaced)(self._rows(parts, touched), changes)
        name = f"{uuid.uuid4().hex}"
        rows = rows.select(*self.schema.names).withColumn("bucket_", self._bucket())
        rows.repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.manifests.root}/data/{name}")
        written = {int(n.split("=")[1]) for n in self.manifests.names(f"data/{name}") if n.startswith("bucket_=")}
        new = {str(b): f"{name}/bucket_={b}" if b in written else None for b in touched}
        self.manifests.fs.delete(self.manifests._path(f"data/{staged.rsplit('/', 1)[1]}"), True)
        return base | {"epochs": base["epochs"] | {str(epoch): parts | new}}

    def _replaced(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        alive = changes.where("NOT coalesce(deleted, false)") if "deleted" in changes.columns else changes
        return old.join(changes.select(*self.keys), self.keys, "left_anti").select(*self.schema.names).unionByName(alive.select(*self.schema.names))

    def publish(self, state: dict) -> int:
        return self.manifests.put(state["version"], state)

    def upsert(self, changes: DataFrame, base: dict | None = None, **options) -> int:
        """Write and publish changes; Conflict if ``base`` (the state by default) is no longer the last version."""
        return self.publish(self.draft(changes, base, **options))

    def begin_epoch(self) -> int:
        """Start an epoch that fills beside the serving one; an unfinished one is taken up again."""
        state = self.state()
        if state["building"] is not None:
            return state["building"]
        new = state["serving"] + 1
        self.publish(state | {"building": new, "epochs": state["epochs"] | {str(new): {}}})
        return new

    def switch(self, waiting: int) -> bool:
        """Let the filled epoch serve once nothing waits for it; the old one's folders stay for pinned readers until ``sweep``."""
        state = self.state()
        if state["building"] is None or waiting:
            return False
        new = str(state["building"])
        self.publish(state | {"serving": int(new), "building": None, "epochs": {new: state["epochs"][new]}})
        return True

    def sweep(self, keep: int = 1) -> list[str]:
        return self.manifests.sweep(keep, lambda m: {p.split("/")[0] for parts in m["epochs"].values() for p in parts.values() if p})


def publish_work(table: Table, work: DataFrame, revisions: DataFrame, scopes: tuple[str, ...], tries: int = 5) -> tuple[int, DataFrame]:
    """(version, outcomes): rows of work whose revisions still stand are published, the others are conflicts (M5).

    work: the table's columns, the scopes' revisions it was built from among them; revisions: the table's keys
    and the scopes as they stand now. outcomes: the keys and ``outcome``. If another writer publishes in between, the
    rows are merged into its version and tried again; the data of a lost try is never seen.
    """
    now = revisions.select(*table.keys, *[F.col(s).alias(f"now_{s}") for s in scopes], F.lit(True).alias("known_"))
    same = F.col("known_").isNotNull()
    for s in scopes:
        same = same & F.col(s).eqNullSafe(F.col(f"now_{s}"))
    judged = work.join(now, table.keys, "left").withColumn("outcome", F.when(same, "published").otherwise("conflict"))
    judged.select(*table.schema.names, "outcome").write.parquet(folder := f"{table.manifests.root}/data/judged-{uuid.uuid4().hex}")
    judged = table.spark.read.parquet(folder)
    outcomes = judged.select(*table.keys, "outcome")
    for _ in range(tries):
        try:
            return table.upsert(judged.where("outcome = 'published'").drop("outcome")), outcomes
        except Conflict:
            continue
    raise Conflict(f"{tries} tries met other writers")


