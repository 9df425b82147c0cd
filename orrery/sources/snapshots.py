"""Keyed tables under one folder with snapshots: several change in one commit, and a batch writes about its own size.

A manifest, one file for each version, names what every table consists of: for
each hash bucket of its key a base folder and the folders of later changes. A
commit is one rename that fails where another came first, so that readers see
all of it or nothing. A change is written as rows of its own (a deleted key as
one without values); buckets whose changes outweigh their base are written anew.
Readers take the newest row of each key in buckets that have changes, and all
others as they stand.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

#: Buckets of a table, unless it is created with others.
BUCKETS = 64
#: A bucket is written anew when its changes have more than this share of its base's rows.
MOST_CHANGED = 0.5


class Conflict(RuntimeError):
    """Another commit came first; the transaction can be made again on the newer version."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path("manifest"))

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path("manifest")))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, version: int | None = None) -> dict:
        """That of a version, or of the newest; that of an empty store is version 0."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}, "tokens": {}}
        at = known[-1] if version is None else version
        stream = self._fs.open(self._path(f"manifest/{at:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table in a version, the newest unless one is named."""
        return self._view(self.manifest(version)["tables"][table])

    def transaction(self, token: tuple[str, int] | None = None) -> Transaction:
        """Changes that are committed together; see ``Transaction``."""
        return Transaction(self, self.manifest(), token)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what the newest ``keep`` versions don't need, and what was written for commits that never came; folders deleted.

        No transaction may be open: its folders belong to no version yet.
        """
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        needed = {f.split("/")[1] for m in kept for t in m["tables"].values() for b in t["parts"].values() for f, _ in b}
        gone = 0
        if self._fs.exists(self._path("data")):
            for f in self._fs.listStatus(self._path("data")):
                if f.getPath().getName() not in needed:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        for v in known[:-keep]:
            self._fs.delete(self._path(f"manifest/{v:012d}.json"), False)
        return gone

    def _view(self, state: dict, buckets: set[str] | None = None) -> DataFrame:
        """The rows of a table's state, or of some of its buckets."""
        schema = StructType.fromJson(state["schema"])
        parts = {b: p for b, p in state["parts"].items() if buckets is None or b in buckets}
        plain = [f for p in parts.values() if len(p) == 1 for f, _ in p]
        changed = [(f, seq) for p in parts.values() if len(p) > 1 for f, seq in p]
        found = []
        if plain:
            found.append(self._rows(plain, schema).where("not __gone").select(schema.names))
        if changed:
            # every row carries the version that wrote it; a key has one row in a version
            rows = self._rows([f for f, _ in changed], schema)
            newest = rows.groupBy(*state["keys"]).agg(F.max_by(F.struct(*rows.columns), "__seq").alias("__row"))
            found.append(newest.where("not __row.__gone").select(*(F.col(f"__row.`{c}`").alias(c) for c in schema.names)))
        if not found:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, found)

    def _rows(self, folders: list[str], schema: StructType) -> DataFrame:
        whole = StructType([*schema, StructField("__seq", LongType()), StructField("__gone", BooleanType())])
        return self.spark.read.schema(whole).parquet(*(f"{self.root}/{f}" for f in folders))

    def _publish(self, manifest: dict) -> None:
        """Makes the manifest the newest version, or raises ``Conflict``."""
        draft = self._path(f"manifest/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        files = self._hadoop.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            files.rename(draft, self._path(f"manifest/{manifest['version']:012d}.json"), options)  # never over an older file
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} is taken") from e
            raise


class Transaction:
    """Reads one version; what is changed shows in reads of the same transaction and, once committed, in the next version.

    Used as a context, it commits at the end, and not at all after an error.
    With a ``token`` (name, number) it does nothing where the store has that
    name's number or a later one already: a batch that is run again.
    """

    def __init__(self, store: Store, base: dict, token: tuple[str, int] | None = None):
        self.store, self.base, self.token = store, base, token
        self.done_before = token is not None and base["tokens"].get(token[0], -1) >= token[1]
        self.tables = json.loads(json.dumps(base["tables"]))
        self._id, self._writes = uuid.uuid4().hex, 0

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()

    def create(self, table: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
        """A table with ``rows``, one a key at most; keys are never null."""
        if table in self.tables:
            raise ValueError(f"{table} is there already")
        self.tables[table] = {"schema": rows.schema.jsonValue(), "keys": keys, "buckets": buckets, "parts": {}, "rows": {}}
        self.upsert(table, rows)

    def read(self, table: str, keys: DataFrame | None = None) -> DataFrame:
        """The table's rows, or those that have a key of ``keys``, for which only their buckets are read."""
        state = self.tables[table]
        if keys is None:
            return self.store._view(state)
        wanted = keys.select(*state["keys"]).distinct()
        return self.store._view(state, self._buckets(state, wanted)).join(wanted, state["keys"], "left_semi")

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Whole rows, one a key at most, that replace those of their keys or are new."""
        self._write(table, rows.select(StructType.fromJson(self.tables[table]["schema"]).names), False)

    def delete(self, table: str, keys: DataFrame) -> None:
        """Rows whose key is in ``keys`` go."""
        state = self.tables[table]
        schema = StructType.fromJson(state["schema"])
        gone = keys.select(*state["keys"]).distinct()
        self._write(table, gone.select(*(F.col(f.name) if f.name in state["keys"] else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)), True)

    def commit(self) -> int:
        """The version that now has the changes."""
        if self.done_before or not self._writes:
            return self.base["version"]
        version = self.base["version"] + 1
        tokens = self.base["tokens"] | ({self.token[0]: self.token[1]} if self.token else {})
        self.store._publish({"version": version, "tables": self.tables, "tokens": tokens})
        return version

    def _bucket(self, state: dict):
        return F.pmod(F.xxhash64(*state["keys"]), F.lit(state["buckets"])).cast("int")

    def _buckets(self, state: dict, rows: DataFrame) -> set[str]:
        """The buckets that rows fall into; as many as there are buckets at most."""
        return {str(r["b"]) for r in rows.select(self._bucket(state).alias("b")).distinct().collect()}

    def _write(self, table: str, rows: DataFrame, gone: bool) -> None:
        if self.done_before:
            return
        state = self.tables[table]
        self._writes += 1
        seq = (self.base["version"] << 20) + self._writes  # later writes of one transaction come after its earlier ones
        for bucket, folder, n in self._put(state, rows.withColumns({"__seq": F.lit(seq).cast("long"), "__gone": F.lit(gone)})):
            state["parts"].setdefault(bucket, []).append([folder, seq])
            state["rows"].setdefault(bucket, []).append(n)
        heavy = {b for b, n in state["rows"].items() if len(n) > 1 and sum(n[1:]) > MOST_CHANGED * n[0]}
        if heavy:
            anew = self.store._view(state, heavy).withColumns({"__seq": F.lit(seq).cast("long"), "__gone": F.lit(False)})
            put = {b: (folder, n) for b, folder, n in self._put(state, anew)}
            for b in heavy:
                if b in put:
                    state["parts"][b], state["rows"][b] = [[put[b][0], seq]], [put[b][1]]
                else:
                    del state["parts"][b], state["rows"][b]

    def _put(self, state: dict, rows: DataFrame) -> list[tuple[str, str, int]]:
        """(bucket, folder, rows) of what was written: a folder for each bucket."""
        self._writes_to = f"data/{self._id}-{self._writes}-{uuid.uuid4().hex[:8]}"
        path = f"{self.store.root}/{self._writes_to}"
        # a task for each bucket, large ones in several
        rows.withColumn("__bucket", self._bucket(state)).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(path)
        schema = StructType([StructField("__seq", LongType()), StructField("__bucket", IntegerType())])
        counts = self.store.spark.read.schema(schema).option("basePath", path).parquet(path).groupBy("__bucket").count().collect()
        return [(str(r["__bucket"]), f"{self._writes_to}/__bucket={r['__bucket']}", r["count"]) for r in counts]


def sizes(store: Store) -> dict[int, int]:
    """Bytes of the folders that each version has and the one before hasn't."""
    out, seen = {}, set()
    for v in store.versions():
        folders = {f for t in store.manifest(v)["tables"].values() for parts in t["parts"].values() for f, _ in parts}
        out[v] = sum(store._fs.getContentSummary(store._path(f)).getLength() for f in folders - seen)
        seen |= folders
    return out
