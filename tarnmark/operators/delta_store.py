"""A vector table that changes by appending: bucketed deltas, merged on read, compacted by bucket.

Layout below one folder: data folders (``base-…`` and ``delta-…``), each cut into
``bucket=…`` by a hash of the doc_id, and ``_log/<version>.json``. A version file
names the folder of each base bucket and the deltas since; it is written last, so
what it does not name was never there. A batch appends one delta with its own
rows only. Deltas hold tombstones too.

A read takes the latest delta row of each doc_id, and the base rows of the touched
buckets that no delta row replaces; untouched buckets are plain scans. Compaction
rewrites the touched buckets and leaves the others where they lie: it finds by keys
alone which rows are replaced, so whole rows are read and written once, and shuffled
only if the replaced keys are too many to send to the tasks. Batches carry a
number: one that was committed is not applied again, so a repeated batch of a
stream changes nothing, and one that failed before its version file leaves only a
folder for ``vacuum``.

One writer at a time: a version that exists already is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.errors import StorageError
from tarnmark.operators.sync import require_unique, sync_status
from tarnmark.storage import discard, materialize

STORE = "doc_id string, concept_id string, page_content string, metadata string, content_hash string"
COLUMNS = [f.split()[0] for f in STORE.split(", ")]
#: Buckets of a new store, and deltas after which a write compacts.
BUCKETS, COMPACT_AFTER = 16, 8
#: Bytes of replaced keys (16 more a row) that a compaction sends to the tasks; beyond them it joins by a shuffle.
SENT_KEYS = 32 << 20


class DeltaStore:
    """Rows of a schema, one of each ``key``; of (doc_id, concept_id, page_content, metadata, content_hash) by default.

    Buckets are cut by a hash of ``by``, the key itself by default; rows of one key
    must then always have the same ``by``.
    """

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER, schema: str = STORE, key: str = "doc_id", by: str | None = None):
        if buckets < 1 or compact_after < 1:
            raise ValueError(f"buckets and compact_after must be at least 1, got {buckets} and {compact_after}")
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after
        self.schema, self.key, self.by = schema, key, by or key
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]
        self._new = {"version": 0, "batch": None, "buckets": buckets, "base": {}, "deltas": []}

    # ------------------------------------------------------------------- log

    def _fs(self, *parts: str):
        """(file system, path) of something in the store."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, log = self._fs("_log")
        if not fs.exists(log):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> dict:
        """What a version names; the latest by default."""
        known = self.versions()
        if version is None and not known:
            return dict(self._new)
        if version is not None and version not in known:
            raise StorageError(f"{self.path} has no version {version}")
        fs, at = self._fs("_log", f"{known[-1] if version is None else version:020}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        fs, at = self._fs("_log", f"{state['version']:020}.json")
        _, draft = self._fs("_log", f".{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        stream.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise StorageError(f"version {state['version']} of {self.path} was written by another")

    # ------------------------------------------------------------------ rows

    def _bucket(self, state: dict):
        return F.pmod(F.xxhash64(self.by), F.lit(state["buckets"])).cast("int")

    def _base(self, state: dict, columns: list[str], touched: list[int] | None = None) -> DataFrame:
        """Base rows with their bucket, of some buckets or all."""
        by_folder: dict[str, list[int]] = {}
        for bucket, folder in state["base"].items():
            if touched is None or int(bucket) in touched:
                by_folder.setdefault(folder, []).append(int(bucket))
        out = self.spark.createDataFrame([], self.schema + ", bucket int").select(*columns, "bucket")
        for folder, buckets in by_folder.items():
            rows = self.spark.read.schema(self.schema + ", bucket int").parquet(f"{self.path}/{folder}")
            out = out.unionByName(rows.where(F.col("bucket").isin(buckets)).select(*columns, "bucket"))
        return out

    def _latest(self, state: dict, columns: list[str], buckets: list[int] | None = None) -> DataFrame:
        """(key, r: columns and gone) of the last delta row of each key."""
        kind = self.schema + ", gone boolean, bucket int"
        out = None
        for delta in state["deltas"]:
            rows = self.spark.read.schema(kind).parquet(f"{self.path}/{delta['folder']}")
            rows = (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*columns, "gone", F.lit(delta["version"]).alias("at"))
            out = rows if out is None else out.unionByName(rows)
        return out.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in columns if c != self.key], "gone"), "at").alias("r"))

    def _merged(self, state: dict, columns: list[str], touched: list[int]) -> DataFrame:
        """Rows of the touched buckets as they are now."""
        latest = self._latest(state, columns, touched)
        base = self._base(state, columns, touched).drop("bucket").join(latest.select(self.key), self.key, "left_anti")
        return base.unionByName(latest.where("not r.gone").select(self.key, "r.*").drop("gone"))

    def _compacted(self, state: dict, touched: list[int]) -> tuple[DataFrame, list[DataFrame]]:
        """Rows of the touched buckets as they are now, for all columns, and the written tables of keys they depend on."""
        kind, tables, out, keys = self.schema + ", gone boolean, bucket int", [], None, None
        for delta in state["deltas"]:
            rows = self.spark.read.schema(kind).parquet(f"{self.path}/{delta['folder']}").withColumn("at", F.lit(delta["version"]))
            some, kept = rows.select(self.key, "at"), rows.where("not gone").select(*self.columns, "at")
            keys, out = (some, kept) if keys is None else (keys.unionByName(some), out.unionByName(kept))

        def without(rows: DataFrame, taken: DataFrame, on: list[str]) -> DataFrame:
            tables.append(materialize(taken.select([F.col(c).alias(f"_{c}") for c in on]), "taken"))
            size = tables[-1].agg(F.sum(F.octet_length(F.col(f"_{self.key}").cast("string")) + 16)).first()[0] or 0
            side = F.broadcast(tables[-1]) if size <= SENT_KEYS else tables[-1]
            match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
            return rows.join(side, match, "left_anti")

        if len(state["deltas"]) > 1:
            each = keys.groupBy(self.key).agg(F.array_sort(F.collect_list("at")).alias("at")).where("size(at) > 1")
            out = without(out, each.select(self.key, F.explode(F.expr("slice(at, 1, size(at) - 1)")).alias("at")), [self.key, "at"])
        out = out.drop("at")
        if any(int(b) in touched for b in state["base"]):
            out = out.unionByName(without(self._base(state, self.columns, touched).drop("bucket"), keys.select(self.key).distinct(), [self.key]))
        return out, tables

    @staticmethod
    def _touched(state: dict) -> list[int]:
        return sorted({b for delta in state["deltas"] for b in delta["buckets"]})

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets where rows with these values of ``by`` lie."""
        return sorted(r.bucket for r in rows.select(self._bucket(self.state()).alias("bucket")).distinct().collect())

    def read(self, version: int | None = None, columns: list[str] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the latest by default; only ``columns`` if named (the key always), only of some ``buckets``."""
        state, columns = self.state(version), [self.key, *[c for c in columns or self.columns if c != self.key]]
        wanted = lambda b: buckets is None or b in buckets
        touched = [b for b in self._touched(state) if wanted(b)]
        still = [int(b) for b in state["base"] if int(b) not in touched and wanted(int(b))]
        if not touched:
            return self._base(state, columns, still).drop("bucket")
        return self._base(state, columns, still).drop("bucket").unionByName(self._merged(state, columns, touched))

    # ---------------------------------------------------------------- writes

    def write(self, rows: DataFrame, *, batch: int | None = None, gone: DataFrame | None = None) -> bool:
        """Append a delta of rows to put and of keys to take away (with their ``by``); False if this batch was committed before."""
        state = self.state()
        if batch is not None and state["batch"] is not None and batch <= state["batch"]:
            return False
        put = rows.select(self.columns).withColumn("gone", F.lit(False))
        if gone is not None:
            known = [self.key, *({self.by} - {self.key})]
            taken = gone.select(known).distinct().withColumn("gone", F.lit(True))
            put = put.unionByName(taken, allowMissingColumns=True)
        put = materialize(put, "put")
        self._append(state, put, batch)
        discard(put)
        return True

    def _append(self, state: dict, put: DataFrame, batch: int | None) -> None:
        """Write and commit a delta of rows with ``gone`` that lie in a written table."""
        put = put.withColumn("bucket", self._bucket(state))
        require_unique(put, self.key)
        version = state["version"] + 1
        folder = f"delta-{version}-{uuid.uuid4().hex[:8]}"
        put.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        buckets = sorted(r.bucket for r in put.select("bucket").distinct().collect())
        deltas = [*state["deltas"], {"folder": folder, "version": version, "buckets": buckets}] if buckets else state["deltas"]
        self._commit(state | {"version": version, "batch": state["batch"] if batch is None else batch, "deltas": deltas})
        if len(deltas) >= self.compact_after:
            self.compact()

    def delete(self, ids: DataFrame, *, batch: int | None = None) -> bool:
        """Take keys away."""
        return self.write(self.spark.createDataFrame([], self.schema), batch=batch, gone=ids)

    def sync(self, docs: DataFrame, *, overwrite: bool = False, batch: int | None = None) -> DataFrame:
        """docs with ``status``; what was added or updated is written, what is no longer among docs stays."""
        state = self.state()
        if state["base"] or state["deltas"]:
            told = sync_status(docs, self.read(columns=["content_hash"]), overwrite)
        else:  # nothing to compare with: no join
            told = docs.withColumn("status", F.lit("added"))
        status = materialize(told, "status")
        if batch is None or state["batch"] is None or batch > state["batch"]:
            self._append(state, status.where("status <> 'skipped'").select(*self.columns, F.lit(False).alias("gone")), batch)
        return status

    def compact(self) -> None:
        """Rewrite the buckets that deltas touch into a base folder of their own."""
        state = self.state()
        touched = self._touched(state)
        if not touched:
            return
        version = state["version"] + 1
        folder = f"base-{version}-{uuid.uuid4().hex[:8]}"
        rows, tables = self._compacted(state, touched)
        rows.withColumn("bucket", self._bucket(state)).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        discard(*tables)
        fs, at = self._fs(folder)
        full = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(at)} if fs.exists(at) else set()
        base = {b: f for b, f in state["base"].items() if int(b) not in touched} | {str(b): folder for b in touched if str(b) in full}
        self._commit(state | {"version": version, "base": base, "deltas": []})

    def vacuum(self) -> list[str]:
        """Delete the folders and versions that the latest version does not need; their names."""
        state = self.state()
        needed = {*state["base"].values(), *(d["folder"] for d in state["deltas"])}
        fs, at = self._fs()
        found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in needed | {"_log"}]
        fs, log = self._fs("_log")
        found += [s.getPath() for s in fs.listStatus(log) if s.getPath().getName() != f"{state['version']:020}.json"]
        for path in found:
            fs.delete(path, True)
        return sorted(p.getName() for p in found)
