"""The record store: versioned Parquet tables of record classes.

A commit writes new files for the tables that it changes, then creates the next
version's manifest, a file that only one writer can create.  Readers see the
newest complete manifest, so a commit is visible whole or not at all.
"""

from __future__ import annotations

import functools
import itertools
import json
import time
import uuid
import weakref
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import dataflow
from quarry.operators.results import MOST_ROWS
from quarry.operators.searcher import Searcher, instant
from quarry.plans.relation import Child, Relation
from quarry.schema import FieldSpec, IdentitySkip, RecordSchema, Unique, resolve
from quarry.sources import files
from quarry.sources.canonical import identity_column
from quarry.sources.encoding import Encoder, decode

RESOLUTION = 1000
#: Keys of at most this number are broadcast: 16 bytes each.
BROADCAST_KEYS = 500_000
CLOCK_GRACE_NS = 1_000_000


class MetadataConflict(ValueError):
    """Records of one identity that disagree in fields outside it."""


class ReplacementError(ValueError):
    """A replacement that is already stored in another lineage."""


class ConcurrentCommit(RuntimeError):
    """Another writer committed first; nothing was changed."""


class LayoutError(ValueError):
    """The stored tables don't have the shape of the classes."""


class IntegrityError(RuntimeError):
    """What was written isn't what was staged; nothing was committed."""


class RecordStore:
    """Stores object graphs of frozen dataclasses below ``root``, a path or URI of a shared folder."""

    def __init__(self, spark: SparkSession, root: str, *, upgrade: bool = False):
        self.spark, self.root, self.upgrade = spark, root.rstrip("/"), upgrade
        #: Records that someone still holds: a key gives the same object again.
        self._known: weakref.WeakValueDictionary[tuple[type, int], Any] = weakref.WeakValueDictionary()

    # -- versions ---------------------------------------------------------

    def version(self) -> int:
        found = [int(n[:-5]) for n in files.names(self.spark, f"{self.root}/versions") if n.endswith(".json")]
        return max(found, default=0)

    def manifest(self) -> dict[str, Any]:
        n = self.version()
        if not n:
            return {"tables": {}, "stamp": 0}
        return json.loads(files.read_text(self.spark, f"{self.root}/versions/{n:010d}.json"))

    def _commit(self, base: int, manifest: dict[str, Any]) -> None:
        if not files.create_text(self.spark, f"{self.root}/versions/{base + 1:010d}.json", json.dumps(manifest)):
            raise ConcurrentCommit(f"version {base + 1} exists")

    def create(self, classes: Sequence[type]) -> None:
        """Create the tables of ``classes``, and of what they refer to, that don't exist yet; as one commit."""
        base, manifest = self.version(), self.manifest()
        tables, queue = dict(manifest["tables"]), list(classes)
        while queue:
            schema = resolve(queue.pop())
            if schema.name not in tables:
                tables[schema.name] = {"paths": [], "columns": schema.fingerprint, "last_sid": 0}
                queue += schema.references
        if tables != manifest["tables"]:
            self._commit(base, manifest | {"tables": tables})

    def catalog(self) -> DataFrame:
        """(table, column, type, folders, last_sid): what is stored, without reading it."""
        rows = [
            (name, *column.split(":", 1), len(entry["paths"]), entry["last_sid"])
            for name, entry in sorted(self.manifest()["tables"].items())
            for column in entry["columns"]
        ]
        return self.spark.createDataFrame(rows, "table string, column string, type string, folders int, last_sid long")

    @staticmethod
    def capabilities() -> dict[str, Any]:
        """What a store can do; one profile, as there is one kind of store."""
        return {
            "transactions": "whole commits, one writer",
            "timestamps": True,
            "timestamp_resolution_ns": RESOLUTION,
            "history": True,
            "exact_rationals": True,
            "largest_page": MOST_ROWS,
        }

    # -- reading ----------------------------------------------------------

    def table(self, cls: type) -> DataFrame:
        """The rows of a class; a class that was never stored has none."""
        schema = resolve(cls)
        entry = self.manifest()["tables"].get(schema.name)
        if entry is None:
            return self.spark.createDataFrame([], schema.struct)
        self._verify(schema, entry)
        if not entry["paths"]:
            return self.spark.createDataFrame([], schema.struct)
        rows = self.spark.read.schema(schema.struct).parquet(*[f"{self.root}/{p}" for p in entry["paths"]])
        if not entry.get("promoted"):
            return rows
        # Dependencies that were saved as roots later on; compact() takes this into the table.
        raised = self.spark.read.schema("sid long").parquet(*[f"{self.root}/{p}" for p in entry["promoted"]])
        raised = raised.select(F.col("sid").alias("_q_raised")).distinct()
        raised = F.broadcast(raised) if entry["promoted_rows"] <= BROADCAST_KEYS else raised
        role = F.when(F.col("_q_raised").isNotNull(), F.lit(1)).otherwise(F.col("role"))
        joined = rows.join(raised, F.col("sid") == F.col("_q_raised"), "left").withColumn("role", role)
        return joined.select(*schema.struct.names)

    def _verify(self, schema: RecordSchema, entry: dict[str, Any]) -> None:
        stored, now = entry["columns"], schema.fingerprint
        if stored == now:
            return
        added = [c for c in now if c not in stored]
        optional = {c.name for f in schema.fields if f.nullable and f.marked(IdentitySkip) for c in f.columns}
        if not self.upgrade or [c for c in stored if c not in now] or {c.split(":")[0] for c in added} - optional:
            raise LayoutError(f"{schema.name}: stored as {stored}, declared as {now}")

    def relation(self, cls: type) -> Relation:
        schema = resolve(cls)
        fields, exact, references, children, opaque, presence = {}, {}, {}, {}, set(), {}
        for f in schema.fields:
            names = [c.name for c in f.columns]
            if f.role in ("scalar", "encoded"):
                fields[f.name] = names[0]
                if f.role == "encoded" and f.codec.exact:
                    exact[f.name] = f.name + f.codec.exact
            elif f.role == "tensor":
                opaque.add(f.name)
            elif f.role == "reference":
                references[f.name] = (names[0], lambda kind=f.kind: self.relation(kind))
            elif f.role == "child_reference":
                target = lambda kind=f.kind: self.relation(kind)
                children[f.name] = Child(f.name, inline=names[0], value="value", target=target)
            else:
                children[f.name] = Child(f.name, inline=names[0], value="value")
            if f.nullable and f.role.startswith("child"):
                presence[f"{f.name}_present"] = names[0]
        return Relation(
            schema.name,
            lambda: self.table(cls),
            "sid",
            fields,
            references,
            children,
            exact,
            "store_timestamp",
            "logical_id",
            lambda name, v: self._operand(schema.field(name), v),
            lambda sid: self.fetch(cls, sid),
            frozenset(opaque),
            presence,
            "identity" if schema.dedup == "content_id" else None,
            RESOLUTION,
            lambda sids: self.fetch_many(cls, sids),
        )

    @staticmethod
    def _operand(f: FieldSpec, value: Any) -> Any:
        if f.codec is not None:
            return f.codec.query(value)
        return getattr(value, "_quarry_sid", value)

    def searcher(self, *, as_of: Any = None, only_latest: bool = False) -> StoreSearcher:
        return StoreSearcher(self, None if as_of is None else instant(as_of, RESOLUTION), only_latest)

    def fetch(self, cls: type, sid: int) -> Any:
        return self.fetch_many(cls, [sid])[0]

    def fetch_many(self, cls: type, sids: Sequence[int]) -> list[Any]:
        """Records by key, in order; all records that they refer to come in one read for each class and level."""
        got = {(cls, s): known for s in sids if (known := self._known.get((cls, s))) is not None}
        if wanted := {s for s in sids if (cls, s) not in got}:
            got |= self._load({cls: wanted})
        if missing := [s for s in sids if (cls, s) not in got]:
            raise KeyError(missing)
        return [got[cls, s] for s in sids]

    def _load(self, wanted: Mapping[type, set[int]]) -> dict[tuple[type, int], Any]:
        rows: dict[tuple[type, int], dict] = {}
        made: dict[tuple[type, int], Any] = dict(self._known)
        queue = {k: set(v) for k, v in wanted.items()}
        while queue:
            ahead: dict[type, set[int]] = {}
            for cls, sids in queue.items():
                schema = resolve(cls)
                for r in self.table(cls).filter(F.col("sid").isin(sorted(sids))).collect():
                    rows[cls, r.sid] = row = r.asDict()
                    for f in schema.fields:
                        if f.role == "reference" and row[f"{f.name}_sid"] is not None:
                            ahead.setdefault(f.kind, set()).add(row[f"{f.name}_sid"])
                        elif f.role == "child_reference" and row[f"{f.name}_sids"]:
                            ahead.setdefault(f.kind, set()).update(row[f"{f.name}_sids"])
            queue = {k: left for k, v in ahead.items() if (left := {s for s in v if (k, s) not in rows and (k, s) not in made})}

        def fetch(cls: type, sid: int) -> Any:
            if (cls, sid) not in made:
                made[cls, sid] = self._known[cls, sid] = decode(resolve(cls), rows[cls, sid], fetch)
            return made[cls, sid]

        return {key: fetch(*key) for key in rows}

    def fetch_by_content_id(self, cls: type, content_id: str) -> Any:
        if resolve(cls).dedup != "content_id":
            raise ValueError(f"{cls.__name__} has no content ids")
        rows = self.table(cls).filter(F.col("identity") == content_id).select("sid").take(1)
        if not rows:
            raise KeyError(content_id)
        return self.fetch(cls, rows[0].sid)

    def dispatch(self, family: Sequence[type]) -> DataFrame:
        """(content_id, backing, sid) of the records of a family: classes that back entries of one kind."""
        parts = [self.table(cls).select(F.col("identity").alias("content_id"), F.lit(resolve(cls).name).alias("backing"), "sid") for cls in family]
        if wrong := [cls.__name__ for cls in family if resolve(cls).dedup != "content_id"]:
            raise ValueError(f"no content ids: {wrong}")
        return functools.reduce(DataFrame.unionByName, parts)

    def fetch_entry(self, family: Sequence[type], content_id: str) -> Any:
        """The record of a family under a content id; more than one is an IntegrityError."""
        rows = self.dispatch(family).filter(F.col("content_id") == content_id).take(2)
        if not rows:
            raise KeyError(content_id)
        if len(rows) > 1:
            raise IntegrityError(f"{content_id} has several records: {[(r.backing, r.sid) for r in rows]}")
        return self.fetch(next(cls for cls in family if resolve(cls).name == rows[0].backing), rows[0].sid)

    def content_id(self, obj: Any) -> str:
        return Encoder().add(obj)

    def sid_of(self, obj: Any) -> int | None:
        rows = self.table(type(obj)).filter(F.col("identity") == self.content_id(obj)).select("sid").take(1)
        return rows[0].sid if rows else None

    def referring(self, cls: type, field: str, to: Any) -> list[Any]:
        """Records of ``cls`` whose reference ``field`` is ``to``, in the order of their keys."""
        sid = to if isinstance(to, int) else self.sid_of(to)
        rows = self.table(cls).filter(F.col(f"{field}_sid") == sid).orderBy("sid").select("sid").collect()
        return self.fetch_many(cls, [r.sid for r in rows]) if rows else []

    # -- writing ----------------------------------------------------------

    def save(self, obj: Any, *, promote: tuple[type, ...] = ()) -> int:
        return self.bulk_ingest([obj], promote=promote)[0]

    def bulk_ingest(
        self,
        objects: Iterable[Any],
        *,
        verify_metadata: bool = True,
        chunk_size: int = 100_000,
        track_sids: bool = True,
        progress: Callable[[int], None] | None = None,
        promote: tuple[type, ...] = (),
    ) -> list[int]:
        """Save objects with all that they refer to; keys in their order.  All or nothing is committed.

        The driver holds ``chunk_size`` objects' graphs at a time; earlier ones are
        staged in the store's folder.  Without ``track_sids`` no keys are returned.
        ``progress`` gets the number of objects so far after each chunk.  Nested
        records of the classes ``promote`` are saved as roots.
        """
        work = f"work/{uuid.uuid4().hex}"
        counts: dict[type, int] = {}
        frames: dict[type, DataFrame] = {}
        keys: list[tuple[type, str]] = []
        objects, done = iter(objects), 0
        try:
            while chunk := list(itertools.islice(objects, chunk_size)):
                encoder = Encoder(counts, tuple(promote))
                own = [(type(obj), encoder.add(obj)) for obj in chunk]
                if encoder.conflicts and verify_metadata:
                    raise MetadataConflict(str(encoder.conflicts[:5]))
                whole = not done and len(chunk) < chunk_size  # the only chunk: nothing to stage
                for cls, rows in encoder.rows.items():
                    schema = resolve(cls)
                    counts[cls] = counts.get(cls, 0) + len(rows)
                    frames[cls] = self.spark.createDataFrame(list(rows.values()), staged(schema))
                    if not whole:
                        path = f"{self.root}/{work}/{schema.name}"
                        frames[cls].write.mode("append").parquet(path)
                        frames[cls] = self.spark.read.schema(staged(schema)).parquet(path)
                keys += own if track_sids else []
                done += len(chunk)
                if progress is not None:
                    progress(done)
            maps = self._ingest(frames, verify_metadata) if frames else {}
            found: dict[tuple[type, str], int] = {}
            for cls in {k for k, _ in keys}:
                wanted = self.spark.createDataFrame([(i,) for k, i in keys if k is cls], "identity string").distinct()
                found.update({(cls, r.identity): r.sid for r in maps[cls].join(wanted, "identity").collect()})
        finally:
            files.delete(self.spark, f"{self.root}/{work}")
        return [found[k] for k in keys]

    def ingest_frame(self, cls: type, rows: DataFrame, *, verify_metadata: bool = True) -> DataFrame:
        """Save a DataFrame of records without nested objects, set-wise; returns (identity, sid).

        ``rows`` has the columns of the class's fields, references by key.  No row
        passes through the driver.
        """
        schema = resolve(cls)
        columns = [c for f in schema.fields for c in f.columns]
        typed = rows.select(*[F.col(c.name).cast(c.dataType) for c in columns])
        stage = self._identified(schema, typed).withColumn("role", F.lit(1)).withColumn("ordinal", F.xxhash64("identity"))
        return self._ingest({cls: stage}, verify_metadata, resolved=True)[cls]

    def ingest_arrow(self, cls: type, data: pa.Table | pa.RecordBatchReader, *, verify_metadata: bool = True) -> DataFrame:
        """As ingest_frame(), from Arrow data on the driver."""
        table = data if isinstance(data, pa.Table) else data.read_all()
        return self.ingest_frame(cls, self.spark.createDataFrame(table), verify_metadata=verify_metadata)

    def _identified(self, schema: RecordSchema, rows: DataFrame) -> DataFrame:
        """``rows``, whose references are keys, with the identity that the same objects would get."""
        if schema.dedup == "none":
            return rows.withColumn("identity", F.concat(F.lit("new-"), F.uuid()))
        names = rows.columns
        held = {}
        referring = [f for f in schema.identity_fields if f.role in ("reference", "child_reference")]
        if any(f.role == "child_reference" for f in referring):
            rows = self._written(rows.withColumn("_q_row", F.monotonically_increasing_id()), f"work/{uuid.uuid4().hex}")
        for n, f in enumerate(referring):
            column, own = f.columns[0].name, f"_q_of{n}"
            target = self.table(f.kind).select(F.col("sid").alias("_q_sid"), F.col("identity").alias(own))
            if f.role == "reference":
                rows = rows.join(target, F.col(column) == F.col("_q_sid"), "left").drop("_q_sid")
            else:
                each = rows.select("_q_row", F.posexplode(column).alias("_q_at", "_q_to")).join(target, F.col("_q_to") == F.col("_q_sid"), "left")
                lists = each.groupBy("_q_row").agg(F.sort_array(F.collect_list(F.struct("_q_at", own))).alias("_q_list"))
                empty = F.when(F.col(column).isNotNull(), F.array().cast("array<string>"))
                rows = rows.join(lists, "_q_row", "left").withColumn(own, F.coalesce(F.transform("_q_list", lambda x: x[own]), empty)).drop("_q_list")
            held[column] = own
        cells = [(name, F.col(held.get(name, name)), kind) for f in schema.identity_fields for name, kind in f.identity_cells]
        return rows.withColumn("identity", identity_column(schema.identity_head, cells)).select(*names, "identity")

    def _ingest(
        self, stages: dict[type, DataFrame], verify: bool, resolved: bool = False, lineage: tuple[type, str, int] | None = None
    ) -> dict[type, DataFrame]:
        """Commit staged rows and return (identity, sid) of all of them by class.

        Rows whose identity is stored stay as they are, but for the role of one that
        now comes as a root.  ``lineage`` puts a new record (class, identity) into one.
        """
        base = self.version()
        manifest = self.manifest()
        now = time.time_ns()
        if now < manifest["stamp"] - CLOCK_GRACE_NS:
            raise RuntimeError("the clock is behind the store's last commit")
        stamp = max(now, manifest["stamp"])
        commit = f"data/{base + 1:010d}-{uuid.uuid4().hex}"
        maps: dict[type, DataFrame] = {}
        fresh: dict[type, DataFrame] = {}
        promoted: dict[str, tuple[str, int]] = {}
        for cls, stage in stages.items():
            schema = resolve(cls)
            stage = self._written(stage, f"{commit}/stage/{schema.name}")
            skipped = [c.name for f in schema.fields if f.marked(IdentitySkip) for c in f.columns]
            stored = self.table(cls)
            if verify and skipped:
                both = stage.select("identity", *skipped)
                if not resolved:
                    both = both.drop(*[c for c in skipped if c.endswith(("_sid", "_sids"))])
                known = stored.join(stage.select("identity"), "identity", "left_semi").select(*both.columns)
                wrong = dataflow.metadata_conflicts(both.unionByName(known), "identity", [c for c in both.columns if c != "identity"])
                if bad := wrong.take(3):
                    raise MetadataConflict(f"{schema.name}: {[r.identity for r in bad]}")
            plain = [F.first(c).alias(c) for c in stage.columns if c not in ("identity", "role", "ordinal")]
            firsts = stage.groupBy("identity").agg(F.max("role").alias("role"), F.min("ordinal").alias("ordinal"), *plain)
            known = stored.select("identity", "sid")
            new = self._written(firsts.join(known, "identity", "left_anti"), f"{commit}/new/{schema.name}")
            last = manifest["tables"].get(schema.name, {}).get("last_sid", 0)
            numbered = dataflow.dense_numbers(new, "ordinal", "n").withColumn("sid", F.col("n") + last).drop("n", "ordinal")
            fresh[cls] = self._written(numbered, f"{commit}/numbered/{schema.name}")
            mine = firsts.select("identity", F.col("role").alias("_q_role"))
            met = self._written(stored.select("identity", "sid", "role").join(mine, "identity"), f"{commit}/met/{schema.name}")
            raised = met.filter("_q_role > role").select("sid")
            if n := raised.count():
                raised.write.parquet(f"{self.root}/{commit}/raised/{schema.name}")
                promoted[schema.name] = f"{commit}/raised/{schema.name}", n
            maps[cls] = fresh[cls].select("identity", "sid").unionByName(met.select("identity", "sid"))
        tables = dict(manifest["tables"])
        for name, (path, n) in promoted.items():
            entry = tables[name]
            tables[name] = entry | {"promoted": [*entry.get("promoted", []), path], "promoted_rows": entry.get("promoted_rows", 0) + n}
        for cls, rows in fresh.items():
            schema = resolve(cls)
            staged_rows = rows.count()
            if not staged_rows:
                continue
            if not resolved:
                rows = self._resolved(schema, rows, maps)
            logical = F.col("sid")
            if lineage is not None and cls is lineage[0]:
                logical = F.when(F.col("identity") == lineage[1], F.lit(lineage[2])).otherwise(logical)
            rows = rows.withColumns({"store_timestamp": F.lit(stamp // RESOLUTION), "logical_id": logical})
            path = f"{commit}/{schema.name}"
            rows.select(*[F.col(c.name).cast(c.dataType) for c in schema.struct]).write.parquet(f"{self.root}/{path}")
            entry = tables.get(schema.name, {"paths": [], "last_sid": 0})
            count = self.spark.read.parquet(f"{self.root}/{path}").count()
            if count != staged_rows:
                raise IntegrityError(f"{schema.name}: {count} rows written of {staged_rows}")
            tables[schema.name] = entry | {"paths": [*entry["paths"], path], "columns": schema.fingerprint, "last_sid": entry["last_sid"] + count}
        if tables != manifest["tables"]:
            self._commit(base, {"tables": tables, "stamp": stamp})
        for part in ("stage", "new"):  # what the maps read stays until vacuum()
            files.delete(self.spark, f"{self.root}/{commit}/{part}")
        return maps

    def _written(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(f"{self.root}/{path}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{path}")

    def _resolved(self, schema: RecordSchema, rows: DataFrame, maps: dict[type, DataFrame]) -> DataFrame:
        """Identities in reference columns replaced by keys."""
        for f in schema.fields:
            if f.role == "reference":
                column = f"{f.name}_sid"
                target = maps.get(f.kind)
                if target is None:
                    rows = rows.withColumn(column, F.lit(None).cast("long"))
                    continue
                target = target.select(F.col("identity").alias("_q_id"), F.col("sid").alias("_q_sid"))
                rows = rows.join(target, F.col(column) == F.col("_q_id"), "left").withColumn(column, F.col("_q_sid")).drop("_q_id", "_q_sid")
            elif f.role == "child_reference":
                column = f"{f.name}_sids"
                target = maps.get(f.kind)
                if target is None:
                    rows = rows.withColumn(column, F.col(column).cast("array<long>"))
                    continue
                each = rows.select("sid", F.posexplode(column).alias("_q_at", "identity")).join(target.withColumnRenamed("sid", "_q_sid"), "identity")
                lists = each.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("_q_at", "_q_sid"))).alias("_q_list"))
                empty = F.when(F.col(column).isNotNull(), F.array().cast("array<long>"))
                value = F.coalesce(F.transform("_q_list", lambda x: x["_q_sid"]), empty)
                rows = rows.join(lists, "sid", "left").withColumn(column, value).drop("_q_list")
        return rows

    def replace(self, old: Any, new: Any) -> int:
        """Save ``new`` as the next record of the lineage of ``old`` (a record or key)."""
        cls = type(new)
        sid = old if isinstance(old, int) else self.sid_of(old)
        rows = self.table(cls).filter(F.col("sid") == sid).select("logical_id").take(1)
        if not rows:
            raise KeyError(sid)
        encoder = Encoder()
        identity = encoder.add(new)
        stored = self.table(cls).filter(F.col("identity") == identity).select("sid", "logical_id").take(1)
        if stored:
            if stored[0].logical_id != rows[0].logical_id:
                raise ReplacementError(f"{schema_name(cls)} {stored[0].sid} belongs to another lineage")
            return stored[0].sid
        frames = {k: self.spark.createDataFrame(list(v.values()), staged(resolve(k))) for k, v in encoder.rows.items()}
        made = self._ingest(frames, True, lineage=(cls, identity, rows[0].logical_id))
        return made[cls].filter(F.col("identity") == identity).first().sid

    def history(self, obj: Any) -> list[Any]:
        """All records of an object's lineage, oldest first."""
        cls, sid = (type(obj), self.sid_of(obj)) if not isinstance(obj, tuple) else obj
        table = self.table(cls)
        lineage = table.filter(F.col("sid") == sid).select(F.col("logical_id").alias("of"))
        sids = [r.sid for r in table.join(F.broadcast(lineage), F.col("logical_id") == F.col("of")).orderBy("sid").select("sid").collect()]
        return self.fetch_many(cls, sids)

    # -- integrity --------------------------------------------------------

    def fsck(self, classes: Sequence[type]) -> dict[str, DataFrame]:
        """Findings by name, each a DataFrame of the keys concerned."""
        out: dict[str, DataFrame] = {}
        horizon = (time.time_ns() + 2_000_000_000) // RESOLUTION
        for cls in classes:
            schema, rows = resolve(cls), self.table(cls)
            name = schema.name
            out[f"{name}: repeated keys"] = dataflow.repeated_keys(rows, ["sid"])
            if schema.dedup != "none":
                out[f"{name}: repeated identities"] = dataflow.repeated_keys(rows, ["identity"])
            out[f"{name}: bad roles"] = rows.filter(~F.col("role").isin(0, 1)).select("sid")
            out[f"{name}: future timestamps"] = rows.filter(F.col("store_timestamp") > horizon).select("sid")
            for f in schema.fields:
                if f.marked(Unique):
                    repeated = rows.filter(F.col(f.columns[0].name).isNotNull())
                    out[f"{name}.{f.name}: repeated values"] = dataflow.repeated_keys(repeated, [f.columns[0].name])
                if f.role == "reference":
                    used = rows.select("sid", F.col(f"{f.name}_sid").alias("to"))
                elif f.role == "child_reference":
                    used = rows.select("sid", F.explode(f"{f.name}_sids").alias("to"))
                else:
                    continue
                used = used.filter("to is not null")
                out[f"{name}.{f.name}: dangling"] = dataflow.unreferenced(used, "to", self.table(f.kind), "sid")
        return out

    def unreachable(self, classes: Sequence[type]) -> dict[str, DataFrame]:
        """Dependency rows (role 0) that no root reaches, by class."""
        nodes, edges = None, None
        for cls in classes:
            schema, rows = resolve(cls), self.table(cls)
            label = lambda kind, c: F.concat(F.lit(resolve(kind).name + ":"), c.cast("string"))
            roots = rows.filter("role = 1").select(label(cls, F.col("sid")).alias("sid"))
            nodes = roots if nodes is None else nodes.unionByName(roots)
            for f in schema.fields:
                if f.role == "reference":
                    used = rows.select(label(cls, F.col("sid")).alias("source"), label(f.kind, F.col(f"{f.name}_sid")).alias("target"))
                elif f.role == "child_reference":
                    used = rows.select(label(cls, F.col("sid")).alias("source"), F.explode(f"{f.name}_sids").alias("to"))
                    used = used.select("source", label(f.kind, F.col("to")).alias("target"))
                else:
                    continue
                edges = used if edges is None else edges.unionByName(used)
        if edges is None:
            seen = nodes
        else:
            work = f"work/{uuid.uuid4().hex}"
            steps = iter(range(1 << 30))
            seen = dataflow.reachable(nodes, edges.filter("target is not null"), lambda df: self._written(df, f"{work}/{next(steps)}"))
        out = {}
        for cls in classes:
            name = resolve(cls).name
            mine = seen.filter(F.col("sid").startswith(f"{name}:")).select(F.substring_index("sid", ":", -1).cast("long").alias("seen"))
            out[name] = dataflow.unreferenced(self.table(cls).filter("role = 0"), "sid", mine, "seen").select("sid")
        return out

    def compact(self, cls: type) -> None:
        """Rewrite a class's files as one commit, clustered by key."""
        base, manifest, schema = self.version(), self.manifest(), resolve(cls)
        path = f"data/{base + 1:010d}-{uuid.uuid4().hex}/{schema.name}"
        self.table(cls).sort("sid").write.parquet(f"{self.root}/{path}")
        self._commit(base, manifest | {"tables": manifest["tables"] | {schema.name: _rewritten(manifest, schema, path)}})

    def collect_garbage(self, classes: Sequence[type]) -> dict[str, int]:
        """Delete the dependency rows of ``classes`` that no root reaches, as one commit; their numbers by class.

        ``classes`` must hold every class that refers to one of them.
        """
        base, manifest = self.version(), self.manifest()
        commit = f"data/{base + 1:010d}-{uuid.uuid4().hex}"
        tables, gone = dict(manifest["tables"]), {}
        lost = self.unreachable(classes)
        for cls in classes:
            schema = resolve(cls)
            if not (n := lost[schema.name].count()):
                continue
            path = f"{commit}/{schema.name}"
            self.table(cls).join(lost[schema.name], "sid", "left_anti").write.parquet(f"{self.root}/{path}")
            tables[schema.name], gone[schema.name] = _rewritten(manifest, schema, path), n
        if gone:
            self._commit(base, manifest | {"tables": tables})
            self._known.clear()
        return gone

    def vacuum(self) -> int:
        """Delete files of commits that the newest version doesn't read, and working files; how many folders went.

        Nobody may be writing, or reading an older version.
        """
        used = {p for e in self.manifest()["tables"].values() for p in [*e["paths"], *e.get("promoted", [])]}
        gone = 0
        for commit in files.names(self.spark, f"{self.root}/data"):
            for part in files.names(self.spark, f"{self.root}/data/{commit}"):
                mine = f"data/{commit}/{part}"
                if not any(p == mine or p.startswith(f"{mine}/") for p in used):
                    files.delete(self.spark, f"{self.root}/{mine}")
                    gone += 1
            if not files.names(self.spark, f"{self.root}/data/{commit}"):
                files.delete(self.spark, f"{self.root}/data/{commit}")
        files.delete(self.spark, f"{self.root}/work")
        return gone

    def snapshot_cutoff_ns(self) -> int:
        """The time of the newest commit: a search as of it sees what is stored now, and nothing later."""
        return self.manifest()["stamp"]


def _rewritten(manifest: dict[str, Any], schema: RecordSchema, path: str) -> dict[str, Any]:
    """The entry of a table that ``path`` alone makes up."""
    entry = {k: v for k, v in manifest["tables"][schema.name].items() if not k.startswith("promoted")}
    return entry | {"paths": [path], "columns": schema.fingerprint}


def schema_name(cls: type) -> str:
    return resolve(cls).name


def staged(schema: RecordSchema) -> T.StructType:
    """Columns of encoded rows: like the table's, but references are identities."""
    out = [T.StructField("identity", T.StringType()), T.StructField("role", T.IntegerType()), T.StructField("ordinal", T.LongType())]
    for f in schema.fields:
        for c in f.columns:
            kind = {"reference": T.StringType(), "child_reference": T.ArrayType(T.StringType())}.get(f.role, c.dataType)
            out.append(T.StructField(c.name, kind, True))
    return T.StructType(out)


class StoreSearcher(Searcher):
    """A search whose variables are record classes of a store."""

    def __init__(self, store: RecordStore, as_of: int | None, only_latest: bool):
        super().__init__(as_of, only_latest)
        self._store = store

    def variable(self, target: Any):
        return super().variable(target if isinstance(target, Relation) else self._store.relation(target))
