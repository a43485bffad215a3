"""Records as served entries: definitions, JSON rows, relationships, validation, export."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.schema import RecordSchema, resolve
from quarry.sources.store import RecordStore

FULLTYPES = {
    T.BooleanType: "boolean",
    T.LongType: "integer",
    T.IntegerType: "integer",
    T.DoubleType: "float",
    T.StringType: "string",
    T.TimestampType: "timestamp",
    T.BinaryType: "string",
}


def fulltype(kind: T.DataType) -> str:
    """Name of a column type in served definitions."""
    if isinstance(kind, T.ArrayType):
        return f"list of {fulltype(kind.elementType)}"
    return FULLTYPES[type(kind)]


def definition(schema: RecordSchema, prefix: str = "") -> dict[str, dict[str, Any]]:
    """Property definitions of a class, without references."""
    out = {"id": {"type": "string", "nullable": False}, "type": {"type": "string", "nullable": False}}
    for f in schema.fields:
        if f.role not in ("reference", "child_reference"):
            out[prefix + f.name] = {"type": fulltype(f.columns[0].dataType), "nullable": f.nullable}
    return out


COMPARED = ("=", "!=", "<", "<=", ">", ">=")


def query_capabilities(schema: RecordSchema, prefix: str = "") -> dict[str, dict[str, Any]]:
    """Of each property of a class, the operators that filters can use, and whether pages can be sorted by it."""
    out: dict[str, dict[str, Any]] = {"id": {"operators": ["=", "!="], "sortable": True}}
    for name, rule in definition(schema, prefix).items():
        if name in ("id", "type"):
            continue
        kind = rule["type"]
        if kind.startswith("list of list"):  # tensors can't be queried
            operators: list[str] = []
        elif kind.startswith("list of "):
            operators = ["HAS", "HAS ALL", "HAS ANY", "HAS ONLY", "LENGTH"]
        elif kind == "boolean":
            operators = ["=", "!="]
        else:
            operators = [*COMPARED, *(("CONTAINS", "STARTS WITH", "ENDS WITH") if kind == "string" else ())]
        known = ["IS KNOWN", "IS UNKNOWN"] if operators else []
        out[name] = {"operators": operators + known, "sortable": bool(operators) and not kind.startswith("list")}
    return out


class StoreEntryProvider:
    """Serves record classes of a store as entries ``{id, type, properties, relationships}``."""

    def __init__(
        self,
        store: RecordStore,
        classes: Mapping[str, type],
        *,
        prefix: str = "",
        only_latest: bool = False,
        links: Mapping[str, Sequence[tuple[type, str, str]]] | None = None,
    ):
        self.store, self.classes, self.prefix, self.only_latest = store, dict(classes), prefix, only_latest
        self.links = dict(links or {})  # entry type -> (link class, field of this entry, field of the other)
        self._types = {cls: name for name, cls in self.classes.items()}

    def entry_types(self) -> dict[str, dict[str, dict[str, Any]]]:
        return {name: definition(resolve(cls), self.prefix) for name, cls in self.classes.items()}

    def property_keys(self, entry_type: str) -> list[str]:
        return list(definition(resolve(self.classes[entry_type]), self.prefix))

    def _rows(self, cls: type) -> DataFrame:
        s = self.store.searcher(only_latest=self.only_latest)
        v = s.variable(cls)
        keys = s.results(sid=v.sid).to_frame()
        rows = self.store.table(cls)
        return rows.join(keys, "sid", "left_semi") if self.only_latest else rows

    def frame(self, entry_type: str, fields: Sequence[str] | None = None) -> DataFrame:
        """(id, type, properties JSON) rows; columns that aren't asked for are never read."""
        cls = self.classes[entry_type]
        wanted = [
            F.col(f.columns[0].name).alias(self.prefix + f.name)
            for f in resolve(cls).fields
            if f.role not in ("reference", "child_reference") and (fields is None or f.name in fields)
        ]
        body = F.to_json(F.struct(*wanted), {"ignoreNullFields": "false"}) if wanted else F.lit("{}")
        return self._rows(cls).select(self._id(entry_type, F.col("sid")).alias("id"), F.lit(entry_type).alias("type"), body.alias("properties"))

    @staticmethod
    def _id(entry_type: str, sid: Any) -> Any:
        return F.concat(F.lit(f"{entry_type}-"), sid.cast("string"))

    def records(self, entry_type: str, fields: Sequence[str] | None = None) -> Iterator[dict[str, Any]]:
        for r in self.frame(entry_type, fields).toLocalIterator():
            yield {"id": r.id, "type": r.type, **json.loads(r.properties)}

    def relationships(self, entry_type: str) -> DataFrame:
        """(id, target_type, target_ids in order of first mention) over references, lists of records and link classes."""
        cls = self.classes[entry_type]
        rows = self._rows(cls)
        found: DataFrame | None = None

        def add(frame: DataFrame, target: type) -> None:
            nonlocal found
            name = self._types[target]
            part = frame.select("sid", F.lit(name).alias("target_type"), "place", self._id(name, F.col("to")).alias("target"))
            part = part.filter("target is not null")
            found = part if found is None else found.unionByName(part)

        for n, f in enumerate(resolve(cls).fields):
            if f.kind not in self._types or f.role not in ("reference", "child_reference"):
                continue
            if f.role == "reference":
                add(rows.select("sid", F.struct(F.lit(n), F.lit(0).cast("long").alias("at")).alias("place"), F.col(f"{f.name}_sid").alias("to")), f.kind)
            else:
                each = rows.select("sid", F.posexplode(f"{f.name}_sids").alias("at", "to"))
                add(each.select("sid", F.struct(F.lit(n), F.col("at").cast("long").alias("at")).alias("place"), "to"), f.kind)
        for link, mine, other in self.links.get(entry_type, ()):
            table = self.store.table(link)
            place = F.struct(F.lit(1 << 20), F.col("sid").alias("at"))
            add(table.select(F.col(f"{mine}_sid").alias("me"), place.alias("place"), F.col(f"{other}_sid").alias("to")).withColumnRenamed("me", "sid"), resolve(link).field(other).kind)
        if found is None:
            return self.store.spark.createDataFrame([], "id string, target_type string, target_ids array<string>")
        firsts = found.groupBy("sid", "target_type", "target").agg(F.min("place").alias("place"))
        lists = firsts.groupBy("sid", "target_type").agg(F.sort_array(F.collect_list(F.struct("place", "target"))).alias("found"))
        return lists.select(self._id(entry_type, F.col("sid")).alias("id"), "target_type", F.transform("found", lambda x: x["target"]).alias("target_ids"))


class FrameEntryProvider:
    """Serves plain records, given in memory, as entries."""

    def __init__(self, spark: SparkSession, entry_type: str, records: Sequence[Mapping[str, Any]], definitions: Mapping[str, dict], id_of: Callable = lambda r: r["id"]):
        self.spark, self.entry_type, self.definitions, self.id_of = spark, entry_type, dict(definitions), id_of
        self._records = [dict(r) for r in records]
        for r in self._records:
            validate_record(r, self.definitions)

    def entry_types(self) -> dict[str, dict]:
        return {self.entry_type: self.definitions}

    def records(self) -> Iterator[dict[str, Any]]:
        for r in self._records:
            yield {"id": self.id_of(r), "type": self.entry_type, **r}

    def frame(self) -> DataFrame:
        rows = [(self.id_of(r), self.entry_type, json.dumps(r, default=str)) for r in self._records]
        return self.spark.createDataFrame(rows, "id string, type string, properties string")


class ValidationError(ValueError):
    """A record that doesn't fit its property definitions."""


def fits(value: Any, kind: str) -> bool:
    if kind.startswith("list of "):
        return isinstance(value, (list, tuple)) and all(v is None or fits(v, kind[8:]) for v in value)
    if isinstance(value, bool):
        return kind == "boolean"
    return {
        "integer": isinstance(value, int),
        "float": isinstance(value, (int, float)),
        "string": isinstance(value, str),
        "timestamp": isinstance(value, str) and re.fullmatch(r"\d{4}-\d\d-\d\d[T ][\d:.]+(Z|[+-]\d\d:\d\d)?", value) is not None,
        "dictionary": isinstance(value, Mapping),
    }.get(kind, False)


def validate_property(name: str, value: Any, definitions: Mapping[str, dict]) -> None:
    if name not in definitions:
        raise ValidationError(f"unknown property {name}")
    rule = definitions[name]
    if value is None:
        if not rule.get("nullable", True):
            raise ValidationError(f"{name} can't be null")
    elif not fits(value, rule["type"]):
        raise ValidationError(f"{name}: {value!r} isn't of type {rule['type']}")
    elif "enum" in rule and value not in rule["enum"]:
        raise ValidationError(f"{name}: {value!r} isn't allowed")


def validate_record(record: Mapping[str, Any], definitions: Mapping[str, dict]) -> None:
    for name, rule in definitions.items():
        if not rule.get("nullable", True) and record.get(name) is None and name not in ("id", "type"):
            raise ValidationError(f"{name} is missing")
    for name, value in record.items():
        validate_property(name, value, definitions)


def export_dataset(provider: StoreEntryProvider, folder: str) -> dict[str, Any]:
    """Write entries, relationships and definitions below ``folder`` (a URI of a shared store); returns the manifest."""
    from quarry.sources import files

    manifest: dict[str, Any] = {"format": 1, "entries": {}, "definitions": provider.entry_types()}
    for name in provider.classes:
        provider.frame(name).write.parquet(f"{folder}/{name}")
        provider.relationships(name).write.parquet(f"{folder}/{name}.relationships")
        manifest["entries"][name] = provider.store.spark.read.parquet(f"{folder}/{name}").count()
    files.create_text(provider.store.spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def zip_folder(folder: Path, target: Path) -> None:
    """Pack a locally visible export into one file."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_STORED) as out:
        for path in sorted(p for p in folder.rglob("*") if p.is_file()):
            out.write(path, path.relative_to(folder))


def product_relationships(links: DataFrame, source: str, label: str, target: str) -> DataFrame:
    """(source, targets by label) of link rows; a label that a source uses twice is an error in ``repeated``."""
    counted = links.groupBy(source, label).agg(F.min(target).alias("target"), F.count(F.lit(1)).alias("n"))
    return counted.groupBy(source).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "target")))).alias("targets"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col(label)))).alias("repeated"),
    )
