from __future__ import annotations

import json
from pathlib import Path

import pytest

from quarry.operators import dataflow
from quarry.operators.entries import DuplicateEntryId, EntryFederation, EntrySource, StoredProperty
from quarry.operators.filters import FilterError, Translator, filter_predicate
from quarry.operators.searcher import Searcher
from quarry.schema import resolve
from quarry.sources.files import read_text
from quarry.sources.jdbc import jdbc_relation
from quarry.sources.providers import (
    FrameEntryProvider,
    StoreEntryProvider,
    ValidationError,
    export_dataset,
    product_relationships,
    query_capabilities,
    validate_record,
    zip_folder,
)
from quarry.sources.store import ConcurrentCommit, RecordStore
from quarry.streaming.ingest import ingest_stream
from tests.records import INSPECTIONS, VOYAGES, Cargo, Crate, Inspection, Ship, Voyage


@pytest.fixture(scope="module")
def provider(spark, tmp_path_factory):
    store = RecordStore(spark, f"file://{tmp_path_factory.mktemp('served')}")
    store.bulk_ingest([*VOYAGES[:3], *INSPECTIONS])
    links = {"voyages": [(Inspection, "voyage", "voyage")]}
    return StoreEntryProvider(store, {"voyages": Voyage, "ships": Ship}, links=links)


def test_entries_and_definitions(provider):
    assert provider.entry_types()["voyages"]["ports"] == {"type": "list of string", "nullable": False}
    rows = {r["code"]: r for r in provider.records("voyages")}
    assert rows["V-12"]["ports"] == ["Kiel", "Turku"] and rows["V-12"]["freight"] == -0.5 and rows["V-12"]["type"] == "voyages"
    assert set(next(provider.records("voyages", ["code"]))) == {"id", "type", "code"}
    read = provider.frame("voyages", ["code"])._jdf.queryExecution().executedPlan().toString()
    assert "ports" not in read


def test_query_capabilities():
    got = query_capabilities(resolve(Voyage))
    assert "HAS ONLY" in got["ports"]["operators"] and not got["ports"]["sortable"] and "CONTAINS" in got["code"]["operators"]
    assert got["days"]["sortable"] and "<=" in got["days"]["operators"] and "CONTAINS" not in got["days"]["operators"] and "ship" not in got


def test_relationships_keep_first_mention(provider):
    got = {(r.id, r.target_type): r.target_ids for r in provider.relationships("voyages").collect()}
    assert got["voyages-1", "ships"] == ["ships-1"] and got["voyages-1", "voyages"] == ["voyages-1"]
    assert provider.relationships("ships").count() == 0


def test_export(provider, tmp_path, spark):
    manifest = export_dataset(provider, f"file://{tmp_path}/out")
    assert manifest["entries"] == {"voyages": 3, "ships": 2}
    assert json.loads(read_text(spark, f"file://{tmp_path}/out/manifest.json")) == manifest
    zip_folder(Path(tmp_path / "out"), Path(tmp_path / "out.zip"))
    assert (tmp_path / "out.zip").stat().st_size > 1000


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    one, two = (RecordStore(spark, f"file://{tmp_path_factory.mktemp(n)}") for n in ("one", "two"))
    one.bulk_ingest(VOYAGES[:4])
    two.bulk_ingest([*VOYAGES[4:], VOYAGES[0], Cargo([Crate(1, "p")], "V-99")])
    voyage = {
        "code": StoredProperty("string", lambda v: v.code),
        "days": StoredProperty("integer", lambda v: v.days),
        "weeks": StoredProperty("integer", lambda v: v.days, lambda v, op, n: Translator.operator(v.days, op, 7 * n)),
        "ship": StoredProperty("string", lambda v: v.ship.name),
    }
    cargo = {"code": StoredProperty("string", lambda v: v.bill), "days": StoredProperty("integer", lambda v: v.crates.length()), "ship": StoredProperty("string", lambda v: v.memo)}
    cargo["weeks"] = cargo["days"]
    sources = [EntrySource("one", one, {Voyage: voyage}, "a/"), EntrySource("two", two, {Voyage: voyage, Cargo: cargo}, "b/")]
    return EntryFederation(sources, "trips")


def test_entry_pages_of_several_sources(entries):
    page = entries.query(limit=5)
    assert (page.total, page.more, [r["code"] for r in page.rows]) == (9, True, ["V-11", "V-12", "V-20", "V-21", "W-01"])
    assert [r["code"] for r in entries.query(offset=5).rows] == ["W-02", "W-1%", "V-11", "V-99"]
    by_days = entries.query(sort=[("days", True), ("code", False)], limit=4, fields=["code"])
    assert [r["code"] for r in by_days.rows] == ["V-21", "V-11", "V-11", "W-01"] and set(by_days.rows[0]) == {"id", "type", "code"}
    ships = entries.query(sort=[("ship", False)]).rows
    assert [r["ship"] for r in ships] == ["Aurora"] * 3 + ["Boreas"] * 2 + ["Cirrus"] + [None] * 3
    only = entries.query(limit=0)
    assert (only.rows, only.total, only.more) == ([], 9, True)


def test_entry_filters_and_ids(entries):
    def codes(text):
        return {r["code"] for r in entries.query(text).rows}

    assert codes("weeks > 1 AND days < 20") == {"V-11", "W-01"} and codes('ship = "Boreas" OR code = "V-99"') == {"V-20", "V-21", "V-99"}
    assert codes("2 <= weeks") == {"V-21"} and codes("ship IS UNKNOWN") == {"W-01", "W-02", "V-99"} and codes("_x_y = 1") == set()
    with pytest.raises(FilterError):
        codes("nothing = 1")
    one = entries.query('code = "V-12"').rows[0]
    assert entries.fetch(one["id"]) == one and one["id"].startswith("a/") and entries.fetch("a/none") is None
    assert codes(f'id = "{one["id"]}"') == {"V-12"} and codes('id = "zz"') == set() and one["type"] == "trips"
    with pytest.raises(ValueError):
        entries.query(limit=-1)


def test_duplicate_public_ids_are_found(entries):
    assert entries.duplicate_ids().count() == 0
    same = EntryFederation([EntrySource(s.name, s.store, s.properties) for s in entries.sources], "trips")
    assert [len(r.origins) for r in same.duplicate_ids().collect()] == [2]
    with pytest.raises(DuplicateEntryId):
        same.query(limit=1)
    assert [r["code"] for r in same.query(offset=1, limit=2).rows] == ["V-12", "V-20"]
    with pytest.raises(DuplicateEntryId):
        same.fetch(same.duplicate_ids().first().id)


def test_related_ids(provider):
    s = provider.store.searcher()
    v = s.variable(Voyage)
    s.add(filter_predicate('ships.id HAS "ships-1" AND NOT ships.id HAS ANY "ships-2","other-1"', v, relationships={"ships": "ship"}))
    assert set(s.results(c=v.code).scalars()) == {"V-11", "V-12"}
    with pytest.raises(FilterError):
        filter_predicate('ships.id = "ships-1"', v, relationships={"ships": "ship"})


def test_validation(spark):
    rules = {"id": {"type": "string"}, "n": {"type": "integer", "nullable": False}, "tags": {"type": "list of string"}}
    validate_record({"id": "a", "n": 1, "tags": ["x", None]}, rules)
    for wrong in ({"id": "a"}, {"n": "1"}, {"n": True}, {"n": 1, "tags": [1]}, {"n": 1, "other": 2}):
        with pytest.raises(ValidationError):
            validate_record(wrong, rules)
    given = FrameEntryProvider(spark, "things", [{"id": "a", "n": 1}], rules)
    assert next(given.records())["type"] == "things" and given.frame().count() == 1


def test_stream_is_ingested_once(spark, tmp_path):
    spark.range(60).selectExpr("concat('d', id % 20) AS name", "7 AS built").repartition(3).write.parquet(f"{tmp_path}/in")
    store = RecordStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):  # the second run replays everything
        stream = spark.readStream.schema("name string, built int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest_stream(store, Ship, stream, f"{tmp_path}/check{_}").awaitTermination()
    assert store.table(Ship).count() == 20


def test_only_one_writer_commits(spark, tmp_path):
    store = RecordStore(spark, f"file://{tmp_path}")
    store.save(VOYAGES[0])
    with pytest.raises(ConcurrentCommit):
        store._commit(0, {})
    assert store.version() == 1


def test_findings_of_integrity_checks(spark, tmp_path):
    store = RecordStore(spark, f"file://{tmp_path}")
    store.save(Cargo([Crate(1, "p")], "a"))
    parts = store.table(Crate).count()
    assert parts == 1 and store.unreachable([Cargo, Crate])["crate"].count() == 0
    alone = RecordStore(spark, f"file://{tmp_path}/other")
    manifest = store.manifest()
    manifest["tables"].pop("crate")
    manifest["tables"]["cargo"]["paths"] = [f"../{p}" for p in manifest["tables"]["cargo"]["paths"]]
    alone._commit(0, manifest)
    findings = alone.fsck([Cargo, Crate])
    assert findings["cargo.crates: dangling"].count() == 1


def test_set_wise_steps(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, None, float("nan")), (4, None, float("nan")), (5, "b", 2.0)], "sid long, k string, m double")
    got = {r.sid: r.canonical_sid for r in dataflow.canonical_map(df, "sid", ["k"]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    ided = dataflow.with_content_id(df, ["k"])
    assert {r.versions for r in dataflow.metadata_conflicts(ided, "content_id", ["m"]).collect()} == {2}
    numbered = {r.sid: r.n for r in dataflow.dense_numbers(df, "sid", "n", parts=3).collect()}
    assert numbered == {i: i for i in range(1, 6)}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "source long, target long")
    roots = spark.createDataFrame([(1,)], "sid long")
    assert {r.sid for r in dataflow.reachable(roots, edges, lambda d: d.cache()).collect()} == {1, 2, 3}
    links = spark.createDataFrame([("p", "x", "1"), ("p", "y", "2"), ("q", "x", "1"), ("q", "x", "2")], "s string, l string, t string")
    got = {r.s: (r.targets, r.repeated) for r in product_relationships(links, "s", "l", "t").collect()}
    assert got == {"p": ({"x": "1", "y": "2"}, []), "q": ({"x": "1"}, ["x"])}


def test_relations_over_a_database(spark):
    """Apache Derby comes with Spark; in local mode its memory databases are seen by all tasks."""
    url = "jdbc:derby:memory:quarry;create=true"
    jvm = spark.sparkContext._jvm
    connection = jvm.java.sql.DriverManager.getConnection(url)
    run = connection.createStatement().executeUpdate
    run("CREATE TABLE SHIPS (ID BIGINT, NAME VARCHAR(20), BUILT INT)")
    for i in range(20):
        run(f"INSERT INTO SHIPS VALUES ({i}, 's{i}', {1900 + i})")
    connection.close()
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    relation = jdbc_relation("ships", spark, url, "SHIPS", "ID", split_by="ID", options=options)
    s = Searcher()
    v = s.variable(relation)
    s.add(v.BUILT > 1915)
    found = s.results(name=v.NAME, built=v.BUILT)
    assert set(found.scalars("name")) == {"s16", "s17", "s18", "s19"}
    assert "PushedFilters: [*IsNotNull(BUILT), *GreaterThan(BUILT,1915)]" in found.to_frame()._jdf.queryExecution().executedPlan().toString()
