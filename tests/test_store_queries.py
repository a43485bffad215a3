from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import UTC, datetime
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators.federation import FederatedSearch, SourceError
from quarry.operators.filters import FilterError, filter_predicate, parse
from quarry.operators.paging import PageOrder, PageTokenError
from quarry.plans.expr import constant, scaled_exactly_equal, when_known
from quarry.sources.store import IntegrityError, LayoutError, MetadataConflict, RecordStore, ReplacementError
from quarry.schema import SchemaError, StorageInfo, declare_storage, resolve
from quarry.sources.canonical import canonical_column, canonical_text
from tests.records import (
    AURORA,
    BOREAS,
    CODES,
    INSPECTIONS,
    REMARKS,
    VOYAGES,
    Cargo,
    Crate,
    Hull,
    Inspection,
    Reading,
    Remark,
    Ship,
    Signal,
    Voyage,
)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = RecordStore(spark, f"file://{tmp_path_factory.mktemp('store')}")
    s.bulk_ingest([*VOYAGES, *INSPECTIONS, *REMARKS])
    return s


def names(store, condition, cls=Voyage, field="code"):
    s = store.searcher()
    v = s.variable(cls)
    s.add(condition(v))
    return set(s.results(out=getattr(v, field)).scalars())


CASES = {
    "positive": (lambda v: v.freight > 0, {"V-11", "W-01", "W-02", "W-1%"}),
    "fraction": (lambda v: v.freight == Fraction(-1, 2), {"V-12"}),
    "exact": (lambda v: v.freight.exactly(Fraction(1, 10)), {"W-02"}),
    "prefix": (lambda v: v.code.startswith("V-2"), {"V-20", "V-21"}),
    "chain": (lambda v: v.ship.name == "Aurora", {"V-11", "V-12"}),
    "no reference": (lambda v: v.ship == None, {"W-01", "W-02"}),  # noqa: E711
    "has any": (lambda v: v.ports.has_any("Kiel"), {"V-11", "V-12", "V-21"}),
    "has only": (lambda v: v.ports.has_only("Oslo", "Riga"), {"V-20", "W-02", "W-1%"}),
    "not has any": (lambda v: ~v.ports.has_any("Kiel", "Riga"), {"W-01", "W-02"}),
    "not has only": (lambda v: ~v.ports.has_only("Oslo", "Riga"), {"V-11", "V-12", "V-21", "W-01"}),
    "two ports": (lambda v: v.ports.has_any("Kiel") & v.ports.has_any("Riga"), {"V-11", "V-21"}),
    "not equal element": (lambda v: ~(v.ports == "Oslo"), {"V-12", "V-20", "W-02"}),
    "mixed or": (lambda v: v.ports.has_only("Riga") | (v.ports == "Turku"), {"V-12", "V-20", "V-21", "W-01", "W-02"}),
    "not or": (lambda v: ~((v.days == 4) | v.ports.has_any("Oslo")), {"W-02"}),
    "empty any": (lambda v: v.ports.has_any(), set()),
    "empty in": (lambda v: v.code.is_in(), set()),
    "true": (lambda v: v.always_true(), CODES),
    "false": (lambda v: v.always_false(), set()),
    "length": (lambda v: v.ports.length() >= 3, {"V-11", "V-21"}),
    "columns": (lambda v: v.days == v.days, CODES),
    "scope": (lambda v: v.scope("ports").count() == 0, {"W-02"}),
}


@pytest.mark.parametrize("case", CASES)
def test_predicates(store, case):
    condition, expected = CASES[case]
    assert names(store, condition) == expected


def test_references_to_stored_objects(store):
    ship = store.fetch(Ship, store.sid_of(AURORA))
    assert names(store, lambda v: v.ship == ship) == {"V-11", "V-12"}


@pytest.mark.parametrize(
    "condition, expected",
    [
        (lambda n: n.body.contains("7%"), {"7% salt", "salt 7%"}),
        (lambda n: n.body.startswith("no_"), {"no_go"}),
        (lambda n: n.body.endswith("no_go"), {"no_go", "the no_go"}),
        (lambda n: ~n.answer.is_in("yes"), {n.body for n in REMARKS}),
        (lambda n: ~n.answer.is_in(None, "a"), set()),
        (lambda n: ~(n.answer == "a"), set()),
        (lambda n: when_known(n.answer == None, n.body == "nongo"), {"nongo"}),  # noqa: E711
    ],
)
def test_literal_strings_and_nulls(store, condition, expected):
    assert names(store, condition, Remark, "body") == expected


def test_refusals(store):
    v = store.searcher().variable(Voyage)
    for wrong in (lambda: v.ports == None, lambda: v.ports.has_any(None), lambda: v.freight < None):  # noqa: E711
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(AttributeError):
        v.nothing
    with pytest.raises(TypeError):
        store.searcher().variable(Hull).frame
    with pytest.raises(TypeError):
        bool(v.code == "V-11")


def test_joins_sorts_and_slices(store):
    s = store.searcher()
    t, m = s.variable(Inspection), s.variable(Voyage)
    s.add(t.voyage == m).add(t.by == "port")
    assert {tuple(r) for r in s.results(c=m.code, p=t.passed)} == {("V-11", True), ("V-20", False)}
    s = store.searcher()
    a, b = s.variable(Voyage), s.variable(Voyage)
    s.add(a.days == b.days).add(a.code < b.code)
    assert s.count() == 3
    s = store.searcher()
    v = s.variable(Voyage)
    found = s.add_sort(v.code).results(c=v.code, f=v.freight)
    assert found.scalars("c") == sorted(CODES)
    assert [r.c for r in found[1:3]] == ["V-12", "V-20"] and found[0]["f"] == Fraction(5, 3) and len(found[2:]) == 5
    assert found.first().f == Fraction(5, 3) and found.column("f").floats()[1] == pytest.approx(-1 / 2)
    with pytest.raises(LookupError):
        found.one()


def test_objects_round_trip(store):
    s = store.searcher()
    v = s.variable(Voyage)
    s.add(v.code == "V-11")
    row = s.results(m=v, ship=v.ship).one()
    assert row.m == VOYAGES[0] and row.ship == AURORA and row.m.freight == Fraction(5, 3)
    assert store.referring(Voyage, "ship", AURORA) == VOYAGES[:2]
    assert store.fetch_by_content_id(Ship, store.content_id(AURORA)) == AURORA
    with pytest.raises(KeyError):
        store.fetch(Voyage, 10**6)


def jobs_of(spark, work):
    """How many jobs ``work()`` runs."""
    sc, group = spark.sparkContext, f"counted-{time.time_ns()}"
    sc.setJobGroup(group, "counted")
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_records_come_in_chunks(spark, store):
    """All records of a result are read together: jobs don't grow with the rows."""
    s = store.searcher()
    v = s.variable(Voyage)
    found = s.results(m=v)
    rows = []
    one = jobs_of(spark, lambda: list(found[0:1]))
    assert jobs_of(spark, lambda: rows.extend(found)) <= one + 4
    assert {r.m.code for r in rows} == CODES


def test_pages_cover_everything_once(store):
    s = store.searcher()
    v = s.variable(Voyage)
    found = s.results(d=v.days, c=v.code)
    by = [PageOrder("d", descending=True)]
    seen, cursor, back = [], None, None
    for _ in range(3):
        page = found.page(size=3, order_by=by, cursor=cursor, include_total=True)
        seen += [r.c for r in page.rows]
        cursor, back = page.next, page.previous
    assert seen[:3] == ["V-21", "V-11", "W-01"] and set(seen[3:6]) == {"V-12", "V-20", "W-1%"} and seen[6:] == ["W-02"]
    assert cursor is None and page.total == 7
    assert [r.c for r in found.page(size=3, order_by=by, cursor=back).rows] == seen[3:6]
    token = found.page(size=2, order_by=by).next
    with pytest.raises(PageTokenError):
        found.page(size=2, cursor=token)
    with pytest.raises(PageTokenError):
        found.page(size=2, order_by=by, cursor="x" + token)
    with pytest.raises(ValueError):
        found.page(size=0)


FILTERS = {
    'ports HAS "Oslo" AND days = 4': {"W-1%"},
    'ports HAS ALL "Kiel","Riga" OR code = "W-02"': {"V-11", "V-21", "W-02"},
    'NOT ports HAS ANY "Kiel","Riga"': {"W-01", "W-02"},
    'ports HAS ONLY "Oslo","Riga"': {"V-20", "W-02", "W-1%"},
    "ports LENGTH 2": {"V-12", "W-01", "W-1%"},
    "10 < days AND freight < 0": {"V-21"},
    'code STARTS WITH "V-" AND code ENDS "1"': {"V-11", "V-21"},
    'ship.name = "Boreas"': {"V-20", "V-21"},
    "ship IS UNKNOWN": {"W-01", "W-02"},
    "_foreign_thing IS UNKNOWN AND days < 4": {"W-02"},
    "_foreign_thing = 1": set(),
    'type = "voyages"': CODES,
}


@pytest.mark.parametrize("text", FILTERS)
def test_filter_language(store, text):
    kinds = {"days": "integer", "code": "string", "freight": "float"}
    assert names(store, lambda v: filter_predicate(text, v, kinds=kinds, entry_type="voyages")) == FILTERS[text]


@pytest.mark.parametrize(
    "text, category",
    [
        ("", "syntax"),
        ("a = ", "syntax"),
        ("nothing = 1", "unrecognized-property"),
        ("days = 1.5", "type-mismatch"),
        ('days = "x"', "type-mismatch"),
        ("1 = 1", "not-implemented"),
        ("days = code", "not-implemented"),
        ('ports HAS < "x"', "not-implemented"),
        ("ship.a.b = 1", "not-implemented"),
        ("code LENGTH 3", "type-mismatch"),
    ],
)
def test_filter_errors(store, text, category):
    with pytest.raises(FilterError) as wrong:
        names(store, lambda v: filter_predicate(text, v, kinds={"days": "integer"}))
    assert wrong.value.category == category


def test_filter_tree_and_escapes():
    assert parse('NOT a=1 AND b HAS "x\\"y"') == (
        "AND",
        ("NOT", ("=", ("Identifier", "a"), ("Number", "1"))),
        ("HAS_ALL", ("=",), ("Identifier", "b"), (("String", 'x"y'),)),
    )
    assert parse('a = "b\\\\c" OR c.d IS KNOWN')[1][2] == ("String", "b\\c")


@pytest.fixture(scope="module")
def cargoes(spark, tmp_path_factory):
    s = RecordStore(spark, f"file://{tmp_path_factory.mktemp('cargoes')}")
    light, heavy, vast = Crate(Fraction(1, 3), "light"), Crate(Fraction(2, 3), "heavy"), Crate(Fraction(10**30, 7), "vast")
    sealed = datetime(2024, 5, 1, 12, tzinfo=UTC)
    s.bulk_ingest(
        [
            Cargo([light, heavy], "both", sealed, (Fraction(1, 2), Fraction(1, 3)), ["x"]),
            Cargo([light], "one", None, (), []),
            Cargo([heavy, vast], "other", None, (), None),
        ]
    )
    return s


def test_children_of_records(cargoes):
    assert names(cargoes, lambda v: v.crates.mark == "light", Cargo, "bill") == {"both", "one"}
    assert names(cargoes, lambda v: ~(v.crates.mark == "light"), Cargo, "bill") == {"other"}
    assert names(cargoes, lambda v: v.crates.length() == 2, Cargo, "bill") == {"both", "other"}
    assert names(cargoes, lambda v: v.flags_present == True, Cargo, "bill") == {"both", "one"}  # noqa: E712
    assert names(cargoes, lambda v: v.flags.has("x"), Cargo, "bill") == {"both"}
    assert names(cargoes, lambda v: v.flags.has_only("y"), Cargo, "bill") == {"one", "other"}
    back = cargoes.fetch(Cargo, 1)
    assert {cargoes.fetch(Cargo, i).bill for i in (1, 2, 3)} == {"both", "one", "other"} and isinstance(back.shares, tuple)


def test_sibling_scopes_compare_exactly(cargoes):
    def doubled(v):
        a, b = v.scope("crates"), v.scope("crates")
        return a.exists(b.exists(scaled_exactly_equal(a.weight, 2, b.weight, 1)))

    assert names(cargoes, doubled, Cargo, "bill") == {"both"}


def test_counts_over_scopes(cargoes):
    def many(v):
        crate = v.scope("crates")
        return crate.distinct_count(crate.weight) == 2

    assert names(cargoes, many, Cargo, "bill") == {"both", "other"}
    assert names(cargoes, lambda v: (p := v.scope("crates")).where(p.mark == "heavy").count() == 1, Cargo, "bill") == {"both", "other"}


def test_policies_and_conflicts(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}")
    first = s.bulk_ingest([Signal("x"), Signal("x"), AURORA, Ship("Aurora", 1911)])
    assert len(set(first[:2])) == 2 and first[2] == first[3]
    assert s.save(AURORA) == first[2] and s.table(Ship).count() == 1
    seen = Inspection(VOYAGES[0], "crew", True)
    assert s.save(seen) == s.save(Inspection(VOYAGES[0], "crew", True)) and s.table(Voyage).count() == 1
    s.save(Cargo([Crate(Fraction(1), "p")], "n"))
    with pytest.raises(MetadataConflict):
        s.save(Cargo([Crate(Fraction(1), "p")], "n", memo="other"))
    with pytest.raises(TypeError):
        s.save(Ship(1, 1))
    findings = s.fsck([Ship, Voyage, Inspection, Cargo, Crate, Signal])
    assert not {k for k, df in findings.items() if not df.isEmpty()}
    assert all(df.isEmpty() for df in s.unreachable([Ship, Voyage, Inspection]).values())
    s.compact(Ship)
    assert s.fetch(Ship, first[2]) == AURORA


def test_one_identity_whatever_the_way_in(spark, tmp_path):
    """Objects and frames, with references and lists of them, get the same identities and so the same rows."""
    s = RecordStore(spark, f"file://{tmp_path}")
    spark.range(1).selectExpr("'Aurora' AS name", "1911 AS built").createOrReplaceTempView("ships")
    s.ingest_frame(Ship, spark.table("ships"))
    sid = s.sid_of(AURORA)
    assert sid == 1 and s.save(Ship("Aurora", 1911)) == 1 and s.table(Ship).count() == 1 and s.fetch_by_content_id(Ship, s.content_id(AURORA)) == AURORA
    when = datetime(2024, 2, 3, 4, 5, 6, 789, tzinfo=UTC)
    for k, number in enumerate((0.1, -0.0, 1e300, 5e-324, 1e7, float("inf"), 123456789.125)):
        made = Reading(number, -k, k % 2 == 0, f"é🙂 {k}", bytes([0, 255, k]), when, [number, 1.0], AURORA, [AURORA, AURORA])
        row = (number, -k, k % 2 == 0, f"é🙂 {k}", bytes([0, 255, k]), when, [number, 1.0], sid, [sid, sid])
        kinds = "at double, count long, ok boolean, label string, raw binary, when timestamp, series array<double>, ship_sid long, fleet_sids array<long>"
        s.ingest_frame(Reading, spark.createDataFrame([row], kinds))
        assert s.sid_of(made) == k + 1 and s.save(made) == k + 1
    assert s.table(Reading).count() == 7 and s.sid_of(Reading(0.1, 0, True, "", b"", when, [])) is None


def test_canonical_texts_agree(spark):
    kind = "a string, b array<string>, c array<double>, d long, e boolean, f binary, g double"
    rows = [
        (None, None, None, None, None, None, None),
        ("", [], [], 0, False, b"", 0.0),
        ("a,b]", ["a", None, ","], [1.5, None, float("nan")], -(1 << 63), True, b"\x00\xff", float("-inf")),
        ("日本🙂", ["n", "s1:n"], [1e-310, 2.0**-1074, -1e22], 7, None, b"x", 1 / 3),
    ]
    df = spark.createDataFrame(rows, kind)
    got = df.select(*[canonical_column(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).collect()
    want = [tuple(canonical_text(v, f.dataType) for v, f in zip(r, df.schema, strict=True)) for r in rows]
    assert sorted(map(tuple, got)) == sorted(want)
    assert len({r[1] for r in want}) == len(want)


def test_roles_are_promoted(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}")
    s.save(VOYAGES[0])
    assert [r.role for r in s.table(Ship).collect()] == [0]
    version = s.version()
    s.save(AURORA)
    assert [r.role for r in s.table(Ship).collect()] == [1] and s.version() == version + 1
    s.save(AURORA)
    s.save(VOYAGES[0])  # as a dependency again: it stays a root
    assert [r.role for r in s.table(Ship).collect()] == [1] and s.version() == version + 1
    s.ingest_frame(Ship, spark.createDataFrame([("Boreas", 1950)], "name string, built long"))
    s.compact(Ship)
    assert sorted((r.name, r.role) for r in s.table(Ship).collect()) == [("Aurora", 1), ("Boreas", 1)]


def test_promoted_records_families_and_arrow(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}")
    s.save(VOYAGES[0], promote=(Ship,))
    assert [r.role for r in s.table(Ship).collect()] == [1]
    s.ingest_arrow(Ship, pa.table({"name": ["Aurora", "Dione"], "built": [1911, 2001]}))
    assert s.table(Ship).count() == 2
    s.save(REMARKS[0])
    family = (Ship, Remark)
    assert s.dispatch(family).count() == 3 and s.fetch_entry(family, s.content_id(AURORA)) == AURORA and s.fetch_entry(family, s.content_id(REMARKS[0])) == REMARKS[0]
    with pytest.raises(KeyError):
        s.fetch_entry(family, "none")
    with pytest.raises(ValueError):
        s.dispatch((Signal,))
    with pytest.raises(IntegrityError):
        s.fetch_entry((Ship, Ship), s.content_id(AURORA))


def test_tables_are_created_and_listed(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}")
    s.create([Inspection])
    assert s.version() == 1 and {r.table for r in s.catalog().collect()} == {"inspection", "voyage", "ship"}
    s.create([Ship])
    assert s.version() == 1 and s.table(Ship).count() == 0
    s.save(AURORA)
    assert {(r.column, r.type) for r in s.catalog().filter("table = 'ship'").collect()} >= {("name", "string"), ("built", "bigint")}
    assert s.capabilities()["timestamp_resolution_ns"] == 1000


def test_held_records_are_the_same_objects(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}")
    sid = s.save(VOYAGES[0])
    one = s.fetch(Voyage, sid)
    assert s.fetch(Voyage, sid) is one and jobs_of(spark, lambda: s.fetch(Voyage, sid)) == 0
    assert s.fetch(Ship, one.ship._quarry_sid) is one.ship


def test_times_are_shown_in_nanoseconds(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}")
    before = time.time_ns()
    s.save(AURORA)
    q = s.searcher()
    v = q.variable(Ship)
    shown = q.results(t=v.store_timestamp).one().t
    assert abs(shown - before) < 120 * 10**9 and shown % 1000 == 0
    for moment, found in ((shown, 1), (shown - 1000, 0), ("2020-01-01T00:00:00Z", 0)):
        q = s.searcher()
        v = q.variable(Ship)
        assert q.add(v.store_timestamp <= moment).count() == found


def test_storage_declared_from_outside():
    @dataclass(frozen=True)
    class Plain:
        a: int

    declare_storage(Plain, StorageInfo(name="plain_things", dedup="none"))
    assert resolve(Plain).name == "plain_things" and resolve(Plain).dedup == "none"
    for cls in (Plain, Signal):
        with pytest.raises(SchemaError):
            declare_storage(cls, StorageInfo(name="other"))


def test_garbage_is_collected(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}")
    old, new = Cargo([Crate(Fraction(1), "a"), Crate(Fraction(2), "b")], "x"), Cargo([Crate(Fraction(2), "b")], "y")
    s.bulk_ingest([old, new])
    manifest = s.manifest()
    gone = s.sid_of(old)
    kept = s.table(Cargo).filter(F.col("sid") != gone)
    kept.write.parquet(f"{s.root}/data/kept/cargo")
    manifest["tables"]["cargo"]["paths"] = ["data/kept/cargo"]
    s._commit(s.version(), manifest)
    assert s.collect_garbage([Cargo, Crate]) == {"crate": 1} and s.collect_garbage([Cargo, Crate]) == {}
    assert s.vacuum() > 0
    assert s.fetch(Cargo, s.sid_of(new)) == new and [r.mark for r in s.table(Crate).collect()] == ["b"]


def test_ingest_in_chunks(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}")
    seen = []
    objects = (Voyage(AURORA if i % 2 else BOREAS, ["p"], i % 9, Fraction(i % 9), "c") for i in range(25))
    sids = s.bulk_ingest(objects, chunk_size=10, progress=seen.append)
    assert seen == [10, 20, 25] and s.table(Ship).count() == 2 and s.table(Voyage).count() == len(set(sids)) == 18
    assert s.version() == 1 and [s.fetch(Voyage, x).days for x in sids[:4]] == [0, 1, 2, 3]
    assert s.bulk_ingest([VOYAGES[4]], track_sids=False) == [] and s.sid_of(VOYAGES[4]) == 19
    with pytest.raises(MetadataConflict):
        s.bulk_ingest([Cargo([], "n"), Cargo([], "n", memo="m")], chunk_size=1)
    assert s.table(Cargo).count() == 0


def test_replacement_is_one_commit(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}")
    one = s.save(VOYAGES[0])
    version = s.version()
    two = s.replace(one, Voyage(BOREAS, ["new"], 1, Fraction(1), "V-11"))
    assert s.version() == version + 1 and [v.ship for v in s.history((Voyage, two))] == [AURORA, BOREAS]
    assert s.snapshot_cutoff_ns() == s.manifest()["stamp"] > 0
    assert names(s, lambda v: v.always_true()) == {"V-11"}


def test_lineage_and_time(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}")
    one = s.save(Ship("v1", 1))
    between = time.time_ns() + 1000
    time.sleep(0.01)
    two = s.replace(one, Ship("v2", 1))
    other = s.save(Ship("w", 2))
    assert [p.name for p in s.history((Ship, two))] == ["v1", "v2"]

    def titles(**options):
        q = s.searcher(**options)
        v = q.variable(Ship)
        return set(q.results(t=v.name).scalars())

    assert titles() == {"v1", "v2", "w"}
    assert titles(only_latest=True) == {"v2", "w"}
    assert titles(as_of=between) == titles(as_of=between, only_latest=True) == {"v1"}
    with pytest.raises(ReplacementError):
        s.replace(other, Ship("v2", 1))


def test_frames_are_ingested_setwise(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}")
    rows = spark.range(1000).selectExpr("concat('d', id % 100) AS name", "1 AS built")
    assert s.ingest_frame(Ship, rows).count() == 100
    s.ingest_frame(Ship, rows)
    table = s.table(Ship)
    assert table.count() == 100 and {r.sid for r in table.collect()} == set(range(1, 101))


def test_layout_is_verified(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}")
    s.save(Ship("d", 1))

    @dataclass(frozen=True)
    class Other:
        name: str
        year: int
        __storage__ = type(Inspection.__storage__)(name="ship")

    with pytest.raises(LayoutError):
        s.table(Other)
    assert s.table(Remark).count() == 0


def test_federation(spark, tmp_path, store):
    other = RecordStore(spark, f"file://{tmp_path}")
    other.bulk_ingest(VOYAGES[:1])
    both = FederatedSearch({"a": store, "b": other}, Voyage).add(lambda v: v.ports.has_any("Kiel"))
    rows = both.frame(code=lambda v: v.code).collect()
    assert both.count() == 4 and [r.origin for r in both.frame(limit=4, code=lambda v: v.code).collect()] == ["a", "a", "a", "b"]
    assert {(r.origin, r.code) for r in rows} == {("a", "V-11"), ("a", "V-12"), ("a", "V-21"), ("b", "V-11")}
    found = both.results(code=lambda v: v.code, days=lambda v: v.days)
    assert [tuple(r) for r in found[2:4]] == [("a", "V-21", 30), ("b", "V-11", 12)] and found.first().code == "V-11" and len(found) == 4
    with pytest.raises(SourceError):
        FederatedSearch({"a": store}, Voyage).add(lambda v: v.missing == 1).count()


def test_constant_is_three_valued():
    assert "NONE" in constant(None).text
