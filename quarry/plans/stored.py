"""Queries over a record store that each of them fills from the driver's tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.entries import EntryFederation, EntrySource, StoredProperty
from quarry.operators.filters import filter_predicate
from quarry.plans.catalogue import ORACLES, QUERIES
from quarry.schema import StorageInfo
from quarry.sources import files
from quarry.sources.store import RecordStore


@dataclass(frozen=True)
class StoredRegion:
    name: str


@dataclass(frozen=True)
class StoredNation:
    name: str
    region: StoredRegion | None


@dataclass(frozen=True)
class StoredCustomer:
    name: str
    segment: str
    balance: float
    nation: StoredNation | None


@dataclass(frozen=True)
class StoredTrade:
    """A nation's customers' segments and balances, in the order of their names."""

    nation: StoredNation
    segments: list[str]
    balances: list[float]
    share: Fraction
    __storage__ = StorageInfo(dedup="by_value")


_folders: list[tuple[SparkSession, str]] = []
_own: list[tempfile.TemporaryDirectory] = []


def new_store(spark: SparkSession) -> RecordStore:
    """A store in the folder that the cluster shares; a session without one (a test) gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        _own.append(tempfile.TemporaryDirectory())
        root = f"file://{_own[-1].name}"
    path = f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return RecordStore(spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _folders:
        if spark.sparkContext._jsc is not None:
            try:
                files.delete(spark, path)
            except Exception as gone:
                print(f"left {path}: {type(gone).__name__}")
                return


def nations(spark: SparkSession, sf_dir: str) -> list[StoredNation]:
    """The nations as objects: 25 rows of any scale factor."""
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    regions = {r.r_regionkey: StoredRegion(r.r_name) for r in region.collect()}
    return [StoredNation(n.n_name, regions.get(n.n_regionkey)) for n in nation.orderBy("n_nationkey").collect()]


def filled(spark: SparkSession, sf_dir: str) -> RecordStore:
    """A store of all nations, as objects, and all customers, as a frame with references by key."""
    store = new_store(spark)
    objects = nations(spark, sf_dir)
    sids = store.bulk_ingest(objects)
    keys = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_nationkey").collect()
    by_key = spark.createDataFrame([(k.n_nationkey, s) for k, s in zip(keys, sids, strict=True)], "c_nationkey int, nation_sid long")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").join(F.broadcast(by_key), "c_nationkey", "left")
    store.ingest_frame(StoredCustomer, customer.selectExpr("c_name AS name", "c_mktsegment AS segment", "c_acctbal AS balance", "nation_sid"))
    return store


def query(name: str, sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return register


@query(
    "store_ingest_save",
    """SELECT c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, n_name AS nation, count(*) OVER () AS stored
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def store_ingest_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of customers, then the same again, then one of them as an object: each is stored once."""
    store = filled(spark, sf_dir)
    rows = store.table(StoredCustomer)
    store.ingest_frame(StoredCustomer, rows.select("name", "segment", "balance", "nation_sid"))
    first = rows.orderBy("name").first()
    nation = store.fetch(StoredNation, first.nation_sid) if first.nation_sid is not None else None
    store.save(StoredCustomer(first.name, first.segment, first.balance, nation))
    s = store.searcher()
    v = s.variable(StoredCustomer)
    found = s.results(name=v.name, segment=v.segment, balance=v.balance, nation=v.nation.name).to_frame()
    return found.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("stored"))))


@query("store_promotion", "SELECT r_name AS name, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 1 ELSE 0 END AS role FROM region")
def store_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that come with nations are dependencies; two of them are then saved as roots."""
    store = new_store(spark)
    store.bulk_ingest(nations(spark, sf_dir))
    store.bulk_ingest([StoredRegion("ASIA"), StoredRegion("EUROPE")])
    return store.table(StoredRegion).select("name", "role")


@query(
    "store_hydration",
    """SELECT n_name AS nation, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
       WHERE n_name < 'M'""",
)
def store_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with what they refer to, read together as objects."""
    store = new_store(spark)
    store.bulk_ingest(nations(spark, sf_dir), chunk_size=10)
    s = store.searcher()
    v = s.variable(StoredNation)
    s.add(v.name < "M")
    found = [r.nation for r in s.results(nation=v)]
    return spark.createDataFrame([(n.name, n.region.name if n.region else None) for n in found], "nation string, region string")


@query(
    "store_search",
    """SELECT c_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 5000""",
)
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = filled(spark, sf_dir).searcher()
    v = s.variable(StoredCustomer)
    s.add(v.nation.region.name == "ASIA").add(v.balance > 5000.0)
    return s.results(name=v.name, region=v.nation.region.name).to_frame()


@query(
    "store_related_ids",
    """SELECT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
       WHERE n_nationkey IN (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 2) AND c_mktsegment <> 'BUILDING'""",
)
def store_related_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the ids of their nations, which were stored first and so have the first keys."""
    store = filled(spark, sf_dir)
    s = store.searcher()
    v = s.variable(StoredCustomer)
    text = 'nations.id HAS ANY "nations-1","nations-2" AND segment != "BUILDING"'
    return s.add(filter_predicate(text, v, relationships={"nations": "nation"})).results(name=v.name).to_frame()


@query(
    "store_replace",
    """SELECT name, place, place = max(place) OVER () AS latest FROM (VALUES ('first', 1), ('second', 2), ('third', 3)) t(name, place)""",
)
def store_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of a record that was replaced twice, and what is left of it with only_latest."""
    store = new_store(spark)
    sid = store.save(StoredRegion("first"))
    for name in ("second", "third"):
        sid = store.replace(sid, StoredRegion(name))
    s = store.searcher(only_latest=True)
    latest = s.results(sid=s.variable(StoredRegion).sid).to_frame().withColumn("latest", F.lit(True))
    rows = store.table(StoredRegion).select("sid", "name", F.col("sid").cast("int").alias("place")).filter(f"logical_id = {sid} - 2")
    return rows.join(latest, "sid", "left").select("name", "place", F.coalesce("latest", F.lit(False)).alias("latest"))


@query(
    "store_by_value",
    """SELECT n_name AS nation, list(c_mktsegment ORDER BY c_name)[1] AS first_segment, count(*) AS customers FROM customer
       JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def store_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with lists, ingested twice as a frame; under ``by_value`` lists are no part of an identity."""
    store = filled(spark, sf_dir)
    rows = store.table(StoredCustomer).filter("nation_sid is not null").groupBy("nation_sid")
    lists = rows.agg(F.sort_array(F.collect_list(F.struct("name", "segment", "balance"))).alias("l"))
    frame = lists.selectExpr("nation_sid", "l.segment AS segments", "l.balance AS balances", "0.5D AS share", "'1/2' AS share_exact")
    for segments in ("segments", "reverse(segments)"):
        store.ingest_frame(StoredTrade, frame.selectExpr("nation_sid", f"{segments} AS segments", "balances", "share", "share_exact"))
    s = store.searcher()
    v = s.variable(StoredTrade)
    keys = s.results(sid=v.sid, nation=v.nation.name).to_frame()
    table = store.table(StoredTrade).select("sid", F.get("segments", F.lit(0)).alias("first_segment"), F.size("segments").cast("long").alias("customers"))
    return keys.join(table, "sid").drop("sid")


@query(
    "store_federation",
    """WITH rows AS (SELECT 'a' AS origin, c_name AS name, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING'
         UNION ALL SELECT 'b', c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING')
       SELECT name, balance, (SELECT count(*) FROM rows WHERE balance > 1000) AS total FROM rows
       WHERE balance > 1000 ORDER BY balance DESC, name LIMIT 50 OFFSET 10""",
)
def store_federation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50 entries (its contract) from two stores, in one order."""
    sources = []
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    properties = {
        "name": StoredProperty("string", lambda v: v.name),
        "balance": StoredProperty("float", lambda v: v.balance),
        "hundreds": StoredProperty("float", lambda v: v.balance, lambda v, op, n: v.balance > 100.0 * n),
    }
    for name, part in (("a", "c_mktsegment = 'BUILDING'"), ("b", "c_mktsegment <> 'BUILDING'")):
        store = new_store(spark)
        rows = customers.filter(part).selectExpr("c_name AS name", "c_mktsegment AS segment", "c_acctbal AS balance", "CAST(NULL AS LONG) AS nation_sid")
        store.ingest_frame(StoredCustomer, rows)
        sources.append(EntrySource(name, store, {StoredCustomer: properties}, f"{name}-"))
    page = EntryFederation(sources, "customers").query("hundreds > 10", sort=[("balance", True), ("name", False)], offset=10, limit=50)
    rows = [(r["name"], r["balance"], page.total) for r in page.rows]
    return spark.createDataFrame(rows, "name string, balance double, total long")
