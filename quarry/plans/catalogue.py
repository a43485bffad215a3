"""Queries on the driver's tables, with the SQL that they are compared to."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import dataflow
from quarry.operators.federation import duplicate_ids, source_major, sorted_merge
from quarry.operators.filters import filter_predicate
from quarry.operators.paging import PageOrder
from quarry.operators.searcher import Searcher
from quarry.plans.relation import Child, Relation, relation_of_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """The driver's tables as relations with references and collections."""
    t = SimpleNamespace()

    def read(name: str) -> Callable[[], DataFrame]:
        return partial(spark.read.parquet, f"{sf_dir}/{name}.parquet")

    def fields(prefix: str, names: str) -> dict[str, str]:
        return {n: f"{prefix}_{n}" for n in names.split()}

    t.region = Relation("region", read("region"), "r_regionkey", fields("r", "name"))
    t.nation = Relation(
        "nation", read("nation"), "n_nationkey", fields("n", "name"), {"region": ("n_regionkey", lambda: t.region)}
    )
    t.customer = Relation(
        "customer", read("customer"), "c_custkey", fields("c", "name acctbal mktsegment"), {"nation": ("c_nationkey", lambda: t.nation)}
    )
    t.supplier = Relation(
        "supplier", read("supplier"), "s_suppkey", fields("s", "name acctbal"), {"nation": ("s_nationkey", lambda: t.nation)}
    )
    t.part = Relation("part", read("part"), "p_partkey", fields("p", "name brand type size retailprice"))
    columns = fields("l", "linenumber quantity extendedprice discount tax returnflag linestatus shipdate suppkey partkey")
    lines = partial(Child, frame=read("lineitem"), parent_key="l_orderkey", fields=columns)
    t.orders = Relation(
        "orders",
        read("orders"),
        "o_orderkey",
        fields("o", "orderstatus totalprice orderdate orderpriority"),
        {"customer": ("o_custkey", lambda: t.customer)},
        {"lines": lines("lines", value="l_returnflag"), "quantities": lines("quantities", value="l_quantity")},
    )
    t.event = Relation(
        "event", read("events"), "event_id", {c: c for c in ("ts", "user_id", "event_type", "value")}, timestamp="ts", logical="user_id"
    )
    t.document = Relation("document", read("documents"), "doc_id", {c: c for c in ("text", "lang", "source", "n_chars")})
    return t


def query(name: str, sql: str):
    """Register a query with its SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(tables(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return register


def orders_where(condition: Callable) -> Callable:
    def run(t: SimpleNamespace) -> DataFrame:
        s = Searcher()
        o = s.variable(t.orders)
        return s.add(condition(o, t)).results(sid=o).to_frame()

    return run


def of(relation: str, condition: Callable, **outputs: str) -> Callable:
    """Matches of one variable with its key and the named fields."""

    def run(t: SimpleNamespace) -> DataFrame:
        s = Searcher()
        v = s.variable(getattr(t, relation))
        s.add(condition(v, t))
        return s.results(sid=v, **{k: getattr(v, f) for k, f in outputs.items()}).to_frame()

    return run


HAS = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {})"
ORDERS = "SELECT o_orderkey AS sid FROM orders WHERE "

query("cmp_range", "SELECT o_orderkey AS sid, o_totalprice AS total FROM orders WHERE o_totalprice >= 1e5 AND o_totalprice < 2e5")(
    of("orders", lambda o, t: (o.totalprice >= 1e5) & (o.totalprice < 2e5), total="totalprice")
)
query("bool_not", ORDERS + "NOT (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')")(
    orders_where(lambda o, t: ~((o.orderstatus == "F") | (o.orderpriority == "1-URGENT")))
)
query(
    "str_literal",
    "SELECT p_partkey AS sid, p_type AS type FROM part WHERE contains(p_name, '%') OR starts_with(p_type, 'PROMO') OR suffix(p_type, 'STEEL')",
)(of("part", lambda p, t: p.name.contains("%") | p.type.startswith("PROMO") | p.type.endswith("STEEL"), type="type"))
query(
    "isin_scalar_neg",
    "SELECT c_custkey AS sid, c_mktsegment AS segment FROM customer WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')",
)(of("customer", lambda c, t: ~c.mktsegment.is_in("BUILDING", "AUTOMOBILE"), segment="mktsegment"))
query("isin_empty", "SELECT c_custkey AS sid FROM customer WHERE false")(of("customer", lambda c, t: c.mktsegment.is_in()))
@query(
    "ref_chain",
    """SELECT o_orderkey AS sid, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""",
)
def ref_chain(t: SimpleNamespace) -> DataFrame:
    s = Searcher()
    o = s.variable(t.orders)
    s.add(o.customer.nation.region.name == "ASIA")
    return s.results(sid=o, nation=o.customer.nation.name).to_frame()


@query(
    "ref_chain_null",
    "SELECT o_orderkey AS sid FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE c_custkey IS NULL",
)
def ref_chain_null(t: SimpleNamespace) -> DataFrame:
    solvent = relation_of_frame("solvent", lambda: t.customer.frame().filter("c_acctbal > 0"), "c_custkey", {"name": "c_name"})
    orders = relation_of_frame("orders", t.orders.frame, "o_orderkey", references={"customer": ("o_custkey", lambda: solvent)})
    s = Searcher()
    o = s.variable(orders)
    return s.add(o.customer.sid == None).results(sid=o).to_frame()  # noqa: E711


@query(
    "self_join",
    """SELECT a.s_suppkey AS one, b.s_suppkey AS two FROM supplier a JOIN supplier b
       ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey""",
)
def self_join(t: SimpleNamespace) -> DataFrame:
    nation = relation_of_frame("supplier", t.supplier.frame, "s_suppkey")
    s = Searcher()
    a, b = s.variable(nation), s.variable(nation)
    s.add(a.s_nationkey == b.s_nationkey).add(a.sid != b.sid)
    return s.results(one=a, two=b).to_frame()


@query("theta_join", "SELECT a.s_suppkey AS one, b.s_suppkey AS two FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal")
def theta_join(t: SimpleNamespace) -> DataFrame:
    s = Searcher()
    a, b = s.variable(t.supplier), s.variable(t.supplier)
    return s.add(a.acctbal < b.acctbal).results(one=a, two=b).to_frame()


@query("variable_join", "SELECT o_orderkey AS sid, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def variable_join(t: SimpleNamespace) -> DataFrame:
    s = Searcher()
    o, c = s.variable(t.orders), s.variable(t.customer)
    return s.add(o.customer == c).add(c.acctbal > 5000).results(sid=o, name=c.name).to_frame()


@query("cross_count", "SELECT count(*) AS n FROM nation, region")
def cross_count(t: SimpleNamespace) -> DataFrame:
    s = Searcher()
    s.variable(t.nation), s.variable(t.region)
    return s.frame().agg(F.count(F.lit(1)).alias("n"))


query("has_any", ORDERS + HAS.format("l_returnflag IN ('R', 'N')"))(orders_where(lambda o, t: o.lines.has_any("R", "N")))
query("has_all", ORDERS + HAS.format("l_returnflag = 'R'") + " AND " + HAS.format("l_returnflag = 'A'"))(
    orders_where(lambda o, t: o.lines.has("R") & o.lines.has("A"))
)
query("has_only", ORDERS + "NOT " + HAS.format("l_returnflag NOT IN ('A', 'N')"))(orders_where(lambda o, t: o.lines.has_only("A", "N")))
query("not_has_any", ORDERS + "NOT " + HAS.format("l_returnflag = 'R'"))(orders_where(lambda o, t: ~o.lines.has_any("R")))
query("not_has_only", ORDERS + HAS.format("l_returnflag NOT IN ('A', 'N')"))(orders_where(lambda o, t: ~o.lines.has_only("A", "N")))
query("child_cmp_exist", ORDERS + HAS.format("l_quantity > 49"))(orders_where(lambda o, t: o.quantities > 49))
query("child_cmp_neg", ORDERS + "NOT " + HAS.format("l_quantity > 49"))(orders_where(lambda o, t: ~(o.quantities > 49)))
query("mixed_or", ORDERS + "NOT " + HAS.format("l_returnflag <> 'A'") + " OR o_orderstatus = 'P'")(
    orders_where(lambda o, t: o.lines.has_only("A") | (o.orderstatus == "P"))
)
query("child_len", ORDERS + "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) >= 6")(
    orders_where(lambda o, t: o.lines.length() >= 6)
)
def _line_string(o, t):
    line = o.scope("lines")
    return line.exists(line.linestatus.startswith("O") & (line.returnflag == "N"))


query("child_string", ORDERS + HAS.format("starts_with(l_linestatus, 'O') AND l_returnflag = 'N'"))(orders_where(_line_string))


@query(
    "distinct_count",
    """SELECT o_orderkey AS sid, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS suppliers FROM orders""",
)
def distinct_count(t: SimpleNamespace) -> DataFrame:
    s = Searcher()
    o = s.variable(t.orders)
    line = o.scope("lines")
    return s.results(sid=o, suppliers=line.distinct_count(line.suppkey)).to_frame()


@query("filtered_count", ORDERS + "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) = 2")
def filtered_count(t: SimpleNamespace) -> DataFrame:
    def two(o, t):
        line = o.scope("lines")
        return line.where(line.discount > 0.05).count() == 2

    return orders_where(two)(t)


@query(
    "nested_scope",
    """SELECT c_custkey AS sid FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_quantity > 45)""",
)
def nested_scope(t: SimpleNamespace) -> DataFrame:
    s = Searcher()
    c = s.variable(t.customer)
    order = c.referring(t.orders, "customer")
    line = order.scope("lines")
    return s.add(order.exists(line.exists((line.returnflag == "R") & (line.quantity > 45)))).results(sid=c).to_frame()


@query(
    "sibling_scopes",
    """SELECT o_orderkey AS sid FROM orders WHERE EXISTS (SELECT 1 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
       WHERE a.l_orderkey = o_orderkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'A' AND a.l_quantity = 2 * b.l_quantity)""",
)
def sibling_scopes(t: SimpleNamespace) -> DataFrame:
    s = Searcher()
    o = s.variable(t.orders)
    a, b = o.scope("lines"), o.scope("lines")
    a, b = a.where(a.returnflag == "R"), b.where(b.returnflag == "A")
    doubled = a.quantity._column == 2 * b.quantity._column
    pair = type(a.quantity == 1)(doubled, a.quantity._sources | b.quantity._sources, (), "doubled")
    return s.add(a.exists(b.exists(pair))).results(sid=o).to_frame()


@query("reverse_ref", "SELECT o_orderkey AS sid FROM orders WHERE o_custkey = 42")
def reverse_ref(t: SimpleNamespace) -> DataFrame:
    return orders_where(lambda o, t: o.customer == 42)(t)


def events(as_of: str | None = None, only_latest: bool = False) -> Callable:
    def run(t: SimpleNamespace) -> DataFrame:
        cutoff = F.lit(as_of).cast("timestamp_ntz") if as_of else None
        s = Searcher(as_of=cutoff, only_latest=only_latest)
        e = s.variable(t.event)
        return s.results(sid=e, user_id=e.user_id).to_frame()

    return run


query("as_of", "SELECT event_id AS sid, user_id FROM events WHERE ts <= TIMESTAMP '2024-01-15'")(events("2024-01-15"))
query("only_latest", "SELECT max(event_id) AS sid, user_id FROM events GROUP BY user_id")(events(only_latest=True))
query("latest_as_of", "SELECT max(event_id) AS sid, user_id FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id")(
    events("2024-01-15", True)
)


@query("history", "SELECT event_id AS sid, event_type AS kind FROM events WHERE user_id = 7")
def history(t: SimpleNamespace) -> DataFrame:
    s = Searcher()
    e = s.variable(t.event)
    return s.add(e.logical_id == 7).add_sort(e.sid).results(sid=e, kind=e.event_type).to_frame()


@query("page2", "SELECT o_orderstatus AS status, o_orderkey AS sid FROM orders ORDER BY 1, 2 LIMIT 100 OFFSET 100")
def page2(t: SimpleNamespace) -> DataFrame:
    """The second keyset page, reached by the first one's token: 100 rows on the driver by contract."""
    s = Searcher()
    o = s.variable(t.orders)
    found = s.results(status=o.orderstatus, sid=o.sid)
    by = [PageOrder("status")]
    first = found.page(size=100, order_by=by)
    second = found.page(size=100, order_by=by, cursor=first.next)
    frame = t.orders.frame()
    return frame.sparkSession.createDataFrame([tuple(r) for r in second.rows], "status string, sid long")


@query("topk", "SELECT o_orderkey AS sid, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk(t: SimpleNamespace) -> DataFrame:
    s = Searcher()
    o = s.variable(t.orders)
    return s.add_sort(o.totalprice, descending=True).set_limit(50).results(sid=o, total=o.totalprice).to_frame()


@query("sort_offset", "SELECT c_custkey AS sid FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 30")
def sort_offset(t: SimpleNamespace) -> DataFrame:
    s = Searcher()
    c = s.variable(t.customer)
    return s.add_sort(c.acctbal, descending=True).add_offset(30).set_limit(20).results(sid=c).to_frame()


def parties(t: SimpleNamespace) -> dict[str, DataFrame]:
    """Customers and suppliers with a balance over 9000 as two sources of one shape."""
    out = {}
    for name, relation in (("customers", t.customer), ("suppliers", t.supplier)):
        s = Searcher()
        v = s.variable(relation)
        out[name] = s.add(v.acctbal > 9000).results(sid=v, name=v.name, balance=v.acctbal).to_frame()
    return out


PARTIES = """SELECT 'customers' AS origin, c_custkey AS sid, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000
    UNION ALL SELECT 'suppliers', s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 9000"""


@query("fed_union", PARTIES)
def fed_union(t: SimpleNamespace) -> DataFrame:
    return source_major(parties(t), "sid").drop("_source")


@query("fed_slice", f"SELECT origin, sid, name, balance FROM ({PARTIES}) ORDER BY origin, sid LIMIT 30 OFFSET 5")
def fed_slice(t: SimpleNamespace) -> DataFrame:
    return source_major(parties(t), "sid", limit=30, offset=5).drop("_source")


@query("fed_sorted", f"SELECT origin, sid, name, balance FROM ({PARTIES}) ORDER BY balance DESC NULLS LAST, sid, origin LIMIT 25")
def fed_sorted(t: SimpleNamespace) -> DataFrame:
    return sorted_merge(parties(t), [("balance", True)], "sid", limit=25).drop("_source")


@query("dup_audit", "SELECT c_custkey AS sid, CAST(2 AS BIGINT) AS claims FROM customer JOIN supplier ON c_custkey = s_suppkey")
def dup_audit(t: SimpleNamespace) -> DataFrame:
    ids = {"customers": t.customer.frame().select(F.col("c_custkey").alias("sid")), "suppliers": t.supplier.frame().select(F.col("s_suppkey").alias("sid"))}
    return duplicate_ids(ids, "sid")


@query("dedup_content", "SELECT min(doc_id) AS sid FROM documents GROUP BY text, lang")
def dedup_content(t: SimpleNamespace) -> DataFrame:
    mapped = dataflow.canonical_map(dataflow.with_content_id(t.document.frame(), ["text", "lang"]), "doc_id", ["content_id"])
    return mapped.filter("sid = canonical_sid").select("sid")


@query("dedup_map", "SELECT doc_id AS sid, min(doc_id) OVER (PARTITION BY text, lang) AS canonical_sid FROM documents")
def dedup_map(t: SimpleNamespace) -> DataFrame:
    return dataflow.canonical_map(dataflow.with_content_id(t.document.frame(), ["text", "lang"]), "doc_id", ["content_id"])


@query("meta_conflict", "SELECT count(*) AS n FROM (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT source) > 1)")
def meta_conflict(t: SimpleNamespace) -> DataFrame:
    rows = dataflow.with_content_id(t.document.frame(), ["text"])
    return dataflow.metadata_conflicts(rows, "content_id", ["source"]).agg(F.count(F.lit(1)).alias("n"))


@query("fsck_childless", "SELECT o_orderkey AS sid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def fsck_childless(t: SimpleNamespace) -> DataFrame:
    return dataflow.unreferenced(t.orders.frame(), "o_orderkey", t.orders.children["lines"].frame(), "l_orderkey").select(F.col("o_orderkey").alias("sid"))


@query("fsck_dangling", "SELECT c_custkey AS sid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def fsck_dangling(t: SimpleNamespace) -> DataFrame:
    return dataflow.unreferenced(t.customer.frame(), "c_custkey", t.orders.frame(), "o_custkey").select(F.col("c_custkey").alias("sid"))


@query(
    "fsck_dup_key",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def fsck_dup_key(t: SimpleNamespace) -> DataFrame:
    return dataflow.repeated_keys(t.orders.children["lines"].frame(), ["l_orderkey", "l_linenumber"])


@query(
    "reach",
    """SELECT DISTINCT l_partkey AS sid FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE c_mktsegment = 'BUILDING'""",
)
def reach(t: SimpleNamespace) -> DataFrame:
    """Parts that are reachable from one segment's customers over two kinds of edges."""
    roots = t.customer.frame().filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("sid"))
    orders = t.orders.frame().select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"))
    parts = t.orders.children["lines"].frame().select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return dataflow.followed(dataflow.followed(roots, orders), parts)


@query("dense_sids", "SELECT o_orderkey AS sid, row_number() OVER (ORDER BY o_orderkey) AS final_sid FROM orders")
def dense_sids(t: SimpleNamespace) -> DataFrame:
    return dataflow.dense_numbers(t.orders.frame().select(F.col("o_orderkey").alias("sid")), "sid", "final_sid")


def filtered(relation: str, text: str) -> Callable:
    def run(t: SimpleNamespace) -> DataFrame:
        s = Searcher()
        v = s.variable(getattr(t, relation))
        return s.add(filter_predicate(text, v)).results(sid=v).to_frame()

    return run


query(
    "filter_language",
    ORDERS + "(o_totalprice > 150000 AND starts_with(o_orderpriority, '2')) OR (" + HAS.format("l_returnflag = 'R'") + " AND NOT o_orderstatus = 'F')",
)(filtered("orders", 'totalprice > 150000 AND orderpriority STARTS WITH "2" OR (lines HAS "R" AND NOT orderstatus = "F")'))
query(
    "filter_sets",
    ORDERS + HAS.format("l_returnflag = 'A'") + " AND " + HAS.format("l_returnflag = 'N'") + " AND (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) > 4",
)(filtered("orders", 'lines HAS ALL "A","N" AND lines LENGTH > 4'))
query("filter_only", ORDERS + "NOT " + HAS.format("l_returnflag NOT IN ('N')") + " AND 120000 <= o_totalprice")(
    filtered("orders", 'lines HAS ONLY "N" AND 120000 <= totalprice')
)
query("filter_related", "SELECT o_orderkey AS sid FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0")(
    filtered("orders", 'customer.mktsegment = "BUILDING" AND customer.acctbal < 0')
)
query("filter_unknown", "SELECT c_custkey AS sid FROM customer WHERE c_acctbal IS NOT NULL AND suffix(c_name, '7')")(
    filtered("customer", 'acctbal IS KNOWN AND name ENDS WITH "7" AND _other_thing IS UNKNOWN')
)
