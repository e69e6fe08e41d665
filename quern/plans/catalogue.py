"""The query catalogue: every query of the engine over the driver's tables, with the same question in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import geo, scalars
from quern.functions import text as X
from quern.functions.expressions import Compiler
from quern.operators import changes, graph, search, vector
from quern.operators.permissions import Access
from quern.plans import control, read
from quern.plans.documents import Executor
from quern.plans.read import Reader
from quern.plans.relate import Relations
from quern.plans.tables import store
from quern.streaming.events import subscribe

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def reader(spark, d) -> Reader:
    return Reader(store(spark, d))


def simple(name: str, sql: str, build) -> None:
    """A query that is one call of a reader."""
    query(name, sql)(lambda spark, d: build(reader(spark, d)))


ORDER = "o_orderkey AS uid, o_orderstatus, o_totalprice"
CUSTOMER = "c_custkey AS uid, c_name, c_acctbal"


def order_cols(df):
    return df.select("uid", "o_orderstatus", "o_totalprice")


def customer_cols(df):
    return df.select("uid", "c_name", "c_acctbal")


# scans and lookups
simple("scan_type", "SELECT n_nationkey::BIGINT AS uid, n_name FROM nation", lambda r: r.list("Nation").select("uid", "n_name"))
simple("unique_get", f"SELECT {ORDER} FROM orders WHERE o_orderkey = 7", lambda r: order_cols(r.get("Order", "0x7")))
simple("unique_field", f"SELECT {CUSTOMER} FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)", lambda r: customer_cols(r.get("Customer", c_name=r.store.frame("Customer").agg(F.min("c_name")).first()[0])))
simple("unique_miss", f"SELECT {CUSTOMER} FROM customer WHERE c_name = 'nobody'", lambda r: customer_cols(r.get("Customer", c_name="nobody")))
query("id_list", "SELECT r_regionkey::BIGINT AS uid, r_name FROM region WHERE r_regionkey IN (3, 1)")(lambda spark, d: read.from_ids(store(spark, d), "Region", [3, 1, 99]).select("uid", "r_name"))
simple("interface_scan", "SELECT '__' || 'x' AS t, 0::BIGINT AS n WHERE false UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier", lambda r: r.store.frame("Party").groupBy(F.col("__typename").alias("t")).agg(F.count(F.lit(1)).alias("n")))
simple("ordered_scan", "SELECT c_custkey AS uid, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25", lambda r: r.list("Customer", sort=[("c_acctbal", "ASC")], first=25).select("uid", "c_acctbal"))

# one filter operator each
for _name, _op, _value, _sql in [
    ("eq", "eq", "F", "o_orderstatus = 'F'"),
    ("ne", "ne", "F", "o_orderstatus <> 'F'"),
    ("in", "in", ["F", "P", None], "o_orderstatus IN ('F', 'P')"),
]:
    simple(f"filter_{_name}", f"SELECT {ORDER} FROM orders WHERE {_sql}", lambda r, o=_op, v=_value: order_cols(r.rows("Order", {"o_orderstatus": {o: v}})))
for _name, _value, _sql in [("gt", 200000.0, "> 200000"), ("ge", 200000.0, ">= 200000"), ("lt", 20000.0, "< 20000"), ("le", 20000.0, "<= 20000"), ("between", [50000.0, 60000.0], "BETWEEN 50000 AND 60000")]:
    simple(f"filter_{_name}", f"SELECT {ORDER} FROM orders WHERE o_totalprice {_sql}", lambda r, o=_name, v=_value: order_cols(r.rows("Order", {"o_totalprice": {o: v}})))
simple("filter_contains", "SELECT p_partkey AS uid, p_name FROM part WHERE contains(p_name, 'ring')", lambda r: r.rows("Part", {"p_name": {"contains": "ring"}}).select("uid", "p_name"))
simple("filter_shorthand", "SELECT p_partkey AS uid, p_name FROM part WHERE p_size = 7", lambda r: r.rows("Part", {"p_size": 7}).select("uid", "p_name"))
simple(
    "filter_and_or_not",
    f"SELECT {ORDER} FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 250000) AND NOT (o_orderpriority = '1-URGENT' AND o_totalprice < 100000)",
    lambda r: order_cols(r.rows("Order", {"and": [{"or": [{"o_orderstatus": {"eq": "F"}}, {"o_totalprice": {"gt": 250000.0}}]}, {"not": {"o_orderpriority": {"eq": "1-URGENT"}, "o_totalprice": {"lt": 100000.0}}}]})),
)
simple("filter_two_ops", f"SELECT {ORDER} FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 30000", lambda r: order_cols(r.rows("Order", {"o_totalprice": {"ge": 1000.0, "lt": 30000.0}})))
simple("filter_date", f"SELECT {ORDER} FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'", lambda r: order_cols(r.rows("Order", {"o_orderdate": {"ge": "1997-01-01"}})))

simple("prefix_scan", "SELECT p_partkey AS uid, p_name FROM part WHERE starts_with(p_name, 'small')", lambda r: read.prefixed(r.store.frame("Part"), "p_name", "small").select("uid", "p_name"))
simple("range_scan", "SELECT c_custkey AS uid, c_name FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000300'", lambda r: read.ranged(r.store.frame("Customer"), "c_name", "Customer#000000100", "Customer#000000300").select("uid", "c_name"))

# relations
simple("relation_semi", f"SELECT {ORDER} FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)", lambda r: order_cols(r.rows("Order", {"lines": {"l_quantity": {"gt": 49.0}}})))
simple(
    "relation_semi_two_level",
    "SELECT r_regionkey::BIGINT AS uid, r_name FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c_acctbal > 9950)",
    lambda r: r.rows("Region", {"nations": {"customers": {"c_acctbal": {"gt": 9950.0}}}}).select("uid", "r_name"),
)
simple("relation_anti", f"SELECT {CUSTOMER} FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lambda r: customer_cols(r.rows("Customer", {"not": {"orders": {}}})))
simple("relation_exists", f"SELECT {CUSTOMER} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lambda r: customer_cols(r.rows("Customer", {"orders": {}})))
simple(
    "relation_in_or",
    f"SELECT {CUSTOMER} FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    lambda r: customer_cols(r.rows("Customer", {"or": [{"c_acctbal": {"gt": 9000.0}}, {"orders": {"o_totalprice": {"gt": 400000.0}}}]})),
)
simple("relation_back", "SELECT n_nationkey::BIGINT AS uid, n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'", lambda r: r.rows("Nation", {"region": {"r_name": {"eq": "ASIA"}}}).select("uid", "n_name"))


@query("relation_expand", "SELECT l_orderkey AS order_uid, l_quantity, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 300000")
def _(spark, d):
    r = reader(spark, d)
    lines = r.store.frame("Line").select("order", "l_quantity", "l_returnflag")
    orders = r.rows("Order", {"o_totalprice": {"gt": 300000.0}}).select("uid")
    return lines.join(orders, F.col("order") == F.col("uid")).select(F.col("order").alias("order_uid"), "l_quantity", "l_returnflag")


@query("relation_per_parent_top", "SELECT o_custkey AS customer, o_orderkey AS uid, position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS position FROM orders) WHERE position <= 2")
def _(spark, d):
    return Relations(reader(spark, d)).children("Customer", "orders", sort=[("o_totalprice", "DESC")], first=2).select(F.col("src").alias("customer"), "uid", "position")


@query("relation_per_parent_page", "SELECT o_custkey AS customer, o_orderkey AS uid FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus = 'F') WHERE position BETWEEN 2 AND 4")
def _(spark, d):
    return Relations(reader(spark, d)).children("Customer", "orders", filter={"o_orderstatus": {"eq": "F"}}, offset=1, first=3).select(F.col("src").alias("customer"), "uid")


@query("relation_many_to_many", "SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem")
def _(spark, d):
    return Relations(reader(spark, d)).pairs_with_children("Part", "suppliers").select(F.col("src").alias("part"), F.col("uid").alias("supplier"))


@query("three_hop", "SELECT r_name, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def _(spark, d):
    s = store(spark, d)
    path = s.frame("Region").select(F.col("uid").alias("rk"), "r_name").join(s.pairs("Region", "nations").toDF("rk", "nk"), "rk").join(s.pairs("Nation", "customers").toDF("nk", "ck"), "nk")
    orders = s.frame("Order").select(F.col("customer").alias("ck"), "o_totalprice")
    return path.join(orders, "ck").groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("nested_selection", "SELECT r_name AS name, list(n_name ORDER BY n_name DESC, n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, d):
    df = Relations(reader(spark, d)).select("Region", {"name": {"field": "r_name"}, "nations": {"args": {"sort": {"n_name": "DESC"}}, "fields": {"n_name": True}}})
    return df.select("name", F.transform("nations", lambda x: x["n_name"]).alias("nations"))


# aggregates
for _name, _fn, _expr, _sql in [
    ("count", "count", "c_acctbal", "count(c_acctbal)"),
    ("sum", "math::sum", "c_acctbal", "round(sum(c_acctbal), 2)"),
    ("mean", "math::mean", "c_acctbal", "round(avg(c_acctbal), 4)"),
    ("min", "math::min", "c_acctbal", "min(c_acctbal)"),
    ("max", "math::max", "c_acctbal", "max(c_acctbal)"),
]:
    _digits = {"sum": 2, "mean": 4}.get(_name)
    simple(f"agg_{_name}", f"SELECT {_sql} AS v FROM customer", lambda r, f=_fn, e=_expr, g=_digits: r.aggregate("Customer", [("v", f, e)]).select((F.round("v", g) if g else F.col("v")).alias("v")))
simple("agg_int_sum", "SELECT sum(p_size)::BIGINT AS v FROM part", lambda r: r.aggregate("Part", [("v", "math::sum", "p_size")]))
simple(
    "agg_group",
    "SELECT o_orderstatus AS status, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1",
    lambda r: r.aggregate("Order", [("n", "count", None), ("total", "math::sum", "o_totalprice"), ("mean", "math::mean", "o_totalprice"), ("lo", "math::min", "o_totalprice"), ("hi", "math::max", "o_totalprice")], [("status", "o_orderstatus")]).withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)}),
)
simple(
    "agg_group_expr",
    "SELECT p_size % 5 AS bucket, count(*)::BIGINT AS n FROM part WHERE p_retailprice > 1000 GROUP BY 1",
    lambda r: r.aggregate("Part", [("n", "count", None)], [("bucket", "p_size % 5")], where="p_retailprice > 1000").withColumn("bucket", F.col("bucket").cast("int")),
)
simple("agg_empty_global", "SELECT count(*)::BIGINT AS n, sum(o_totalprice) AS total FROM orders WHERE false", lambda r: r.aggregate("Order", [("n", "count", None), ("total", "math::sum", "o_totalprice")], filter={"o_totalprice": {"lt": -1.0}}))
simple("count_filtered", "SELECT count(*)::BIGINT AS count FROM orders WHERE o_totalprice > 150000", lambda r: r.count("Order", {"o_totalprice": {"gt": 150000.0}}))
simple("count_all", "SELECT count(*)::BIGINT AS count FROM lineitem", lambda r: r.count("Line"))
simple("facet", "SELECT event_type AS value, count(*)::BIGINT AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", lambda r: r.facet("Event", "event_type", limit=3))
query("hist_quantiles", "SELECT event_type, list_sort(list(value))[(count(*) // 2)::INTEGER + 1] AS p50, list_sort(list(value))[floor(count(*) * 0.9)::INTEGER + 1] AS p90 FROM events GROUP BY 1")(lambda spark, d: read.histogram_quantiles(store(spark, d).frame("Event"), "event_type", "value"))


# order and pages
@query("sort_multi", "SELECT row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey)::INTEGER AS position, c_custkey AS uid FROM customer ORDER BY 1 LIMIT 50")
def _(spark, d):
    top = reader(spark, d).list("Customer", sort=[("c_mktsegment", "ASC"), ("c_acctbal", "DESC")], first=50)
    return read.numbered(top, [F.col("c_mktsegment"), F.desc("c_acctbal"), F.col("uid")]).select("position", "uid")


@query("sort_desc", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS position, o_orderkey AS uid FROM orders ORDER BY 1 LIMIT 10")
def _(spark, d):
    return read.numbered(reader(spark, d).list("Order", sort={"o_totalprice": "DESC"}, first=10), [F.desc("o_totalprice"), F.col("uid")]).select("position", "uid")


@query("sort_computed", "SELECT row_number() OVER (ORDER BY c_acctbal * 2 - 100 DESC, c_custkey DESC)::INTEGER AS position, c_custkey AS uid, c_acctbal * 2 - 100 AS net FROM customer ORDER BY 1 LIMIT 10")
def _(spark, d):
    return read.numbered(reader(spark, d).list("Customer", sort={"net": "DESC"}, first=10), [F.desc("net"), F.desc("uid")]).select("position", "uid", "net")


simple("first", "SELECT c_custkey AS uid FROM customer ORDER BY 1 LIMIT 7", lambda r: r.list("Customer", first=7).select("uid"))
simple("first_zero", "SELECT c_custkey AS uid FROM customer LIMIT 0", lambda r: r.list("Customer", first=0).select("uid"))
simple("offset_first", "SELECT c_custkey AS uid FROM customer ORDER BY c_acctbal DESC, 1 LIMIT 5 OFFSET 20", lambda r: r.list("Customer", sort={"c_acctbal": "DESC"}, offset=20, first=5).select("uid"))
simple("cursor_after", "SELECT c_custkey AS uid FROM customer WHERE c_custkey > 20 ORDER BY 1 LIMIT 5 OFFSET 1", lambda r: r.list("Customer", after=20, offset=1, first=5).select("uid"))
simple(
    "cursor_after_sorted",
    "SELECT c_custkey AS uid FROM customer, (SELECT c_acctbal AS b, c_custkey AS k FROM customer WHERE c_custkey = 20) WHERE c_acctbal < b OR (c_acctbal = b AND c_custkey > k) ORDER BY c_acctbal DESC, 1 LIMIT 5",
    lambda r: r.list("Customer", sort={"c_acctbal": "DESC"}, after=20, first=5).select("uid"),
)
simple("cursor_absent", "SELECT c_custkey AS uid FROM customer WHERE false", lambda r: r.list("Customer", after=-5).select("uid"))
simple("cursor_absent_filtered", "SELECT c_custkey AS uid FROM customer WHERE c_acctbal > 9900", lambda r: r.list("Customer", filter={"c_acctbal": {"gt": 9900.0}}, after=-5).select("uid"))


# set operations
def _two(r):
    return r.rows("Customer", {"c_acctbal": {"gt": 5000.0}}), r.rows("Customer", {"c_mktsegment": {"eq": "BUILDING"}})


simple("union_sources", "SELECT c_custkey AS uid FROM customer WHERE c_acctbal > 5000 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", lambda r: read.union_of(list(_two(r))).select("uid"))
simple("intersect_sources", "SELECT c_custkey AS uid FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", lambda r: read.intersection_of(list(_two(r))).select("uid"))
simple("except_sources", "SELECT c_custkey AS uid FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", lambda r: read.except_of(*_two(r)).select("uid"))


# expressions
def expressions(name: str, type_name: str, sql: str, spec: dict[str, str], strict: bool = True) -> None:
    def run(spark, d):
        df = store(spark, d).frame(type_name)
        c = Compiler(df.schema, strict)
        return df.select("uid", *(c.column(e).alias(n) for n, e in spec.items()))

    query(name, sql)(run)


expressions("expr_arith", "Part", "SELECT p_partkey AS uid, p_size::BIGINT * 3 - 7 + p_partkey AS a, p_retailprice / 4 + p_size AS b, -p_size::BIGINT AS c FROM part", {"a": "p_size * 3 - 7 + uid", "b": "p_retailprice / 4 + p_size", "c": "-p_size"})
expressions("expr_mod_div", "Part", "SELECT p_partkey AS uid, (p_size::BIGINT - 25) // 4 AS q, (p_size::BIGINT - 25) % 4 AS r FROM part", {"q": "(p_size - 25) / 4", "r": "(p_size - 25) % 4"})
expressions("expr_compare", "Part", "SELECT p_partkey AS uid, p_size >= 10 AS a, p_retailprice < 1200 AS b, p_name == 'small ring' AS c, p_brand <> 'Brand#1' AS d, contains(p_name, 'in') AS e FROM part", {"a": "p_size >= 10", "b": "p_retailprice < 1200.0", "c": "p_name == 'small ring'", "d": 'p_brand != "Brand#1"', "e": "p_name contains 'in'"})
expressions("expr_logic", "Part", "SELECT p_partkey AS uid, (p_size > 10 AND p_retailprice < 1500) OR NOT (p_size = 3) AS v FROM part", {"v": "(p_size > 10 and p_retailprice < 1500) or not (p_size == 3)"})
expressions("expr_null", "Part", "SELECT p_partkey AS uid, NULL::BIGINT IS NULL AND p_size IS NULL AS v, CASE WHEN p_size = 10 THEN NULL ELSE 100 // (p_size::BIGINT - 10) END AS w FROM part", {"v": "missing == p_size", "w": "100 / (p_size - 10)"}, strict=False)
expressions("fn_string", "Part", "SELECT p_partkey AS uid, lower(p_brand) AS a, upper(p_name) AS b, trim('  ' || p_name || ' ') AS c, length(p_type)::BIGINT AS d, p_brand || '/' || p_name AS e FROM part", {"a": "lower(p_brand)", "b": "upper(p_name)", "c": "trim(concat('  ', p_name, ' '))", "d": "len(p_type)", "e": "concat(p_brand, '/', p_name)"})
expressions("fn_math", "Customer", "SELECT c_custkey AS uid, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal) AS c, round(c_acctbal) AS d, abs(c_custkey - 50) AS e FROM customer", {"a": "abs(c_acctbal)", "b": "ceil(c_acctbal)", "c": "floor(c_acctbal)", "d": "round(c_acctbal)", "e": "abs(uid - 50)"})
expressions("fn_len_list", "Embedding", "SELECT vec_id AS uid, len(embedding)::BIGINT AS n, embedding[1]::DOUBLE AS head, embedding[100]::DOUBLE AS gone FROM embeddings", {"n": "len(embedding)", "head": "embedding[0]", "gone": "embedding[99]"})
expressions("path_walk", "Event", "SELECT event_id AS uid, (props->>'$.k')::BIGINT AS k FROM events", {"k": "props.k"})
simple("compute_field", "SELECT c_custkey AS uid, c_acctbal * 2 - 100 AS net, c_acctbal + c_custkey AS extra FROM customer", lambda r: r.list("Customer", compute={"extra": "c_acctbal + uid"}).select("uid", "net", "extra"))
simple("where_expr", f"SELECT {ORDER} FROM orders WHERE o_totalprice / 2 + 100 > 120000 AND o_orderstatus <> 'P'", lambda r: order_cols(r.list("Order", where="o_totalprice / 2 + 100 > 120000 and o_orderstatus != 'P'")))


@query("if_else", "SELECT c_custkey AS uid, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 9000 THEN 'rich' END AS class FROM customer")
def _(spark, d):
    df = store(spark, d).frame("Customer")
    return df.select("uid", control.if_else(df.schema, [("c_acctbal < 0", "'debt'"), ("c_acctbal > 9000", "'rich'")]).alias("class"))


@query("loop_list", "SELECT vec_id AS uid, embedding[1]::DOUBLE * 2 + 1 AS head, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2 + 1)), 4) AS total, len(embedding) AS n FROM embeddings")
def _(spark, d):
    df = store(spark, d).frame("Embedding")
    moved = control.each(df.schema, "embedding", "x", "x * 2.0 + 1.0")
    return df.select("uid", F.get(moved, F.lit(0)).alias("head"), F.round(F.aggregate(moved, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size(moved).cast("bigint").alias("n"))


@query("sequence_return", "SELECT n_nationkey::BIGINT AS uid FROM nation WHERE n_regionkey = 2")
def _(spark, d):
    r = reader(spark, d)
    return control.sequence([lambda: r.rows("Nation").select("uid"), lambda: control.give(r.rows("Nation", {"region": {"r_name": {"ne": ""}}}).filter("region = 2").select("uid")), lambda: r.rows("Region").select("uid")])


@query("expression_value", "SELECT 15::BIGINT AS value")
def _(spark, d):
    return control.value_of(spark, "len('abc') * 4 + 3")


@query("subquery_in", f"SELECT {ORDER} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 40)")
def _(spark, d):
    r = reader(spark, d)
    ids = r.list("Customer", filter={"c_mktsegment": {"eq": "MACHINERY"}}, first=40).select(F.col("uid").alias("customer"))
    return order_cols(r.store.frame("Order").join(ids, "customer", "left_semi"))


# vectors
Q = [round(((k * 37) % 101) / 101 - 0.5, 4) for k in range(64)]
_QSQL = "[" + ", ".join(f"{x}::DOUBLE" for x in Q) + "]"
_L2 = f"sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], {_QSQL}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_COS = f"1 - list_cosine_similarity(embedding::DOUBLE[], {_QSQL})"
simple("knn_l2", f"SELECT vec_id AS uid, round(1 / (1 + {_L2}), 6) AS score FROM embeddings ORDER BY {_L2}, 1 LIMIT 10", lambda r: vector.nearest(r.store.frame("Embedding"), "embedding", Q).select("uid", F.round("_score", 6).alias("score")))
simple("knn_filtered", f"SELECT vec_id AS uid, round({_L2}, 6) AS distance FROM embeddings WHERE label = 1 ORDER BY {_L2}, 1 LIMIT 5", lambda r: r.list("Embedding", filter={"label": 1}, near_vector=Q, first=5).select("uid", F.round("_distance", 6).alias("distance")))
simple("cosine_rerank", f"SELECT vec_id AS uid, round({_COS}, 6) AS distance FROM embeddings WHERE label <> 1 ORDER BY {_COS}, 1 LIMIT 8", lambda r: r.list("Embedding", filter={"label": {"ne": 1}}, near_vector=Q, metric="cosine", first=8).select("uid", F.round("_distance", 6).alias("distance")))
simple(
    "knn_satellite",
    f"SELECT doc_id AS uid, lang FROM documents JOIN (SELECT vec_id, {_L2} AS dist FROM embeddings ORDER BY 2, 1 LIMIT 6) ON vec_id = doc_id",
    lambda r: vector.through_satellites(r.store.frame("Document"), r.store.frame("Embedding"), "document", "embedding", Q, 6).select("uid", "lang"),
)

# text; one tokeniser on both sides: lower case, runs of letters and digits, accents kept
_TOK = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _docs(r):
    return r.store.frame("Document").select("uid", "text", "lang")


def _matching(r, q, every):
    return _docs(r).filter(X.matches(X.tokens(F.col("text"), fold=False), X.parse_query(q, fold=False), every)).select("uid")


simple("text_all_terms", f"SELECT doc_id AS uid FROM documents WHERE list_has_all({_TOK}, ['the', 'there', 'thing'])", lambda r: _matching(r, "The there THING", True))
simple("text_any_terms", f"SELECT doc_id AS uid FROM documents WHERE list_has_any({_TOK}, ['keit', 'thing', 'eau'])", lambda r: _matching(r, "keit thing eau", False))
simple("text_phrase", f"SELECT doc_id AS uid FROM documents WHERE contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' of the ')", lambda r: _matching(r, '"of the"', True))
simple("text_prefix", f"SELECT doc_id AS uid FROM documents WHERE len(list_filter({_TOK}, lambda x: starts_with(x, 'thati'))) > 0", lambda r: _matching(r, "thati*", True))
simple("text_substring", "SELECT doc_id AS uid FROM documents WHERE contains(lower(text), 'heit')", lambda r: r.rows("Document", {"text": {"trigram": "HEIT"}}).select("uid"))
_BM25 = f"""WITH t AS (SELECT doc_id, {_TOK} AS toks FROM documents), f AS (SELECT doc_id, len(toks)::DOUBLE AS l, %s FROM t),
s AS (SELECT count(*)::DOUBLE AS n, avg(l) AS m, %s FROM f), r AS (SELECT doc_id AS uid, %s AS score FROM f, s WHERE %s)"""


def bm25_sql(words: list[str]) -> str:
    f = ", ".join(f"len(list_filter(toks, lambda x: x = '{w}'))::DOUBLE AS f{k}" for k, w in enumerate(words))
    n = ", ".join(f"sum((f{k} > 0)::INTEGER)::DOUBLE AS d{k}" for k in range(len(words)))
    score = " + ".join(f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * l / m))" for k in range(len(words)))
    return _BM25 % (f, n, score, " OR ".join(f"f{k} > 0" for k in range(len(words))))


simple("text_bm25", bm25_sql(["thing", "ner", "keit"]) + " SELECT uid, round(score, 6) AS score FROM r ORDER BY r.score DESC, uid LIMIT 20", lambda r: search.bm25(_docs(r), "text", "thing ner keit", fold=False).orderBy(F.desc("_score"), "uid").limit(20).select("uid", F.round("_score", 6).alias("score")))
_RANK = "SELECT uid, row_number() OVER (ORDER BY score DESC, uid) AS k FROM r ORDER BY k LIMIT 100"
simple(
    "text_multi_rrf",
    f"WITH a AS ({bm25_sql(['thing'])} {_RANK}), b AS ({bm25_sql(['ner', 'eau'])} {_RANK}) SELECT uid, round(sum(part), 8) AS score FROM (SELECT uid, 2.0::DOUBLE / (60 + k) AS part FROM a UNION ALL SELECT uid, 1.0::DOUBLE / (60 + k) FROM b) GROUP BY uid ORDER BY sum(part) DESC, uid LIMIT 15",
    lambda r: search.multi_rrf(_docs(r), [search.Spec("text", "anyofterms", "thing", 2.0, fold=False), search.Spec("text", "anyofterms", "ner eau", fold=False)], 15).select("uid", F.round("_score", 8).alias("score")),
)


simple(
    "hybrid_rrf",
    f"WITH a AS ({bm25_sql(['and'])} {_RANK}), b AS (SELECT vec_id AS uid, row_number() OVER (ORDER BY {_L2}, vec_id) AS k FROM embeddings ORDER BY k LIMIT 100) SELECT coalesce(a.uid, b.uid) AS uid, round(coalesce(1.0::DOUBLE / (60 + a.k), 0) + coalesce(1.0::DOUBLE / (60 + b.k), 0), 8) AS score FROM a FULL JOIN b ON a.uid = b.uid ORDER BY coalesce(1.0::DOUBLE / (60 + a.k), 0) + coalesce(1.0::DOUBLE / (60 + b.k), 0) DESC, 1 LIMIT 12",
    lambda r: search.hybrid(_docs(r), search.Spec("text", "anyofterms", "and"), r.store.frame("Embedding"), "embedding", Q, 12).select("uid", F.round("_score", 8).alias("score")),
)
simple("text_stemmed", None, lambda r: r.rows("Document", {"text": {"anyoftext": "things running"}}).select("uid"))
simple("snippet", None, lambda r: search.search(_docs(r), search.Spec("text", "anyofterms", "thing"), 20).select("uid", X.snippet(terms=X.parse_query("thing"))(F.col("text")).alias("snippet")))


# traversal: parts form a tree with three children per node
def _tree(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").filter("p_partkey > 0").select(F.expr("(p_partkey - 1) div 3").alias("src"), F.col("p_partkey").alias("dst"))


_WALK = "WITH RECURSIVE e AS (SELECT (p_partkey - 1) // 3 AS src, p_partkey AS dst FROM part WHERE p_partkey > 0), w(uid, depth, parent) AS (SELECT 5::BIGINT, 0, NULL::BIGINT UNION ALL SELECT dst, depth + 1, src FROM w JOIN e ON src = uid WHERE depth < 4)"


def _root(spark, uid=5):
    return spark.createDataFrame([(uid,)], "uid bigint")


query("bfs_levels", f"{_WALK} SELECT uid, depth, parent FROM w")(lambda spark, d: graph.levels(_tree(spark, d), _root(spark), 4))
query("bfs_collect", f"{_WALK} SELECT uid FROM w WHERE depth >= 2")(lambda spark, d: graph.collect_all(_tree(spark, d), _root(spark), 2, 4))
query("bfs_terminal", f"{_WALK} SELECT uid FROM w WHERE depth = (SELECT max(depth) FROM w)")(lambda spark, d: graph.terminal(_tree(spark, d), _root(spark), 1, 4))
query("bfs_shortest", "WITH RECURSIVE w(uid, up) AS (SELECT 1234::BIGINT, 0 UNION ALL SELECT (uid - 1) // 3, up + 1 FROM w WHERE uid > 0) SELECT (SELECT max(up) FROM w)::INTEGER - up AS step, uid FROM w")(lambda spark, d: graph.shortest_path(_tree(spark, d), _root(spark, 0), 1234))


# change logs: events as cells (user, type)
def _log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    ts = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"), F.lit(0).alias("counter"), F.col("event_id").alias("node"))
    return e.select(F.col("user_id").alias("uid"), F.col("event_type").alias("field"), F.col("value").cast("string").alias("value"), ts.alias("ts"), F.lit(False).alias("deleted"), "event_id", F.col("value").alias("v"))


query("lww_merge", "SELECT user_id AS uid, event_type AS field, arg_max(event_id, (epoch_ms(ts), event_id)) AS event_id FROM events GROUP BY 1, 2")(lambda spark, d: changes.merge_cells(_log(spark, d)).select("uid", "field", "event_id"))


@query("tombstone_delete", "SELECT user_id AS uid, arg_max(event_id, (epoch_ms(ts), event_id)) AS event_id FROM events GROUP BY 1 HAVING arg_max(event_type, (epoch_ms(ts), event_id)) <> 'error'")
def _(spark, d):
    log = _log(spark, d).withColumn("deleted", F.col("field") == "error").withColumn("field", F.lit("state"))
    return changes.merge_cells(log).select("uid", "event_id")


@query("fingerprint_ranges", "SELECT ts::DATE AS day, count(*)::BIGINT AS n, bit_xor((event_id * 7919 + user_id * 104729) % 1000003)::BIGINT AS hash FROM events GROUP BY 1")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    item = (F.col("event_id") * 7919 + F.col("user_id") * 104729) % 1000003  # a hash that SQL can repeat
    return changes.fingerprints(e, F.to_date("ts"), item=item).select(F.col("bucket").alias("day"), "n", F.col("fingerprint").alias("hash"))


@query("anti_entropy", "SELECT event_id FROM events WHERE event_id % 97 = 0")
def _(spark, d):
    log = _log(spark, d).select("event_id", "uid", "field", F.col("ts.millis").alias("millis"))
    return changes.differences(log, log.filter("event_id % 97 <> 0"), "millis div 86400000", "event_id", "uid", "field")[0].select("event_id")


query("history_range", "SELECT event_id, user_id AS uid FROM events WHERE epoch_ms(ts) * 1000000 + event_id BETWEEN 1704500000000000017 AND 1704900000000000004")(lambda spark, d: changes.history(_log(spark, d), (1704500000000, 0, 17), (1704900000000, 0, 4)).select("event_id", "uid"))


@query("anti_entropy_repair", "SELECT event_id, user_id AS uid, n FROM events, (SELECT unnest([1, 2])::INTEGER AS n) WHERE event_id % (89 * 97) <> 0")
def _(spark, d):
    log = _log(spark, d).select("event_id", "uid", F.col("ts.millis").alias("millis"))
    both = changes.repair(log.filter("event_id % 89 <> 0"), log.filter("event_id % 97 <> 0"), "millis div 86400000", "event_id", "uid")
    one, two = (x.select("event_id", "uid", F.lit(n).alias("n")) for n, x in enumerate(both, 1))
    return one.union(two)


@query("quarantine_retry", "SELECT event_id, true AS applied FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') UNION ALL SELECT event_id, false FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def _(spark, d):
    # a signup makes the node known; what came before it in another batch waits
    log = _log(spark, d).withColumn("field", F.when(F.col("field") == "signup", "_type").otherwise(F.col("field")))
    early, late = log.filter("field <> '_type'"), log.filter("field = '_type'")
    nobody = log.select("uid").limit(0)
    first, parked = changes.with_rejects(log.limit(0), early, "known", nobody)
    then, parked = changes.with_rejects(parked, late, "known", nobody)
    return first.union(then).select("event_id", F.lit(True).alias("applied")).union(parked.select("event_id", F.lit(False).alias("applied")))


query("subscription_filter", "SELECT event_id AS uid, event_type FROM events WHERE event_type IN ('signup', 'purchase')")(lambda spark, d: subscribe(store(spark, d).frame("Event"), ["signup", "purchase"], "event_type").select("uid", "event_type"))


@query("metrics_range", "SELECT event_type, count(*)::BIGINT AS n, min(ts) AS first_ts, list(value ORDER BY ts, value)[1] AS first_value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10' GROUP BY 1")
def _(spark, d):
    got = read.metrics_range(store(spark, d).frame("Event"), "event_type", "ts", "value", "2024-01-05", "2024-01-10")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_ts"), F.min_by("v", F.struct("t", "v")).alias("first_value"))


query("last_traces", "SELECT event_id AS uid FROM events ORDER BY ts DESC, event_id LIMIT 50")(lambda spark, d: store(spark, d).frame("Event").orderBy(F.desc("ts"), "uid").limit(50).select("uid"))


@query("window_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    """An extension: event-time windows."""
    from quern.streaming.events import windowed_counts

    return windowed_counts(spark.read.parquet(f"{d}/events.parquet"), "ts", "1 hour", "10 minutes", "event_type").select(F.col("window.start").alias("hour"), "event_type", "n")


# geography on points derived from ids
def _points(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("uid"), F.struct(((F.col("c_custkey") * 37 % 1800) / 10 - 90).alias("latitude"), ((F.col("c_custkey") * 91 % 3600) / 10 - 180).alias("longitude")).alias("p"))


_PSQL = "(SELECT c_custkey AS uid, (c_custkey * 37 % 1800) / 10 - 90 AS lat, (c_custkey * 91 % 3600) / 10 - 180 AS lon FROM customer)"
query("geo_near", f"SELECT uid FROM {_PSQL} WHERE 2 * 6371000 * asin(sqrt(least(1.0, pow(sin((radians(40.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin((radians(-70.0) - radians(lon)) / 2), 2)))) <= 3000000")(lambda spark, d: _points(spark, d).filter(geo.distance(F.col("p"), 40.0, -70.0) <= 3_000_000).select("uid"))


def _box(a, b, c, d):
    return [{"latitude": y, "longitude": x} for y, x in ((a, c), (a, d), (b, d), (b, c))]


query("geo_within", f"SELECT uid FROM {_PSQL} WHERE lat > -30.05 AND lat < 40.05 AND lon > -100.05 AND lon < 50.05 AND NOT (lat >= -10.05 AND lat <= 10.05 AND lon >= -20.05 AND lon <= 20.05)")(lambda spark, d: _points(spark, d).filter(geo.within(F.col("p"), {"exterior": _box(-30.05, 40.05, -100.05, 50.05), "interiors": [_box(-10.05, 10.05, -20.05, 20.05)]})).select("uid"))


@query("geo_intersects", f"SELECT uid FROM {_PSQL} WHERE lat <= 10.05 AND lat + 5 >= -10.05 AND lon <= 20.05 AND lon + 5 >= -20.05")
def _(spark, d):
    p = F.col("p")
    corner = lambda y, x: F.struct((p["latitude"] + y).alias("latitude"), (p["longitude"] + x).alias("longitude"))
    own = F.struct(F.array(corner(0, 0), corner(0, 5), corner(5, 5), corner(5, 0)).alias("exterior"), F.array().cast("array<array<struct<latitude:double,longitude:double>>>").alias("interiors"))
    return _points(spark, d).withColumn("a", own).filter(geo.intersects(F.col("a"), {"exterior": _box(-10.05, 10.05, -20.05, 20.05)})).select("uid")


# permissions: a region's managers manage its nations, a nation's agents serve its customers
ACL = """
entity user {}
entity region { relation manager @user }
entity nation { relation region @region  relation agent @user  relation blocked @user
  permission manage = region.manager  permission serve = (agent or manage) not blocked }
entity customer { relation nation @nation  permission view = nation.serve }
"""


def _access(spark, d):
    u = F.lit(None).cast("string").alias("subject_relation")
    row = lambda df, e, i, r, t, s: df.select(F.lit(e).alias("entity_type"), F.expr(i).cast("bigint").alias("entity_id"), F.lit(r).alias("relation"), F.lit(t).alias("subject_type"), F.expr(s).cast("bigint").alias("subject_id"), u)
    reg, nat, cus = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation", "customer"))
    parts = [row(reg, "region", "r_regionkey", "manager", "user", "r_regionkey + 100"), row(nat, "nation", "n_nationkey", "region", "region", "n_regionkey"), row(nat, "nation", "n_nationkey", "agent", "user", "n_nationkey % 7"), row(nat.filter("n_nationkey % 4 = 0"), "nation", "n_nationkey", "blocked", "user", "n_nationkey % 7"), row(cus, "customer", "c_custkey", "nation", "nation", "c_nationkey")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return Access(spark, ACL, out)


query("acl_check", "WITH s AS (SELECT n_nationkey AS k, n_nationkey % 7 AS u FROM nation WHERE n_nationkey % 4 <> 0 UNION SELECT n_nationkey, n_regionkey + 100 FROM nation) SELECT c_custkey AS entity, u::BIGINT AS subject FROM customer JOIN s ON k = c_nationkey")(lambda spark, d: _access(spark, d).allowed("customer", "view"))
query(
    "acl_bulk",
    "SELECT 'nation' AS entity_type, n_nationkey::BIGINT AS entity_id, 'serve' AS permission, n_nationkey % 7 = 3 AND n_nationkey % 4 <> 0 AS allowed FROM nation",
)(lambda spark, d: _access(spark, d).check([("nation", r.n_nationkey, "serve") for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").collect()], 3))

# documents of the query language
_DOC = "query Q($lo: Float = 9000) { rich: queryCustomer(filter: {c_acctbal: {gt: $lo}}, sort: {c_acctbal: DESC}, first: 5) { id: uid ...N nation { n_name region { r_name } } } } fragment N on Customer { c_name }"


@query("document_nested", "SELECT c_custkey AS id, c_name, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 9000 ORDER BY c_acctbal DESC, 1 LIMIT 5")
def _(spark, d):
    df = Executor(store(spark, d)).run(_DOC)["rich"]
    return df.select("id", "c_name", F.col("nation.n_name").alias("n_name"), F.col("nation.region.r_name").alias("r_name"))


_FUSED = """WITH a AS (%s SELECT uid, row_number() OVER (ORDER BY score DESC, uid) AS k FROM r WHERE uid IN (SELECT vec_id FROM embeddings WHERE label = 1)), b AS (SELECT vec_id AS uid, row_number() OVER (ORDER BY %s, vec_id) AS k FROM embeddings WHERE label = 1 AND vec_id IN (SELECT doc_id FROM documents))
SELECT coalesce(a.uid, b.uid) AS uid, round(coalesce(1.0::DOUBLE / (60 + a.k), 0) + coalesce(1.0::DOUBLE / (60 + b.k), 0), 8) AS score FROM a FULL JOIN b ON a.uid = b.uid ORDER BY coalesce(1.0::DOUBLE / (60 + a.k), 0) + coalesce(1.0::DOUBLE / (60 + b.k), 0) DESC, 1 LIMIT 10 OFFSET 5"""


@query("document_hybrid", _FUSED % (bm25_sql(["thing"]).replace("FROM documents", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 1)"), _L2))
def _(spark, d):
    """A text condition and a vector together, over the documents whose embedding has a label; paged."""
    ask = 'query Q($v: [Float]) { queryDocument(filter: {vector: {label: {eq: 1}}, text: {anyofterms: "thing"}}, nearVector: $v, first: 10, offset: 5) { uid _score } }'
    return Executor(store(spark, d)).run(ask, {"v": Q})["queryDocument"].select("uid", F.round("_score", 8).alias("score"))


query("document_count", "SELECT count(*)::BIGINT AS count FROM orders WHERE o_orderstatus = 'O'")(lambda spark, d: Executor(store(spark, d)).run('{ countOrder(filter: {o_orderstatus: {eq: "O"}}) }')["countOrder"])
query("document_facet", "SELECT lang AS value, count(*)::BIGINT AS count FROM documents GROUP BY 1")(lambda spark, d: Executor(store(spark, d)).run("{ aggregateDocument(groupBy: lang) { value count } }")["aggregateDocument"])

# introspection shapes and validation
query("ops_first_value", "SELECT o_custkey, o_orderstatus, count(*)::BIGINT AS n, min(o_orderdate) AS since, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1, 2")(
    lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("since"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))
)


@query("ops_right_join_count_over", "SELECT n_nationkey, n_name, c_custkey, count(*) OVER ()::BIGINT AS total FROM (SELECT * FROM customer WHERE c_acctbal > 9800) RIGHT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").filter("c_acctbal > 9800").select("c_custkey", "c_nationkey")
    joined = c.join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"), "right")
    total = joined.agg(F.count(F.lit(1)).alias("t")).scalar()  # what count(*) over () gives, without moving all rows to one task
    return joined.select("n_nationkey", "n_name", "c_custkey", total.alias("total"))


query("ops_first_columns", "SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS priority, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS price, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")(
    lambda spark, d: read.first_columns(spark.read.parquet(f"{d}/orders.parquet"), ["o_custkey"], {"status": "o_orderstatus", "priority": "o_orderpriority", "price": "o_totalprice"}, ["o_orderdate", "o_orderkey"], F.round(F.sum("o_totalprice"), 2).alias("total"))
)
query("ops_group_counts", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")(lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")))
query("ops_last_rows", "SELECT event_id, event_type, NULL::VARCHAR AS note FROM events ORDER BY event_id DESC LIMIT 100")(lambda spark, d: spark.read.parquet(f"{d}/events.parquet").orderBy(F.desc("event_id")).limit(100).select("event_id", "event_type", F.lit(None).cast("string").alias("note")))
query("validate_scalars", r"SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:\S+$') AS url_ok, page_id BETWEEN 0 AND 65535 AS port_ok, page_id > 0 AS positive_ok, false AS uuid_ok FROM pages")(
    lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", scalars.valid("URL", F.col("url")).alias("url_ok"), scalars.valid("Port", F.col("page_id")).alias("port_ok"), scalars.valid("PositiveInt", F.col("page_id")).alias("positive_ok"), scalars.valid("UUID", F.col("url")).alias("uuid_ok"))
)
query("validate_directives", "SELECT p_partkey AS uid, regexp_matches(p_name, 'ring$') AS a, strlen(p_name) BETWEEN 5 AND 11 AS b, p_size BETWEEN 10 AND 20 AS c FROM part")(
    lambda spark, d: store(spark, d).frame("Part").select("uid", scalars.directive_check("regex", {"pattern": "ring$"}, F.col("p_name")).alias("a"), scalars.directive_check("length", {"min": 5, "max": 11}, F.col("p_name")).alias("b"), scalars.directive_check("range", {"min": 10, "max": 20}, F.col("p_size")).alias("c"))
)


@query("cascade_delete", "SELECT 'Customer' AS type, count(*)::BIGINT AS n FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT 'Order', count(*)::BIGINT FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9900")
def _(spark, d):
    from quern.sources.writes import cascade

    r = reader(spark, d)
    gone = cascade(r.store, "Customer", r.rows("Customer", {"c_acctbal": {"gt": 9900.0}}).select("uid"))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("type"), "n") for t, df in sorted(gone.items())]
    return parts[0].union(parts[1])


@query("update_rows", "SELECT n_nationkey::BIGINT AS uid, CASE WHEN n_nationkey < 3 THEN 'new' ELSE n_name END AS n_name FROM nation")
def _(spark, d):
    from quern.sources.writes import update

    f = store(spark, d).frame("Nation")
    return update(f, f.filter("uid < 3").select("uid", F.lit("new").alias("n_name"))).select("uid", "n_name")


@query("insert_unique", "SELECT c_name FROM customer WHERE c_custkey < 0 UNION ALL SELECT 'fresh'")
def _(spark, d):
    from quern.sources.writes import insert

    s = store(spark, d)
    old = s.frames["Customer"]
    new = old.limit(1).withColumns({"c_name": F.lit("fresh"), "uid": F.lit(-1).cast("bigint")})
    again = new.withColumn("uid", F.lit(-2).cast("bigint"))
    good, _ = insert(s, "Customer", old.union(new.withColumn("uid", F.lit(-3).cast("bigint"))).union(again))
    return good.select("c_name")


@query("flagship", "SELECT c_custkey AS uid, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, 1 LIMIT 10")
def flagship(spark, d):
    return customer_cols(reader(spark, d).list("Customer", {"c_acctbal": {"gt": 5000.0}, "c_mktsegment": {"eq": "BUILDING"}}, {"c_acctbal": "DESC"}, 10))


__all__ = ["ORACLES", "QUERIES", "flagship"]
