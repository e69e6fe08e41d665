"""The catalog over the driver's tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.sources.store import Store

SCHEMA = """
type Region { r_name: String  nations: [Nation] @hasInverse(field: "region") }
type Nation { n_name: String  region: Region  customers: [Customer] @hasInverse(field: "nation")  suppliers: [Supplier] @hasInverse(field: "nation") }
interface Party { balance: Float }
type Customer implements Party { c_name: String @unique  c_acctbal: Float @range(min: -1000, max: 100000)  c_mktsegment: String @search(by: [term])  nation: Nation
  orders: [Order] @hasInverse(field: "customer") @cascade  net: Float @compute(expr: "c_acctbal * 2 - 100") }
type Supplier implements Party { s_name: String @unique  s_acctbal: Float  nation: Nation  parts: [Part]  orders: [Order] }
type Part { p_name: String @search(by: [term, fulltext])  p_brand: String  p_type: String  p_size: Int  p_retailprice: Float  suppliers: [Supplier] }
type Order { o_orderstatus: String  o_totalprice: Float  o_orderdate: DateTime  o_orderpriority: String  customer: Customer  parts: [Part]  suppliers: [Supplier]  lines: [Line] }
type Line { l_quantity: Float  l_extendedprice: Float  l_returnflag: String  order: Order }
type Event { ts: DateTime  user_id: Int64  event_type: String  value: Float  props: JSON }
type Document { text: String @search(by: [term, fulltext, trigram])  lang: String  source: String  n_chars: Int64  vector: Embedding  label: Label }
type Embedding { embedding: [Float!]! @vector  label: Int  document: Document }
type Label { quality: Int  toxic: Int  document: Document }
type Page { url: URL  html: String }
"""


def store(spark: SparkSession, d: str) -> Store:
    """A query opens only the tables that it names, and reads of these only the columns that it names."""

    def t(name):
        return lambda: spark.read.parquet(f"{d}/{name}.parquet")

    def line(src, dst):
        return lambda: t("lineitem")().select(F.col(src).alias("src"), F.col(dst).alias("dst"))

    s = Store(spark, SCHEMA)
    s.bind("Region", t("region"), "r_regionkey")
    s.bind("Nation", t("nation"), "n_nationkey", {"region": "n_regionkey"})
    s.bind("Customer", t("customer"), "c_custkey", {"nation": "c_nationkey", "balance": "c_acctbal"})
    s.bind("Supplier", t("supplier"), "s_suppkey", {"nation": "s_nationkey", "balance": "s_acctbal"})
    s.bind("Part", t("part"), "p_partkey")
    s.bind("Order", t("orders"), "o_orderkey", {"customer": "o_custkey"})
    # the line table has no key: an id is derived from the place of the line and is used only to tell lines apart
    s.bind("Line", t("lineitem"), "l_orderkey * 1000 + l_linenumber", {"order": "l_orderkey"})
    s.bind("Event", t("events"), "event_id", json={"props": "k bigint"})
    s.bind("Document", t("documents"), "doc_id", {"vector": "doc_id", "label": "doc_id"})
    s.bind("Embedding", t("embeddings"), "vec_id", {"document": "vec_id"})
    s.bind("Label", t("labels"), "doc_id", {"document": "doc_id"})
    s.bind("Page", t("pages"), "page_id")
    s.bind_edges("Order", "parts", line("l_orderkey", "l_partkey"))
    s.bind_edges("Order", "suppliers", line("l_orderkey", "l_suppkey"))
    s.bind_edges("Part", "suppliers", line("l_partkey", "l_suppkey"))
    return s
