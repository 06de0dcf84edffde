"""The registered queries of the engine, each with SQL that gives the same rows.

Most are query texts over one table as items; run() compiles them. Results are reduced to columns that SQL names alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, from_table
from .compiler import Engine

#: The day that relative dates count from, so that results do not change.
NOW = datetime(2024, 6, 1, tzinfo=UTC)
KEYS = {"orders": "o_orderkey", "events": "event_id", "part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "documents": "doc_id", "pages": "page_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str, name: str, tags: DataFrame | None = None) -> Catalog:
    """A table as items; a line item's id combines its order and line, which repeat, so each row is its own item."""
    df = read(spark, sf_dir, name)
    if name == "lineitem":
        return from_table(df, "lineitem", F.col("l_orderkey") * 8 + F.col("l_linenumber"), tags=tags, now=NOW)
    return from_table(df, name, KEYS[name], tags=tags, now=NOW)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def text(key: str, table: str, query: str, sql: str, columns: tuple = (), order: tuple = (), n: int = 0) -> None:
    """Register a query text over a table; of groups and values, all result columns; of items, the ids."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Engine(catalog(spark, sf_dir, table)).query(query, n=n, order=order)
        df = found.df
        if columns:
            return df.select(*columns)
        if found.kind == "items":
            return df.select("item_id")
        return df

    QUERIES[key] = Query(run, sql)


def items(key: str, table: str, query: str, where: str) -> None:
    text(key, table, query, f"SELECT {KEYS[table]} AS item_id FROM {table} WHERE {where}")


# --- Filters ---------------------------------------------------------------------------------------------------------

items("f_eq", "orders", "o_orderstatus:F", "o_orderstatus = 'F'")
items("f_glob", "part", "p_brand:Brand#1*", "p_brand GLOB 'Brand#1*'")
items("f_glob_class", "part", "p_brand:Brand#[1-2][!3]", "regexp_matches(p_brand, '^Brand#[1-2][^3]$')")
items("f_not_glob", "part", "p_type: :^ *BRASS", "p_type NOT GLOB '*BRASS'")
items("f_ne", "orders", "o_orderstatus: :^ F", "o_orderstatus <> 'F'")
items("f_in", "orders", "o_orderstatus:F | o_orderstatus:O", "o_orderstatus IN ('F', 'O')")
items("f_num", "orders", "o_totalprice: :> 150000", "o_totalprice > 150000")
items("f_int", "part", "p_size:7", "p_size = 7")
items("f_full", "orders", "o_orderpriority:*", "o_orderpriority IS NOT NULL")
items("f_type_glob", "orders", "o_order*:1-URGENT", "o_orderpriority = '1-URGENT' OR o_orderstatus = '1-URGENT'")
items("f_any", "orders", "*:F", "o_orderstatus = 'F' OR o_orderpriority = 'F'")
text("f_decimal_band", "events", "value:2.*", "SELECT event_id AS item_id FROM events WHERE value >= 2 AND value < 3")
text("f_decimal_part", "events", "value:*.5", "SELECT event_id AS item_id FROM events WHERE abs(value) % 1.0 >= 0.5 - 0.0001 AND abs(value) % 1.0 < 0.6 - 0.0001")
items("f_size", "documents", "n_chars: :> 2KB & n_chars: :<= 1MB", "n_chars > 2048 AND n_chars <= 1048576")
items("f_size_band", "documents", "n_chars:1.*KB", "n_chars BETWEEN 1024 AND 2047")
items("f_size_periodic", "documents", "n_chars:*.5KB", "n_chars % 1024 BETWEEN 512 AND 614")
items("f_id_block", "orders", "item_id:\"User(*)\" & item_id:<500", "o_orderkey < 500")
items("f_exists", "orders", "o_orderstatus:* & (o_orderpriority:5-LOW | o_orderpriority:4*)", "o_orderpriority = '5-LOW' OR o_orderpriority GLOB '4*'")

# --- Sets ------------------------------------------------------------------------------------------------------------

items("set_and", "orders", "o_orderstatus:F & o_orderpriority:5-LOW", "o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
items("set_or", "orders", "o_orderstatus:F | o_orderpriority:5-LOW", "o_orderstatus = 'F' OR o_orderpriority = '5-LOW'")
items("set_diff", "orders", "o_orderstatus:F - o_orderpriority:5-LOW", "o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
items("set_mixed", "orders", "o_orderstatus:O & o_totalprice: :> 100000 | o_orderpriority:1-URGENT - o_orderstatus:F", "(o_orderstatus = 'O' AND o_totalprice > 100000 OR o_orderpriority = '1-URGENT') AND o_orderstatus <> 'F'")

# --- Comparisons -----------------------------------------------------------------------------------------------------

items("c_chain", "orders", "1000 :< o_totalprice: :<= 200000", "o_totalprice > 1000 AND o_totalprice <= 200000")
items("c_stuck", "orders", "o_totalprice:>=200000", "o_totalprice >= 200000")
items("c_turned", "orders", "100000 :> o_totalprice:", "o_totalprice < 100000")
text("c_tagtag", "lineitem", "l_tax: :> l_discount:", "SELECT l_orderkey * 8 + l_linenumber AS item_id FROM lineitem WHERE l_tax > l_discount")
text("c_calc", "lineitem", "(l_extendedprice: * 2) :> 100000", "SELECT l_orderkey * 8 + l_linenumber AS item_id FROM lineitem WHERE l_extendedprice * 2 > 100000")
text("c_calc_tag", "lineitem", "l_extendedprice: :< (l_quantity: * 1000)", "SELECT l_orderkey * 8 + l_linenumber AS item_id FROM lineitem WHERE l_extendedprice < l_quantity * 1000")
text("c_calc_calc", "lineitem", "(l_quantity: * 1000) :> (l_extendedprice: - 500)", "SELECT l_orderkey * 8 + l_linenumber AS item_id FROM lineitem WHERE l_quantity * 1000 > l_extendedprice - 500")
items("c_aggtag", "orders", "o_totalprice: := max(o_totalprice:)", "o_totalprice = (SELECT max(o_totalprice) FROM orders)")
items("c_calcagg", "orders", "(o_totalprice: - avg(o_totalprice:)) :> 100000", "o_totalprice - (SELECT avg(o_totalprice) FROM orders) > 100000")
text("c_agglit", "orders", "count(o_orderstatus:F) > 10", "SELECT count(*) > 10 AS value, 'boolean' AS bitical_type FROM orders WHERE o_orderstatus = 'F'")
text("c_aggagg", "orders", "max(o_totalprice:) > avg(o_totalprice:)", "SELECT max(o_totalprice) > avg(o_totalprice) AS value, 'boolean' AS bitical_type FROM orders")
text("c_litlit", "orders", "(1 + 2) == 3", "SELECT true AS value, 'boolean' AS bitical_type")
text("c_null", "orders", "avg(none) == avg(none)", "SELECT CAST(NULL AS BOOLEAN) AS value, 'boolean' AS bitical_type")
text("c_nest_nest", "orders", "(o_custkey: &: max(o_totalprice:)) :> (o_orderpriority: &: sum(o_totalprice:))", "WITH a AS (SELECT o_custkey, max(o_totalprice) m FROM orders GROUP BY 1), b AS (SELECT o_orderpriority, sum(o_totalprice) s FROM orders GROUP BY 1) SELECT o_orderkey AS item_id FROM orders JOIN a USING (o_custkey) JOIN b USING (o_orderpriority) WHERE m > s")
text("c_nest_same", "orders", "(o_custkey: &: max(o_totalprice:)) :> (o_custkey: &: (avg(o_totalprice:) * 2))", "WITH a AS (SELECT o_custkey, max(o_totalprice) m, avg(o_totalprice) s FROM orders GROUP BY 1) SELECT o_orderkey AS item_id FROM orders JOIN a USING (o_custkey) WHERE m > s * 2")

# --- Arithmetic ------------------------------------------------------------------------------------------------------

text("a_proj", "part", "p_size: * 2", "SELECT CAST(p_size * 2 AS DOUBLE) AS key0, count(*) AS item_count FROM part GROUP BY 1")
text("a_two", "part", "(p_size: + p_retailprice:)", "SELECT p_size + p_retailprice AS key0, count(*) AS item_count FROM part GROUP BY 1")
text("a_scalar", "orders", "count() - 1", "SELECT CAST(count(*) - 1 AS DOUBLE) AS value, 'double' AS bitical_type FROM orders")
text("a_mod", "part", "p_size: % 7", "SELECT CAST(p_size % 7 AS DOUBLE) AS key0, count(*) AS item_count FROM part GROUP BY 1")
text("a_string", "nation", "sum(n_name:)", "SELECT string_agg(n_name, ', ' ORDER BY n_name) AS value, 'string' AS bitical_type FROM nation")
text("a_over_groups", "orders", "100000 - count(o_custkey: &: (count(o_orderstatus:F) > 3))", "SELECT CAST(100000 - (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 3)) AS DOUBLE) AS value, 'double' AS bitical_type")

# --- Aggregates ------------------------------------------------------------------------------------------------------

text("g_count", "orders", "count(o_orderstatus:F)", "SELECT count(*) AS value, 'integer' AS bitical_type FROM orders WHERE o_orderstatus = 'F'")
text("g_distinct", "orders", "count(o_custkey:)", "SELECT count(DISTINCT o_custkey) AS value, 'integer' AS bitical_type FROM orders")
text("g_sum", "orders", "sum(o_orderstatus:F & o_totalprice:)", "SELECT sum(o_totalprice) AS value, 'double' AS bitical_type FROM orders WHERE o_orderstatus = 'F'")
text("g_avg", "orders", "avg(o_totalprice:)", "SELECT avg(o_totalprice) AS value, 'double' AS bitical_type FROM orders")
text("g_min", "part", "min(p_size:)", "SELECT CAST(min(p_size) AS BIGINT) AS value, 'integer' AS bitical_type FROM part")
text("g_max_text", "nation", "max(n_name:)", "SELECT max(n_name) AS value, 'string' AS bitical_type FROM nation")
text("g_calc", "lineitem", "sum(l_extendedprice: * l_discount:)", "SELECT sum(l_extendedprice * l_discount) AS value, 'double' AS bitical_type FROM lineitem")
text("g_empty", "orders", "max(none)", "SELECT CAST(NULL AS DOUBLE) AS value, 'numeric' AS bitical_type")
text("g_groups", "orders", "sum(o_custkey: &: count())", "SELECT CAST(count(*) AS DOUBLE) AS value, 'double' AS bitical_type FROM orders")
text("g_group_count", "orders", "count(o_custkey: &: (count() > 5))", "SELECT count(*) AS value, 'integer' AS bitical_type FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 5)")

# --- Groups ----------------------------------------------------------------------------------------------------------

text("n_count", "orders", "o_orderstatus: &: count()", "SELECT o_orderstatus AS key0, CAST(count(*) AS DOUBLE) AS nvalue, count(*) AS item_count FROM orders GROUP BY 1")
text("n_proj", "orders", "o_orderpriority:", "SELECT o_orderpriority AS key0, count(*) AS item_count FROM orders GROUP BY 1")
text("n_count_filter", "orders", "o_orderpriority: &: count(o_orderstatus:F)", "SELECT o_orderpriority AS key0, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS nvalue, count(*) AS item_count FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 0")
text("n_count_labels", "orders", "o_orderpriority: &: count(o_custkey:)", "SELECT o_orderpriority AS key0, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS nvalue, count(*) AS item_count FROM orders GROUP BY 1")
text("n_avg", "orders", "o_orderpriority: &: avg(o_totalprice:)", "SELECT o_orderpriority AS key0, avg(o_totalprice) AS nvalue, count(*) AS item_count FROM orders GROUP BY 1")
text("n_multi", "orders", "o_orderstatus: &: o_orderpriority: &: sum(o_totalprice:)", "SELECT o_orderstatus AS key0, o_orderpriority AS key1, sum(o_totalprice) AS nvalue, count(*) AS item_count FROM orders GROUP BY 1, 2")
text("n_literal", "orders", "o_orderstatus: &: 100", "SELECT o_orderstatus AS key0, 100.0::DOUBLE AS nvalue, count(*) AS item_count FROM orders GROUP BY 1")
text("n_calc_key", "lineitem", "l_returnflag: &: (l_linenumber: + 1)", "SELECT l_returnflag AS key0, CAST(l_linenumber + 1 AS DOUBLE) AS key1, count(*) AS item_count FROM lineitem GROUP BY 1, 2")
items("n_having", "orders", "o_custkey: &: (count() > 5)", "o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 5)")
items("n_having_and", "orders", "o_custkey: &: ((count() > 3) & (sum(o_totalprice:) > 500000))", "o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 3 AND sum(o_totalprice) > 500000)")
text("n_context", "orders", "o_orderstatus:F & o_orderpriority: &: sum(o_totalprice:)", "SELECT o_orderpriority AS key0, sum(o_totalprice) AS nvalue, count(*) AS item_count FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
text("n_key_filter", "orders", "(o_orderpriority: & o_orderstatus:F) &: count()", "SELECT o_orderpriority AS key0, CAST(count(*) AS DOUBLE) AS nvalue, count(*) AS item_count FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
text("n_right_filter", "orders", "o_orderpriority: &: (o_orderstatus:F & o_custkey:)", "SELECT o_orderpriority AS key0, o_custkey AS key1, count(*) AS item_count FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2")
text("n_unnest", "orders", "sum(o_orderstatus: &: o_totalprice:)", "SELECT o_orderstatus AS key0, sum(o_totalprice) AS nvalue, count(*) AS item_count FROM orders GROUP BY 1")
text("n_unnest_twice", "orders", "max(sum(o_orderstatus: &: o_orderpriority: &: o_totalprice:))", "SELECT max(s) AS value, 'double' AS bitical_type FROM (SELECT sum(o_totalprice) s FROM orders GROUP BY o_orderstatus, o_orderpriority)")
text("n_mixed", "orders", "(o_orderstatus: &: count()) + (o_orderpriority: &: count())", "WITH a AS (SELECT o_orderstatus, count(*) n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority, count(*) m FROM orders GROUP BY 1) SELECT o_orderstatus AS key0, o_orderpriority AS key1, CAST(any_value(n) + any_value(m) AS DOUBLE) AS nvalue, count(*) AS item_count FROM orders JOIN a USING (o_orderstatus) JOIN b USING (o_orderpriority) GROUP BY 1, 2")
text("n_arith", "orders", "(o_orderpriority: &: sum(o_totalprice:)) / (o_orderpriority: &: count())", "SELECT o_orderpriority AS key0, sum(o_totalprice) / count(*) AS nvalue, count(*) AS item_count FROM orders GROUP BY 1")
text("n_distributed", "orders", "o_orderpriority: &: (max(o_totalprice:) - min(o_totalprice:))", "SELECT o_orderpriority AS key0, max(o_totalprice) - min(o_totalprice) AS nvalue, count(*) AS item_count FROM orders GROUP BY 1")
text("n_labelgroup", "pages", 'url:"*://*/": &: count()', "SELECT regexp_extract(url, '^(.*?://.*?/)', 1) AS key0, CAST(count(*) AS DOUBLE) AS nvalue, count(*) AS item_count FROM pages WHERE regexp_extract(url, '^(.*?://.*?/)', 1) <> '' GROUP BY 1")
text("n_base", "orders", "*: &: o_orderstatus:", "SELECT o_orderstatus AS key0, count(*) AS item_count FROM orders GROUP BY 1")
text("n_fixed", "orders", "item_kind:", "SELECT 'orders' AS key0, count(*) AS item_count FROM orders")
text("n_union", "orders", "o_orderstatus: &: (o_orderpriority: | o_custkey:)", "SELECT o_orderstatus AS key0, o_orderpriority AS key1, count(*) AS item_count FROM orders GROUP BY 1, 2 UNION ALL SELECT o_orderstatus, CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 1, 2")

# --- Label sets ------------------------------------------------------------------------------------------------------

text("l_inter", "lineitem", "l_partkey: & l_suppkey:", "WITH k AS (SELECT l_partkey AS k FROM lineitem INTERSECT SELECT l_suppkey FROM lineitem) SELECT CAST(k AS VARCHAR) AS key0, count(DISTINCT l_orderkey * 8 + l_linenumber) AS item_count FROM k JOIN lineitem ON k IN (l_partkey, l_suppkey) GROUP BY k")
text("l_union", "lineitem", "l_returnflag: | l_linestatus:", "SELECT k AS key0, count(DISTINCT i) AS item_count FROM (SELECT l_returnflag k, l_orderkey * 8 + l_linenumber i FROM lineitem UNION ALL SELECT l_linestatus, l_orderkey * 8 + l_linenumber FROM lineitem) GROUP BY 1")
text("l_except", "lineitem", "l_partkey: -: l_suppkey:", "SELECT CAST(l_partkey AS VARCHAR) AS key0, count(DISTINCT l_orderkey * 8 + l_linenumber) AS item_count FROM lineitem WHERE l_partkey NOT IN (SELECT l_suppkey FROM lineitem) GROUP BY l_partkey")
text("l_proj_tag", "orders", "o_orderpriority: & o_orderstatus:F", "SELECT o_orderpriority AS key0, count(*) AS item_count FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
text("l_proj_minus_tag", "orders", "o_orderpriority: - o_orderstatus:F", "SELECT o_orderpriority AS key0, count(*) AS item_count FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")

# --- Order, limit, dates, eval, definitions --------------------------------------------------------------------------

text("o_order", "orders", "o_orderstatus:F", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 25", order=(("o_totalprice", True),), n=25)
text("o_limit", "orders", "o_orderstatus:*", "SELECT o_orderkey AS item_id FROM orders ORDER BY o_orderkey DESC LIMIT 100", n=100)
text("d_interval", "events", "ts:2024-01-05", "SELECT event_id AS item_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
text("d_after", "orders", "o_orderdate: :> 1995-03", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderdate >= TIMESTAMP '1995-04-01'")
text("d_slot", "events", "ts:*-*-15", "SELECT event_id AS item_id FROM events WHERE day(ts) = 15")
text("d_slot_order", "events", "ts: :>= \"12:*\"", "SELECT event_id AS item_id FROM events WHERE hour(ts) >= 12")
text("d_slot_month", "orders", "o_orderdate:*-02-01", "SELECT o_orderkey AS item_id FROM orders WHERE month(o_orderdate) = 2 AND day(o_orderdate) = 1")
text("e_scalar", "orders", "o_totalprice: :>= max(o_totalprice:)", "SELECT o_orderkey AS item_id FROM orders WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders)")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 items of every group, by rank and id."""
    df = Engine(catalog(spark, sf_dir, "orders")).query("o_orderpriority:", members=True).df
    return df.select("key0", F.posexplode("members").alias("n", "item_id"), "item_count")


QUERIES["w_top"] = Query(members, "SELECT o_orderpriority AS key0, CAST(row_number() OVER w - 1 AS INT) AS n, o_orderkey AS item_id, count(*) OVER (PARTITION BY o_orderpriority) AS item_count FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) QUALIFY row_number() OVER w <= 100")


# --- Storage, edits, incremental indexing ----------------------------------------------------------------------------


def user_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small long table over orders: a grade for urgent ones, several labels for some, a user's rank for a few."""
    from .catalog import LABELS

    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), "o_orderpriority", "o_orderstatus")
    none = {v: F.lit(None).cast({"label_int": "long", "label_double": "double", "label_bool": "boolean"}.get(v, "string")) for v in LABELS.values()}

    def rows(df: DataFrame, name: str, column: str, value) -> DataFrame:
        return df.select("item_id", F.lit(name).alias("type"), *((value if v == column else none[v]).alias(v) for v in LABELS.values()))

    urgent = rows(o.where("o_orderpriority = '1-URGENT'"), "grade", "label_str", F.lit("hot"))
    status = rows(o.where("item_id % 2 = 0"), "grade", "label_str", F.col("o_orderstatus"))
    rank = rows(o.where("item_id % 100 = 0"), "rank", "label_int", F.lit(7).cast("long"))
    score = rows(o.where("item_id % 3 = 0"), "score", "label_int", (F.col("item_id") % 10).cast("long"))
    return urgent.unionByName(status).unionByName(rank).unionByName(score)


_GRADES = "(SELECT o_orderkey AS i, 'hot' AS g FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)"


def tagged(key: str, query: str, sql: str, **how) -> None:
    """Register a query over orders with user tags in the long form."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Engine(catalog(spark, sf_dir, "orders", user_tags(spark, sf_dir))).query(query, **how)
        return found.df.select("item_id") if found.kind == "items" else found.df

    QUERIES[key] = Query(run, sql)


tagged("long_match", "grade:hot & score: :> 4", f"SELECT DISTINCT i AS item_id FROM {_GRADES} WHERE g = 'hot' AND i % 3 = 0 AND i % 10 > 4")
tagged("long_in", "grade:hot | grade:F", f"SELECT DISTINCT i AS item_id FROM {_GRADES} WHERE g IN ('hot', 'F')")
tagged("long_group", "grade: &: sum(o_totalprice:)", f"SELECT g AS key0, sum(o_totalprice) AS nvalue, count(*) AS item_count FROM {_GRADES} JOIN orders ON o_orderkey = i GROUP BY g")
tagged("long_multi", "grade: &: o_orderstatus: &: count()", f"SELECT g AS key0, o_orderstatus AS key1, CAST(count(*) AS DOUBLE) AS nvalue, count(*) AS item_count FROM (SELECT i, max(g) AS g FROM {_GRADES} GROUP BY i) JOIN orders ON o_orderkey = i GROUP BY 1, 2")
tagged("long_having", "grade: &: (count() > 100)", f"SELECT DISTINCT i AS item_id FROM {_GRADES} WHERE g IN (SELECT g FROM {_GRADES} GROUP BY g HAVING count(*) > 100)")
tagged("long_labels", "grade: & o_orderstatus:", f"SELECT g AS key0, count(DISTINCT i) AS item_count FROM (SELECT * FROM {_GRADES} UNION SELECT o_orderkey, o_orderstatus FROM orders) WHERE g IN (SELECT g FROM {_GRADES} INTERSECT SELECT o_orderstatus FROM orders) GROUP BY g")
tagged("long_count", "count(grade:)", f"SELECT count(DISTINCT g) AS value, 'integer' AS bitical_type FROM {_GRADES}")
QUERIES["e_eval_tags"] = Query(lambda spark, sf_dir: Engine(catalog(spark, sf_dir, "orders", user_tags(spark, sf_dir))).query("q(grade:) & o_orderstatus:F").df.select("item_id"), f"SELECT DISTINCT i AS item_id FROM {_GRADES} JOIN orders ON o_orderkey = i WHERE o_orderstatus = 'F'")
tagged("m_tag", 'tag:"grade:*"', f"SELECT DISTINCT CAST(NULL AS BIGINT) AS item_id, 'grade:' || g AS name, 'tag' AS item_kind, 0 AS rank, 'user' AS origin FROM {_GRADES}")
tagged("m_type_exact", "type:unused_type", "SELECT CAST(NULL AS BIGINT) AS item_id, 'unused_type' AS name, 'type' AS item_kind, 0 AS rank, 'user' AS origin")
tagged("n_types", "type:", "SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority', 'item_id', 'item_kind', 'rank', 'origin', 'grade', 'score']) AS key0, unnest([n, n, n, n, n, n, n, n, n, n, g, s]) AS item_count FROM (SELECT (SELECT count(*) FROM orders) AS n, (SELECT count(DISTINCT i) FROM " + _GRADES + ") AS g, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS s)")


def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, items and rank sum of each type in the long view of orders and their user tags."""
    from ..operators.oneview import oneview

    c = catalog(spark, sf_dir, "orders")
    view = oneview(c.items, [d for d in c.defs.values() if d.name in ("o_orderstatus", "o_totalprice", "o_custkey")], user_tags(spark, sf_dir))
    return view.groupBy("type", "origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"), F.sum("rank").alias("ranks"))


_RANK = "CASE WHEN i % 100 = 0 THEN 7 ELSE 0 END"
QUERIES["s_oneview"] = Query(view_counts, f"SELECT type, origin, count(*) AS n, count(DISTINCT i) AS items, CAST(sum({_RANK}) AS BIGINT) AS ranks FROM (SELECT unnest(['o_orderstatus', 'o_totalprice', 'o_custkey']) AS type, 'file' AS origin, o_orderkey AS i FROM orders UNION ALL SELECT 'grade', 'user', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'grade', 'user', o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'rank', 'user', o_orderkey FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT 'score', 'user', o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1, 2")


def tag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The computed tag texts of regions and nations."""
    from ..operators.oneview import oneview

    c = catalog(spark, sf_dir, "nation")
    return oneview(c.items, list(c.defs.values())).select("item_id", "tag")


QUERIES["s_tag_text"] = Query(tag_texts, "SELECT n_nationkey AS item_id, 'n_nationkey:' || n_nationkey AS tag FROM nation UNION ALL SELECT n_nationkey, 'n_name:' || n_name FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey:' || n_regionkey FROM nation")


def preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grade an order: the user's, else the order's status."""
    from ..operators.oneview import oneview, prefer

    c = catalog(spark, sf_dir, "orders")
    view = oneview(c.items, [c.defs["o_orderstatus"]], user_tags(spark, sf_dir))
    return prefer(view, "grade", "o_orderstatus").select("item_id", F.col("label_str").alias("grade"))


QUERIES["s_prefer"] = Query(preferred, f"SELECT o_orderkey AS item_id, coalesce(g, o_orderstatus) AS grade FROM orders LEFT JOIN (SELECT i, min(g) AS g FROM {_GRADES} GROUP BY i) ON i = o_orderkey")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key replacement: new prices for every tenth order, and only old rows of open or finished orders are kept."""
    from ..operators.merge import key_replace

    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return key_replace(old, new, "o_orderkey", F.col("o_orderstatus") != "P")


QUERIES["k_merge"] = Query(merged, "SELECT o_orderkey, o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderstatus <> 'P'")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored files, removed files and a later scan, made from parts: every 5th moved, 7th grown, 11th gone, 13th returned."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("dir"), F.col("p_size").cast("long").alias("size"))
    row = lambda df, d: df.select((F.lit(8) * F.lit(1 << 58) + F.col("k")).alias("item_id"), F.lit(0).cast("long").alias("rank"), F.concat(d, F.lit("/"), F.col("k").cast("string")).alias("path"), d.alias("parentdir"), F.col("k").cast("string").alias("filename"), F.col("k").cast("string").alias("stem"), F.lit(None).cast("string").alias("extension"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("file_id"), F.lit(False).alias("is_dir"), "size", F.lit(1000).cast("long").alias("mtime"))
    from ..operators.incremental import with_hashes

    files = row(p.where("k % 3 <> 0 AND k % 13 <> 0"), F.col("dir"))
    removed = with_hashes(row(p.where("k % 13 = 0"), F.col("dir")))
    now = p.where("k % 11 <> 0").withColumn("size", F.when(F.expr("k % 7 = 0 AND k % 13 <> 0"), F.col("size") + 1).otherwise(F.col("size")))
    scan = row(now, F.when(F.expr("k % 5 = 0"), F.lit("moved")).otherwise(F.col("dir"))).drop("item_id", "rank")
    return files, removed, scan


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan is for each file."""
    from ..operators.incremental import diff

    files, removed, scan = snapshots(spark, sf_dir)
    d = diff(scan, files, removed)
    part = lambda df, state: df.select("filename", F.lit(state).alias("state"))
    by = files.select("item_id", "filename")
    out = part(by.join(d.live, "item_id"), "live").unionByName(part(by.join(d.deleted, "item_id"), "deleted"))
    for state in ("changed", "moved", "returned", "new"):
        out = out.unionByName(part(getattr(d, state), state))
    return out


_STATES = "SELECT CAST(p_partkey AS VARCHAR) AS filename, CASE WHEN p_partkey % 11 = 0 THEN 'deleted' WHEN p_partkey % 13 = 0 THEN 'returned' WHEN p_partkey % 3 = 0 THEN 'new' WHEN p_partkey % 7 = 0 THEN 'changed' WHEN p_partkey % 5 = 0 THEN 'moved' ELSE 'live' END AS state FROM part WHERE p_partkey % 11 <> 0 OR p_partkey % 3 <> 0 AND p_partkey % 13 <> 0"
QUERIES["i_diff"] = Query(changes, _STATES)


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored files after the scan: ids stay with their files, new ones get new ids."""
    from ..operators.incremental import apply, diff

    files, removed, scan = snapshots(spark, sf_dir)
    after = apply(files, diff(scan, files, removed), removed)
    kept = after.join(files.select("item_id").unionByName(removed.select("item_id")), "item_id", "left_semi").select("path", "size", F.lit(True).alias("known"))
    return kept.unionByName(after.join(files.select("item_id").unionByName(removed.select("item_id")), "item_id", "left_anti").select("path", "size", F.lit(False).alias("known")))


QUERIES["i_apply"] = Query(applied, "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'moved' ELSE p_brand END || '/' || p_partkey AS path, CAST(p_size + CASE WHEN p_partkey % 7 = 0 AND p_partkey % 13 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS size, p_partkey % 3 <> 0 OR p_partkey % 13 = 0 AS known FROM part WHERE p_partkey % 11 <> 0")


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User tags after tagging by captures and untagging by a pattern."""
    from ..operators import edit as E
    from .catalog import LABELS

    c = catalog(spark, sf_dir, "part")
    hit = Engine(c).query("p_brand:Brand#*").df
    caps = E.captures(c.items.join(hit.select("item_id"), "item_id", "left_semi").select("item_id", F.col("p_brand").alias("value")), "Brand#?*")
    none = spark.createDataFrame([], "item_id long, type string, label_str string, label_int long, label_double double, label_bool boolean")
    tags = E.tag(none, E.new_tags(hit, E.parse_edit("maker:{1} line:m{1}-{2}"), c, caps), c)
    small = Engine(c).query("p_size: :< 10").df
    tags = E.untag(tags, small, E.parse_edit("line:m1*"))
    return tags.select("item_id", "type", F.coalesce("label_str", F.col("label_int").cast("string")).alias("label")).where(F.lit(bool(LABELS)))


QUERIES["ed_captures"] = Query(edited, "SELECT p_partkey AS item_id, 'maker' AS type, substr(p_brand, 7, 1) AS label FROM part WHERE p_brand LIKE 'Brand#_%' UNION ALL SELECT p_partkey, 'line', 'm' || substr(p_brand, 7, 1) || '-' || substr(p_brand, 8) FROM part WHERE p_brand LIKE 'Brand#_%' AND NOT (p_size < 10 AND substr(p_brand, 7, 1) = '1')")


def cast_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score tag moved to doubles."""
    from ..operators.edit import cast_type

    return cast_type(user_tags(spark, sf_dir), "score", "double").where("type = 'score'").select("item_id", "label_double")


QUERIES["ed_cast"] = Query(cast_labels, "SELECT o_orderkey AS item_id, CAST(o_orderkey % 10 AS DOUBLE) AS label_double FROM orders WHERE o_orderkey % 3 = 0")


def long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grouping with every attribute in the long form."""
    from ..operators.oneview import long_catalog

    c = long_catalog(catalog(spark, sf_dir, "orders"))
    return Engine(c).query("o_orderstatus: &: o_orderpriority: &: sum(o_totalprice:)").df


QUERIES["n_multi_long"] = Query(long_form, QUERIES["n_multi"].sql)

from . import catalogue_storage  # noqa: E402, F401  its queries join these
