"""Queries over the driver's tables through the engine, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veltra.functions import keys as K
from veltra.operators import kv
from veltra.session import Engine
from veltra.sources import arrow_ipc, sorted_files
from veltra.sources.wal import Wal

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark).register_parquet(sf_dir, *TABLES)


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the dialect; the oracle's text is the same unless given."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).sql(text)
    ORACLE[name] = oracle or text


def code(name: str, oracle: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


FLAGSHIP = """
SELECT n_name AS nation, c_mktsegment AS segment, {money}(SUM(l_extendedprice * (1 - l_discount)){digits}) AS revenue, COUNT(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_discount > 0.02 GROUP BY n_name, c_mktsegment ORDER BY revenue DESC, nation, segment LIMIT 10
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation and market segment."""
    return engine(spark, sf_dir).sql(FLAGSHIP.format(money="ROUND", digits=", 2"))


QUERIES["flagship"] = flagship
ORACLE["flagship"] = FLAGSHIP.format(money="ROUND", digits=", 2")

# Scan, projection, filter
sql("scan_all", "SELECT * FROM region")
sql("project_alias", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders")
sql("compound_ref", "SELECT nation.n_name AS name, region.r_name AS region FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey")
sql("quoted_names", "SELECT `r_name` AS `name` FROM `region`", 'SELECT r_name AS name FROM region')
sql("nested_parentheses", "SELECT ((r_regionkey)) AS k, (r_regionkey + (1 * (2 + 3))) AS v FROM region")
sql("literals", """SELECT r_regionkey AS k, 42 AS i, 9L AS l, 1.5 AS d, 'x' AS s, "y" AS q, TRUE AS b FROM region""", "SELECT r_regionkey AS k, 42 AS i, CAST(9 AS BIGINT) AS l, CAST(1.5 AS DOUBLE) AS d, 'x' AS s, 'y' AS q, TRUE AS b FROM region")
sql("filter_eq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
sql("filter_double_eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus == 'O'")
sql("filter_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20")
sql("filter_and_or", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 5 OR l_discount > 0.09 AND l_linestatus = 'F'")
sql("filter_neq", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
sql("filter_xor", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 25) XOR (l_discount > 0.05)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 25) <> (l_discount > 0.05)")
sql("filter_not", "SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
sql("arith_ops", "SELECT o_orderkey AS k, o_orderkey + 7 AS a, o_orderkey - o_custkey AS s, o_custkey * 3 AS m, o_orderkey % 7 AS r, ROUND(o_totalprice / 3, 4) AS d FROM orders")
sql("unary_ops", "SELECT o_orderkey AS k, -o_custkey AS n, +o_custkey AS p, -o_custkey * 2 AS t, --o_custkey AS dd FROM orders", "SELECT o_orderkey AS k, -o_custkey AS n, +o_custkey AS p, (-o_custkey) * 2 AS t, -(-o_custkey) AS dd FROM orders")
sql("concat_str", "SELECT c_custkey, c_name || '-' || c_mktsegment AS tag FROM customer")
sql("comparisons", "SELECT p_partkey AS k, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge, p_size = 10 AS eq, p_size <> 10 AS ne FROM part")
sql("is_null", "SELECT o_orderkey AS k, l_orderkey IS NULL AS missing, l_orderkey IS NOT NULL AS present FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
IS_BOOL = "SELECT c_custkey AS k, (value > 50) IS TRUE AS t, (value > 50) IS NOT TRUE AS nt, (value > 50) IS FALSE AS f, (value > 50) IS NOT FALSE AS nf FROM customer LEFT JOIN events ON c_custkey = user_id"
sql("is_bool", IS_BOOL)
sql("cast_types", "SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) AS d, CAST(o_custkey AS VARCHAR) AS s, CAST(o_custkey AS INT) AS i, CAST(o_custkey AS BOOLEAN) AS b, CAST(o_custkey AS BIGINT) AS l FROM orders")
sql("try_cast_null", "SELECT o_orderkey AS k, TRY_CAST(o_orderstatus AS INT) AS i, TRY_CAST('12' AS INT) AS j FROM orders")
sql("ceil_floor", "SELECT l_orderkey AS k, l_linenumber AS n, CAST(CEIL(l_extendedprice) AS BIGINT) AS c, CAST(FLOOR(l_extendedprice) AS BIGINT) AS f FROM lineitem")
sql("bit_ops", "SELECT o_orderkey AS k, o_orderkey & 12 AS a, o_orderkey | 5 AS o, o_orderkey ^ 9 AS x FROM orders", "SELECT o_orderkey AS k, o_orderkey & 12 AS a, o_orderkey | 5 AS o, xor(o_orderkey, 9) AS x FROM orders")

# Joins
sql("join_inner", "SELECT o_orderkey, l_linenumber, o_orderstatus FROM orders INNER JOIN lineitem ON o_orderkey = l_orderkey")
sql("join_left", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
sql("join_right", "SELECT event_id, c_custkey FROM events RIGHT JOIN customer ON user_id = c_custkey")
sql("join_full", "SELECT n_name, p_partkey FROM nation FULL OUTER JOIN part ON n_nationkey = p_size")
CHAIN = "SELECT r_name, n_name, COUNT(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name"
sql("join_chain", CHAIN)
sql("join_reversed", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
sql("join_expression", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey + 1 = r_regionkey + 1")
sql("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_using", "SELECT r_regionkey, a.r_name AS x FROM region a JOIN region b USING (r_regionkey)")

# Grouping
sql("group_keys", "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus")
sql("group_expression", "SELECT o_custkey % 10 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10")
sql("agg_sum", "SELECT l_returnflag, SUM(l_linenumber) AS s, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS s, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag")
sql("agg_count", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(l_quantity) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_min", "SELECT l_returnflag, MIN(l_extendedprice) AS lo FROM lineitem GROUP BY l_returnflag")
sql("agg_max", "SELECT l_returnflag, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag")
sql("agg_avg", "SELECT l_returnflag, ROUND(AVG(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
sql("agg_global", "SELECT COUNT(*) AS n, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi, ROUND(AVG(o_totalprice), 4) AS mean FROM orders")
sql("agg_expr", "SELECT o_orderstatus, ROUND(SUM(o_totalprice) / COUNT(*), 4) AS per, CEIL(MAX(o_totalprice) - MIN(o_totalprice)) AS span FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, ROUND(SUM(o_totalprice) / COUNT(*), 4) AS per, CAST(CEIL(MAX(o_totalprice) - MIN(o_totalprice)) AS BIGINT) AS span FROM orders GROUP BY o_orderstatus")

# Order and limit
sql("sort_asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC, o_orderkey")
sql("sort_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
sql("sort_multi", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_custkey, o_orderkey")
sql("sort_hidden", "SELECT o_orderkey FROM orders ORDER BY o_totalprice * -1, o_orderkey")
sql("sort_alias", "SELECT o_orderkey AS k, o_totalprice + 1 AS p FROM orders ORDER BY p DESC, k")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
sql("offset_only", "SELECT r_regionkey FROM region ORDER BY r_regionkey OFFSET 2")
sql("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")

# Extended dialect
sql("ext_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("ext_count_distinct", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
sql("ext_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
sql("ext_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("ext_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("ext_grouping_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
sql("ext_grouping", "SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderpriority) AS g, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderpriority) AS TINYINT) AS g, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("ext_natural", "SELECT r_regionkey, r_name FROM region NATURAL JOIN (SELECT n_regionkey AS r_regionkey, n_name FROM nation) AS n")
sql("ext_except_all", "SELECT p_size AS k FROM part EXCEPT ALL SELECT n_nationkey AS k FROM nation")
sql("ext_intersect_all", "SELECT p_size AS k FROM part INTERSECT ALL SELECT l_linenumber AS k FROM lineitem")
sql("ext_statistics", "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(CORR(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
sql("ext_array_index", "SELECT c_custkey AS k, SPLIT(c_name, '#')[1] AS n FROM customer", "SELECT c_custkey AS k, split_part(c_name, '#', 2) AS n FROM customer")
sql("ext_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
sql("ext_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_custkey NOT BETWEEN 10 AND 100")
sql("ext_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%'")
sql("ext_regexp", "SELECT c_custkey FROM customer WHERE c_name REGEXP '[13579]$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[13579]$')")
sql("ext_union", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region")
sql("ext_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region")
sql("ext_intersect", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT p_size AS k FROM part")
sql("ext_except", "SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey AS k FROM nation")
sql("ext_cte", "WITH big AS (SELECT o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT c_name, n FROM big JOIN customer ON c = c_custkey WHERE n > 10")
sql("ext_derived", "SELECT s, COUNT(*) AS n FROM (SELECT o_orderstatus AS s FROM orders WHERE o_totalprice > 1000) AS d GROUP BY s")
sql("ext_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
sql("ext_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN events ON c_custkey = user_id", "SELECT c_custkey FROM customer SEMI JOIN events ON c_custkey = user_id")
sql("ext_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN events ON c_custkey = user_id", "SELECT c_custkey FROM customer ANTI JOIN events ON c_custkey = user_id")
sql("ext_theta", "SELECT a.n_nationkey AS x, r_regionkey AS y FROM nation a JOIN region ON a.n_regionkey >= r_regionkey AND r_regionkey > 1")
sql("ext_in_query", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE value > 90)")
sql("ext_not_in_query", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
sql("ext_not_in_nulls", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 49)")
sql("ext_in_or", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE value > 90) OR c_acctbal < 0")
sql("ext_correlated", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT event_id FROM events WHERE user_id = c_custkey AND value > 95)")
sql("ext_not_correlated", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey)")
sql("ext_correlated_in", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_extendedprice > o_totalprice / 2)")
sql("ext_correlated_scalar", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT AVG(p.o_totalprice) FROM orders p WHERE p.o_custkey = o.o_custkey)")
sql("ext_scalar_query", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")
sql("ext_exists", "SELECT r_regionkey FROM region WHERE EXISTS (SELECT n_nationkey FROM nation WHERE n_nationkey > 3)")
sql("ext_case", "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS level, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS f FROM orders")
sql("ext_functions", "SELECT c_custkey AS k, UPPER(c_name) AS u, LENGTH(c_name) AS n, SUBSTRING(c_name, 1, 3) AS s, COALESCE(c_name, 'x') AS c, ABS(c_nationkey - 10) AS a FROM customer", "SELECT c_custkey AS k, UPPER(c_name) AS u, CAST(LENGTH(c_name) AS INTEGER) AS n, SUBSTRING(c_name, 1, 3) AS s, COALESCE(c_name, 'x') AS c, ABS(c_nationkey - 10) AS a FROM customer")
sql("ext_cast_colons", "SELECT o_orderkey AS k, o_custkey::VARCHAR AS s FROM orders")
sql("ext_no_from", "SELECT 1 AS a, 'b' AS b")


# Values, DML and DDL
@code("values_row", "SELECT 1 AS column_0, 'a' AS column_1, TRUE AS column_2")
def values_row(spark, sf_dir):
    return Engine(spark).sql("VALUES (1, 'a', TRUE)")


@code("insert_values", "SELECT CAST(1 AS INTEGER) AS id, 'Ann' AS name, CAST(NULL AS DOUBLE) AS score UNION ALL SELECT 2, NULL, 1.5 UNION ALL SELECT -3, 'C', 2.0")
def insert_values(spark, sf_dir):
    e = Engine(spark)
    e.sql("CREATE TABLE users (id INT, name VARCHAR(20), score DOUBLE); INSERT INTO users (name, id) VALUES ('Ann', 1); INSERT INTO users VALUES (2, NULL, 1.5), (-3, 'C', 2)")
    return e.sql("SELECT * FROM users")


def _orders_table(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.sql("CREATE TABLE o (k BIGINT, status VARCHAR, price DOUBLE); INSERT INTO o (k, status, price) SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
    return e


@code("insert_select", "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders")
def insert_select(spark, sf_dir):
    return _orders_table(spark, sf_dir).sql("SELECT * FROM o")


@code("update_where", "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders")
def update_where(spark, sf_dir):
    e = _orders_table(spark, sf_dir)
    e.sql("UPDATE o SET price = price * 2, status = 'done' WHERE status = 'F'")
    return e.sql("SELECT * FROM o")


@code("update_all", "SELECT o_orderkey AS k, o_orderstatus AS status, CAST(0 AS DOUBLE) AS price FROM orders")
def update_all(spark, sf_dir):
    e = _orders_table(spark, sf_dir)
    e.sql("UPDATE o SET price = 0")
    return e.sql("SELECT * FROM o")


@code("delete_where", "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE (o_totalprice > 100000) IS NOT TRUE")
def delete_where(spark, sf_dir):
    e = _orders_table(spark, sf_dir)
    e.sql("DELETE FROM o WHERE price > 100000")
    return e.sql("SELECT * FROM o")


@code("delete_all", "SELECT CAST(0 AS BIGINT) AS n")
def delete_all(spark, sf_dir):
    e = _orders_table(spark, sf_dir)
    e.sql("DELETE FROM o")
    return e.sql("SELECT COUNT(*) AS n FROM o")


@code("create_table", "SELECT CAST(0 AS BIGINT) AS n")
def create_table(spark, sf_dir):
    e = Engine(spark)
    e.sql("CREATE TABLE t (a INT, b BIGINT(20), c BOOLEAN, d DATE, e FLOAT(8, 2), f DOUBLE PRECISION, g VARCHAR(255))")
    return e.sql("SELECT COUNT(*) AS n FROM t")


@code("show_tables", "SELECT unnest(['customer', 'events', 'lineitem', 'nation', 'o', 'orders', 'part', 'region', 'supplier']) AS table_name")
def show_tables(spark, sf_dir):
    return _orders_table(spark, sf_dir).sql("SHOW TABLES")


@code("drop_table", "SELECT unnest(['customer', 'events', 'lineitem', 'nation', 'orders', 'part', 'region', 'supplier']) AS table_name")
def drop_table(spark, sf_dir):
    return _orders_table(spark, sf_dir).sql("DROP TABLE o; SHOW TABLES")


# Key-value log: events by user, event_id as sequence number; one event type deletes.
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", kv.DELETE).otherwise(kv.SET).alias("kind"), F.col("value"))


LOG = "WITH log AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS kind, value FROM events)"
NEWEST = "SELECT key, seq, kind, value FROM log{where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) = 1"


def _live(where: str = "", tail: str = "") -> str:
    return f"{LOG} SELECT * FROM ({NEWEST.format(where=where)}) AS x WHERE kind <> 1{tail}"


code("kv_latest", f"{LOG} {NEWEST.format(where='')}")(lambda s, d: kv.latest(event_log(s, d), "key"))
code("kv_tombstone", _live())(lambda s, d: kv.live(event_log(s, d), "key"))
code("kv_snapshot", _live(" WHERE seq <= 500"))(lambda s, d: kv.live(event_log(s, d), "key", snapshot=500))
code("kv_seek_gte", _live(" WHERE key >= 40", " ORDER BY key LIMIT 1"))(lambda s, d: kv.seek_gte(event_log(s, d), 40, "key"))
code("kv_seek_lte", _live(" WHERE key <= 40", " ORDER BY key DESC LIMIT 1"))(lambda s, d: kv.seek_lte(event_log(s, d), 40, "key"))
code("kv_scan_desc", _live())(lambda s, d: kv.scan(event_log(s, d), "key", descending=True))
code("kv_scan_asc", _live())(lambda s, d: kv.scan(event_log(s, d), "key"))
code("kv_compact", _live())(lambda s, d: kv.compacted(event_log(s, d), "key"))
code("kv_compact_upper", f"{LOG} {NEWEST.format(where='')}")(lambda s, d: kv.compacted(event_log(s, d), "key", bottom=False))


@code("kv_prefix", f"{LOG}, text AS (SELECT CAST(key AS VARCHAR) AS key, seq, kind, value FROM log WHERE CAST(key AS VARCHAR) LIKE '1%' AND CAST(key AS VARCHAR) >= '12') SELECT * FROM ({NEWEST.format(where='').replace('FROM log', 'FROM text')}) AS x WHERE kind <> 1 ORDER BY key LIMIT 1")
def kv_prefix(spark, sf_dir):
    return kv.seek_prefix_gte(event_log(spark, sf_dir).withColumn("key", F.col("key").cast("string")), "1", "12", "key")


@code("kv_range_delete", f"{LOG} SELECT * FROM ({NEWEST.format(where=' WHERE NOT (key >= 20 AND key < 60 AND seq < 600)')}) AS x WHERE kind <> 1")
def kv_range_delete(spark, sf_dir):
    log = event_log(spark, sf_dir).select(F.col("key").alias("user_key"), "seq", "kind", F.col("value").cast("string").alias("value"))
    bounds = spark.createDataFrame([(20, 600, kv.RANGE_DELETE, "60")], "user_key long, seq long, kind int, value string")
    rows = log.select("user_key", "seq", "kind", "value").unionByName(bounds)
    kept = kv.without_ranges(rows.withColumn("value", F.when(F.col("kind") == kv.RANGE_DELETE, F.col("value")).otherwise(F.col("value"))).withColumn("user_key", F.lpad(F.col("user_key").cast("string"), 9, "0")).withColumn("value", F.when(F.col("kind") == kv.RANGE_DELETE, F.lpad("value", 9, "0")).otherwise(F.col("value"))))
    return kv.live(kept.withColumn("key", F.col("user_key").cast("bigint")).withColumn("value", F.col("value").cast("double")).drop("user_key"), "key")


@code("kv_merge", f"{LOG} SELECT key, CAST(count(*) AS INTEGER) AS n FROM (SELECT *, max(CASE WHEN kind = 1 THEN seq END) OVER (PARTITION BY key) AS base FROM log) AS x WHERE base IS NULL OR seq > base GROUP BY key")
def kv_merge(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == kv.SET, kv.MERGE).otherwise(F.col("kind")))
    return kv.merged(log, "key", combine=F.size).withColumnRenamed("value", "n")


@code("kv_store", f"{LOG} SELECT key, seq, value FROM ({NEWEST.format(where='')}) AS x WHERE kind <> 1")
def kv_store(spark, sf_dir):
    """The same through a store: appended as a batch, compacted, read."""
    store = kv.KVStore(spark, Engine(spark).catalog.root)
    log = event_log(spark, sf_dir)
    store.append(log.select(F.lpad(F.col("key").cast("string"), 9, "0").cast("binary").alias("user_key"), (F.col("seq") + 1).alias("seq"), "kind", F.concat_ws(":", "seq", "value").cast("binary").alias("value")))
    store.compact()
    parts = F.split(F.col("value").cast("string"), ":")
    return store.items().select(F.col("user_key").cast("string").cast("bigint").alias("key"), parts[0].cast("bigint").alias("seq"), parts[1].cast("double").alias("value"))


code("batch_seq", "SELECT event_id, 1000 + row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events WHERE event_type = 'click'")(lambda s, d: kv.numbered(s.read.parquet(f"{d}/events.parquet").where("event_type = 'click'").select("event_id"), "event_id", 1000).withColumn("seq", F.col("seq").cast("bigint")))
code("key_range_union", "SELECT event_type, min(user_id) AS start, max(user_id) AS end, arg_max(value > 50, (user_id, value > 50)) AS inclusive FROM events GROUP BY event_type")(lambda s, d: kv.key_range(s.read.parquet(f"{d}/events.parquet").withColumn("inc", F.col("value") > 50), "user_id", "user_id", "inc", ["event_type"]))
@code("sorted_check", "SELECT CAST(0 AS BIGINT) AS n, CAST(1 AS BIGINT) AS broken")
def sorted_check(spark, sf_dir):
    """Rows out of order in files written by key, and in a file with one row moved up."""
    path = f"{Engine(spark).catalog.root}/checked"
    sorted_files.write(event_log(spark, sf_dir), path, "key", order=["seq", "kind"])
    at = F.col("_metadata")
    files = spark.read.parquet(path).select(at["file_path"].alias("file"), at["row_index"].alias("at"), "key", "seq", "kind")
    rows = [(0, i, key, seq, kv.SET) for i, (key, seq) in enumerate([(1, 9), (1, 4), (3, 7), (2, 8), (4, 1)])]
    broken = spark.createDataFrame(rows, "file int, at long, key long, seq long, kind int")
    count = lambda df: kv.out_of_order(df, "file", "at", key="key").agg(F.count(F.lit(1)))
    return spark.range(1).select(count(files).scalar().alias("n"), count(broken).scalar().alias("broken"))


@code("kv_compact_snapshot", _live(" WHERE seq <= 500"))
def kv_compact_snapshot(spark, sf_dir):
    """A store read as of an open snapshot after newer rows came and the log was compacted."""
    store = kv.KVStore(spark, Engine(spark).catalog.root)
    rows = event_log(spark, sf_dir).select(F.lpad(F.col("key").cast("string"), 9, "0").cast("binary").alias("user_key"), (F.col("seq") + 1).alias("seq"), "kind", F.concat_ws(":", "seq", "kind", "value").cast("binary").alias("value"))
    store.append(rows.where("seq <= 501"))
    seq = store.snapshot()
    store.append(rows)
    store.compact()
    parts = F.split(F.col("value").cast("string"), ":")
    return store.items(seq).select(F.col("user_key").cast("string").cast("bigint").alias("key"), parts[0].cast("bigint").alias("seq"), parts[1].cast("int").alias("kind"), parts[2].cast("double").alias("value"))


@code("wal_replay", "SELECT n_name AS record FROM nation")
def wal_replay(spark, sf_dir):
    """Records of two logs; a third, the first of all, is dropped after its records were written again."""
    log = Wal(spark, f"{Engine(spark).catalog.root}/wal")
    records = [r["n_name"].encode() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").collect()]
    half = len(records) // 2
    for number, part in ((1, records[:half]), (2, records[half:]), (3, records[:half])):
        log.create(number, part)
    log.obsolete(2)
    return log.read().select(F.col("record").cast("string").alias("record"))


@code("bloom_prune", "SELECT user_id, event_id, value FROM events WHERE user_id = 77")
def bloom_prune(spark, sf_dir):
    path = f"{Engine(spark).catalog.root}/sorted"
    sorted_files.write(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value"), path, "user_id", order=["event_id"])
    return sorted_files.read(spark, path, "user_id", at=77)


@code("ipc_roundtrip", "SELECT * FROM nation")
def ipc_roundtrip(spark, sf_dir):
    return arrow_ipc.from_stream(spark, arrow_ipc.to_stream(spark.read.parquet(f"{sf_dir}/nation.parquet")))


@code("ipc_distributed", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def ipc_distributed(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return arrow_ipc.from_streams(arrow_ipc.to_streams(df), df.schema)


@code("key_functions", "SELECT c_custkey AS k, CASE WHEN c_name < 'Customer#000000500' THEN -1 WHEN c_name > 'Customer#000000500' THEN 1 ELSE 0 END AS cmp, rpad(substr(c_name, 1, 8), 8, '_') AS abbreviated, substr(c_name, 1, length(c_name) - 5) AS prefix, substr(c_name, length(c_name) - 4) AS suffix FROM customer")
def key_functions(spark, sf_dir):
    key = F.col("c_name").cast("binary")
    prefix, suffix = K.split(key, 5)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), K.compare(key, F.lit(b"Customer#000000500")).alias("cmp"), K.abbreviated(key).cast("string").alias("abbreviated"), prefix.cast("string").alias("prefix"), suffix.cast("string").alias("suffix"))


#: Separators by the first byte that differs, and a CRC-32 bit by bit.
SEPARATORS = """
WITH k AS (SELECT c_custkey, c_name, 'Customer#000000700' AS last FROM customer),
d AS (SELECT *, list_min(list_filter(range(1, least(length(c_name), length(last)) + 1), lambda i: substr(c_name, CAST(i AS BIGINT), 1) <> substr(last, CAST(i AS BIGINT), 1))) AS pos FROM k),
b AS (SELECT *, ascii(substr(c_name, pos, 1)) AS x, ascii(substr(last, pos, 1)) AS y FROM d)
SELECT c_custkey, hex(CASE WHEN pos IS NULL OR x >= y THEN c_name WHEN pos < length(last) OR x + 1 < y THEN substr(c_name, 1, pos - 1) || chr(x + 1) ELSE c_name END) AS separator,
  hex(chr(ascii(c_name) + 1)) AS successor,
  xor(CAST(4294967295 AS BIGINT), list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(c_name) + 1), lambda i: CAST(ascii(substr(c_name, CAST(i AS BIGINT), 1)) AS BIGINT)), [CAST(1 AS BIGINT)]),
    lambda c, e: list_reduce(list_concat([xor(c, e)], range(1, 9)), lambda v, n: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END))) AS crc
FROM b
"""


@code("key_separators", SEPARATORS)
def key_separators(spark, sf_dir):
    key, last = F.col("c_name").cast("binary"), F.lit(b"Customer#000000700")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.hex(K.separator(key, last)).alias("separator"), F.hex(K.successor(key)).alias("successor"), K.checksum(key, F.lit(b"\1")).alias("crc"))
