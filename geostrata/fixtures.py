"""Map-shaped tables derived from the star-schema tables, by integer arithmetic that Spark and DuckDB evaluate alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPARK_EPOCH = "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {0}) AS BIGINT)"
DUCK_EPOCH = "CAST(FLOOR(epoch({0})) AS BIGINT)"

#: @epoch(x) is the engine's epoch seconds.
VIEWS = {
    "nodes": """
        SELECT id, CAST(1 + id % 5 AS BIGINT) AS version, timestamp, user_id,
               CAST(-1200000000 + (id % 1000) * 2000000 + (id * 7919) % 1999993 AS INT) AS lon,
               CAST(-600000000 + (CAST(FLOOR(id / 1000) AS BIGINT) % 600) * 2000000 + (id * 104729) % 1999993 AS INT) AS lat
        FROM (SELECT 4 * l_orderkey + l_linenumber AS id, MIN(@epoch(l_shipdate)) AS timestamp, MIN(l_suppkey) AS user_id
              FROM lineitem GROUP BY 4 * l_orderkey + l_linenumber)
        UNION ALL
        SELECT 1000000000 + c_custkey, CAST(1 AS BIGINT), CAST(852076800 + c_custkey AS BIGINT), CAST(c_nationkey AS BIGINT),
               CAST(-1700000000 + (c_custkey * 15485863) % 3400000000 AS INT), CAST(-800000000 + (c_custkey * 32452843) % 1600000000 AS INT)
        FROM customer""",
    "way_nodes": """
        SELECT l_orderkey + 1 AS way_id, 4 * l_orderkey + l_linenumber AS node_id,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS seq
        FROM lineitem""",
    "ways": """
        SELECT o_orderkey + 1 AS id, CAST(1 + o_orderkey % 4 AS BIGINT) AS version, @epoch(o_orderdate) AS timestamp, o_custkey AS user_id,
               o_orderpriority AS priority, o_orderstatus AS status
        FROM orders""",
    "relations": """
        SELECT c_custkey + 1 AS id, CAST(1 + c_custkey % 3 AS BIGINT) AS version, CAST(852076800 + c_custkey AS BIGINT) AS timestamp,
               CAST(c_nationkey AS BIGINT) AS user_id, c_mktsegment AS segment
        FROM customer""",
    "rel_members": """
        SELECT rel_id, mem_type, mem_ref, CAST(ROW_NUMBER() OVER (PARTITION BY rel_id ORDER BY mem_type, mem_ref) - 1 AS BIGINT) AS seq FROM (
            SELECT CAST(FLOOR(o_orderkey / 10) AS BIGINT) + 1 AS rel_id, 1 AS mem_type, o_orderkey + 1 AS mem_ref
            FROM orders WHERE CAST(FLOOR(o_orderkey / 10) AS BIGINT) % 97 <> 5
            UNION ALL
            SELECT CAST(FLOOR(l_orderkey / 10) AS BIGINT) + 1, 0, MIN(4 * l_orderkey + l_linenumber) FROM lineitem
            WHERE CAST(FLOOR(l_orderkey / 10) AS BIGINT) % 3 = 0 AND CAST(FLOOR(l_orderkey / 10) AS BIGINT) % 97 <> 5
            GROUP BY CAST(FLOOR(l_orderkey / 10) AS BIGINT) + 1
            UNION ALL
            SELECT c_custkey + 1, 0, 1000000000 + c_custkey FROM customer WHERE c_custkey % 30 = 0 AND c_custkey % 97 <> 5
            UNION ALL
            SELECT c_custkey + 1, 2, c_custkey + 2 FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 97 <> 5)""",
    "changes": """
        SELECT seq, changetype, elem_type,
               CASE WHEN changetype = 5 THEN 2000000000 + event_id WHEN elem_type = 0 THEN n_id
                    WHEN elem_type = 1 THEN p % nw + 1 ELSE p % nr + 1 END AS id,
               CAST(version AS BIGINT) AS version, timestamp, user_id, event_id AS pos
        FROM (SELECT event_id, user_id,
                     CASE WHEN event_id % 4 < 2 THEN (event_id % 101) * 37 ELSE event_id * 37 END AS p,
                     CAST(EXTRACT(DAY FROM ts) AS BIGINT) AS seq, @epoch(ts) AS timestamp, 6 + event_id AS version,
                     CASE event_type WHEN 'signup' THEN 5 WHEN 'error' THEN 1 ELSE 4 END AS changetype,
                     CASE WHEN event_id % 10 <= 5 THEN 0 WHEN event_id % 10 <= 8 THEN 1 ELSE 2 END AS elem_type
              FROM events) e
        CROSS JOIN (SELECT (SELECT COUNT(DISTINCT 4 * l_orderkey + l_linenumber) FROM lineitem) AS nn,
                           (SELECT COUNT(*) FROM orders) AS nw, (SELECT COUNT(*) FROM customer) AS nr) k
        LEFT JOIN (SELECT n_id, ROW_NUMBER() OVER (ORDER BY n_id) - 1 AS rn
                   FROM (SELECT DISTINCT 4 * l_orderkey + l_linenumber AS n_id FROM lineitem)) ni
        ON e.elem_type = 0 AND ni.rn = e.p % k.nn""",
}
BASE = ("lineitem", "orders", "customer", "events")
#: What counts and numbers all nodes in the changes, which Spark would do in one task.
COUNTED = "(SELECT COUNT(DISTINCT 4 * l_orderkey + l_linenumber) FROM lineitem)"
NUMBERED = """(SELECT n_id, ROW_NUMBER() OVER (ORDER BY n_id) - 1 AS rn
                   FROM (SELECT DISTINCT 4 * l_orderkey + l_linenumber AS n_id FROM lineitem))"""
SPAN = 1 << 20


def _with_epoch(sql: str, form: str) -> str:
    while "@epoch(" in sql:
        a = sql.index("@epoch(")
        b = sql.index(")", a)
        sql = sql[:a] + form.format(sql[a + 7 : b]) + sql[b + 1 :]
    return sql


def numbered_nodes(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """n, how many nodes each span of SPAN ids has, and n_id, rn: each node's place in order, from 0. A task orders the nodes of a span, so SPAN at most; only the spans are ordered in one."""
    ids = lineitem.select((4 * F.col("l_orderkey") + F.col("l_linenumber")).alias("n_id")).where("n_id is not null").distinct().withColumn("_span", F.floor(F.col("n_id") / SPAN))
    sizes = ids.groupBy("_span").agg(F.count("*").alias("n"))
    starts = sizes.select("_span", (F.sum("n").over(Window.orderBy("_span")) - F.col("n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_span").orderBy("n_id")) - 1
    return sizes, ids.join(F.broadcast(starts), "_span").select("n_id", (F.col("_start") + place).alias("rn"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table in Spark."""
    sql = _with_epoch(VIEWS[name], SPARK_EPOCH)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"FROM {t}" in sql}
    if NUMBERED in sql:
        sql = sql.replace(COUNTED, "(SELECT COALESCE(SUM(n), 0) FROM {counted})").replace(NUMBERED, "{numbered}")
        tables["counted"], tables["numbered"] = numbered_nodes(tables.pop("lineitem"))
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **tables)


def duck(*names: str) -> str:
    """The fixture tables as common table expressions for DuckDB: 'nodes AS (...), ...'."""
    return ",\n".join(f"{n} AS ({_with_epoch(VIEWS[n], DUCK_EPOCH)})" for n in names)
