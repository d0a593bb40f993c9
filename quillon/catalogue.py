"""The engine's query catalogue: each operator as a query over the test tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.engine import Engine, EngineError
from quillon.functions import scalar
from quillon.functions.vector import l2
from quillon.operators import joins, knn
from quillon.plans.dialect import nest, rewrite, tokenize
from quillon.plans.statement import parse

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dialect(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query in the dialect over the test tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = spark.newSession()
        own.conf.set("spark.sql.legacy.setopsPrecedence.enabled", "true")
        own.conf.set("spark.sql.session.timeZone", "UTC")
        tokens = tokenize(text)
        words = {t.text.lower() for t in tokens if t.kind == "id"}
        for name in TABLES:
            if name in words:
                table(own, sf_dir, name).createOrReplaceTempView(name)
        return own.sql(rewrite(nest(tokens)))

    return run


#: name -> (text in the dialect, DuckDB SQL or None if the text itself will do).
TEXTS: dict[str, tuple[str, str | None]] = {
    "scan_project": ("SELECT n_nationkey, n_name FROM nation", None),
    "single_row_expr": ("SELECT 1 + 2 AS x, 'a' AS y", None),
    "filter_cmp": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000.0 AND o_orderstatus <> 'F'", None),
    "filter_and_or_not": ("SELECT p_partkey FROM part WHERE (p_size < 10 OR p_size >= 45) AND NOT p_brand = 'Brand#1'", None),
    "filter_between": ("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 1000", None),
    "filter_in_list": ("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)", None),
    "filter_not_in_list": ("SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 3)", None),
    "filter_is_null": ("SELECT n_name, NULLIF(n_regionkey, 2) AS r FROM nation WHERE NULLIF(n_regionkey, 2) IS NULL OR n_name IS NOT NULL", None),
    "filter_like_ci": ("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%CUSTOMER%1_'", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%CUSTOMER%1_'"),
    "truthy_filter": ("SELECT n_name FROM nation WHERE n_regionkey % 2", "SELECT n_name FROM nation WHERE n_regionkey % 2 <> 0"),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders", None),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders", None),
    "cast_text_int": ("SELECT p_partkey, CAST(p_retailprice AS INT) AS whole, p_size::TEXT AS t, '12.7'::INT AS n FROM part", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(p_size AS VARCHAR) AS t, CAST(12 AS BIGINT) AS n FROM part"),
    "join_inner_equi": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_inner_multi_key": ("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", None),
    "join_inner_residual": ("SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20", None),
    "join_theta": ("SELECT a.n_name, b.r_name FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000", None),
    "join_right": ("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000", None),
    "join_cross": ("SELECT a.r_name AS x, b.n_name AS y FROM region a CROSS JOIN nation b", None),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", None),
    "join_multi": ("SELECT r.r_name, n.n_name, s.s_suppkey FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_derived": ("SELECT c.c_custkey, t.n FROM customer c JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS t ON t.o_custkey = c.c_custkey", None),
    "semi_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", None),
    "anti_not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "in_subquery": ("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", None),
    "not_in_subquery": ("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", None),
    "correlated_scalar_count": ("SELECT c.c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c", None),
    "scalar_uncorrelated": ("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)", None),
    "derived_table": ("SELECT t.k, t.v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal < 0) AS t WHERE t.v < -500", None),
    "agg_global": ("SELECT COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 2) AS a FROM orders", "SELECT COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, floor(SUM(o_totalprice) * 100 + 0.5) / 100 AS s, floor(AVG(o_totalprice) * 100 + 0.5) / 100 AS a FROM orders"),
    "agg_empty_input": ("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", None),
    "agg_group": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "agg_count_distinct": ("SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(user_id) AS n FROM events GROUP BY event_type", None),
    "agg_group_concat": ("SELECT n_regionkey, GROUP_CONCAT(n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_having_alias": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12"),
    "agg_having_group_col": ("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey HAVING n_regionkey <> 2", None),
    "agg_group_expr": ("SELECT p_size % 5 AS k, COUNT(*) AS n FROM part GROUP BY p_size % 5", None),
    "agg_order_by_agg": ("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY COUNT(*) DESC, c_nationkey LIMIT 7", None),
    "sort_multi_nulls": ("SELECT NULLIF(n_regionkey, 2) AS r, n_name FROM nation ORDER BY r, n_name DESC LIMIT 9", "SELECT NULLIF(n_regionkey, 2) AS r, n_name FROM nation ORDER BY r NULLS FIRST, n_name DESC LIMIT 9"),
    "limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 15", None),
    "offset_only": ("SELECT n_name FROM nation ORDER BY n_name OFFSET 20", None),
    "topk": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25", None),
    "distinct_rows": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "distinct_sorted_limit": ("SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment LIMIT 3", None),
    "union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "union_distinct": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT n_regionkey FROM nation", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "setop_left_assoc": ("SELECT n_nationkey AS k FROM nation UNION SELECT 99 INTERSECT SELECT n_regionkey FROM nation", "(SELECT n_nationkey AS k FROM nation UNION SELECT 99) INTERSECT SELECT n_regionkey FROM nation"),
    "setop_in_derived": ("SELECT t.k, COUNT(*) AS n FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) AS t GROUP BY t.k", None),
    "fn_string": (
        "SELECT n_nationkey, UPPER(n_name) AS u, LOWER(n_name) AS l, LENGTH(n_name) AS n, TRIM(CONCAT('  ', n_name, ' ')) AS t, LTRIM(n_name, 'AN') AS lt, RTRIM(n_name, 'A') AS rt, SUBSTR(n_name, 0, 3) AS s0, SUBSTRING(n_name, 2) AS s2, REPLACE(n_name, 'A', 'xx') AS r, CONCAT(n_name, NULL, '-', n_regionkey) AS c, n_name || '!' AS b FROM nation",
        "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, CAST(length(n_name) AS INTEGER) AS n, trim('  ' || n_name || ' ') AS t, ltrim(n_name, 'AN') AS lt, rtrim(n_name, 'A') AS rt, substr(n_name, 1, 3) AS s0, substr(n_name, 2) AS s2, replace(n_name, 'A', 'xx') AS r, concat(n_name, NULL, '-', n_regionkey) AS c, n_name || '!' AS b FROM nation",
    ),
    "fn_math": (
        "SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(c_acctbal) AS r, ROUND(c_acctbal, 1) AS r1, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, CEILING(c_acctbal) AS c2, MOD(c_custkey, 7) AS m, POW(c_custkey % 5, 2) AS p, POWER(2, 3) AS p2, ROUND(SQRT(ABS(c_acctbal)), 6) AS q, ROUND(EXP(c_custkey % 3), 6) AS e, ROUND(LN(c_custkey + 1), 6) AS ln, ROUND(LOG10(c_custkey + 1), 6) AS lg, SIGN(c_acctbal) AS s, 7 / 2 AS d, -7 % 3 AS neg FROM customer",
        "SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal + 0.5) AS r, floor(c_acctbal * 10 + 0.5) / 10 AS r1, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(ceil(c_acctbal) AS BIGINT) AS c2, c_custkey % 7 AS m, pow(c_custkey % 5, 2) AS p, 8.0::DOUBLE AS p2, floor(sqrt(abs(c_acctbal)) * 1e6 + 0.5) / 1e6 AS q, floor(exp(c_custkey % 3) * 1e6 + 0.5) / 1e6 AS e, floor(ln(c_custkey + 1) * 1e6 + 0.5) / 1e6 AS ln, floor(log10(c_custkey + 1) * 1e6 + 0.5) / 1e6 AS lg, CAST(sign(c_acctbal) AS DOUBLE) AS s, 3.5::DOUBLE AS d, -1 AS neg FROM customer",
    ),
    "fn_conditional": ("SELECT n_nationkey, IF(n_regionkey > 2, 'hi', 'lo') AS i, GREATEST(n_regionkey, 2, NULL) AS g, LEAST(n_regionkey, 2, NULL) AS l, TYPEOF(n_name) AS t1, TYPEOF(n_regionkey) AS t2, TYPEOF(NULL) AS t3 FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS i, greatest(n_regionkey, 2) AS g, least(n_regionkey, 2) AS l, 'string' AS t1, 'number' AS t2, 'null' AS t3 FROM nation"),
    "fn_null": ("SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), 9) AS c, IFNULL(NULLIF(n_regionkey, 2), 8) AS i, NULLIF(n_regionkey, 3) AS n FROM nation", None),
    "fn_random_seeded": ("SELECT n_nationkey, ROUND(RANDOM(n_nationkey), 4) AS r FROM nation", "SELECT n_nationkey, floor((sin(n_nationkey * 127.1 + 311.7) * 43758.5453 - floor(sin(n_nationkey * 127.1 + 311.7) * 43758.5453)) * 10000 + 0.5) / 10000 AS r FROM nation"),
    "join_full": ("SELECT n.n_name, s.s_suppkey FROM nation n FULL OUTER JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000", None),
    "join_using": ("SELECT n_name, x FROM nation JOIN (SELECT n_nationkey, n_regionkey * 2 AS x FROM nation) AS t USING (n_nationkey)", None),
    "join_natural": ("SELECT r_name, k FROM region NATURAL JOIN (SELECT r_regionkey, r_regionkey + 1 AS k FROM region) AS t", None),
    "is_true_false": ("SELECT n_nationkey, (n_regionkey > 2) IS TRUE AS a, (NULLIF(n_regionkey, 1) > 2) IS NOT FALSE AS b, (NULLIF(n_regionkey, 1) > 2) IS FALSE AS c FROM nation", None),
    "comments": ("SELECT n_name -- the name\n, /* and\nthe key */ n_nationkey FROM nation", None),
    "hex_literal": ("SELECT n_nationkey, 0xFF + n_regionkey AS h FROM nation", "SELECT n_nationkey, 255 + n_regionkey AS h FROM nation"),
    "scalar_first_row": ("SELECT r_regionkey, (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name DESC) AS last FROM region", "SELECT r_regionkey, (SELECT max(n_name) FROM nation WHERE n_regionkey = r_regionkey) AS last FROM region"),
    "scalar_first_row_uncorrelated": ("SELECT r_name FROM region WHERE r_regionkey < (SELECT n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name)", "SELECT r_name FROM region WHERE r_regionkey < 4"),
    "correlated_having": ("SELECT a.n_regionkey, COUNT(*) AS n FROM nation a GROUP BY a.n_regionkey HAVING COUNT(*) > (SELECT COUNT(*) FROM region b WHERE b.r_regionkey <= a.n_regionkey)", None),
    "correlated_on": ("SELECT a.n_name, b.r_name FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = a.n_nationkey AND s.s_acctbal > 5000)", None),
    "now_text": ("SELECT r_name, LENGTH(NOW()) AS n, NOW() LIKE '____-__-__T__:__:__.___Z' AS a, DATE_NOW() LIKE '20__-%Z' AS b FROM region", "SELECT r_name, CAST(24 AS INTEGER) AS n, true AS a, true AS b FROM region"),
    "tpch_like_q1": (
        "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_price, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(AVG(l_discount), 4) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= CAST_TS GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, floor(SUM(l_quantity) * 100 + 0.5) / 100 AS sum_qty, floor(SUM(l_extendedprice) * 100 + 0.5) / 100 AS sum_price, floor(SUM(l_extendedprice * (1 - l_discount)) * 100 + 0.5) / 100 AS sum_disc, floor(AVG(l_discount) * 10000 + 0.5) / 10000 AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    ),
    "tpch_like_q3": (
        "SELECT o.o_orderkey, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY o.o_orderkey ORDER BY revenue DESC, o.o_orderkey LIMIT 10",
        "SELECT o.o_orderkey, floor(SUM(l.l_extendedprice * (1 - l.l_discount)) * 100 + 0.5) / 100 AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY o.o_orderkey ORDER BY revenue DESC, o.o_orderkey LIMIT 10",
    ),
    "tpch_like_q6": ("SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", "SELECT floor(SUM(l_extendedprice * l_discount) * 100 + 0.5) / 100 AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"),
}
TEXTS["tpch_like_q1"] = (TEXTS["tpch_like_q1"][0].replace("CAST_TS", "TIMESTAMP '1998-09-02'"), TEXTS["tpch_like_q1"][1])


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One vector, on the driver, so that it is a literal in the plan."""
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn.nearest(table(spark, sf_dir, "embeddings"), "embedding", query_vector(spark, sf_dir), 10, tie="vec_id")
    return near.select("vec_id", scalar.round_half_up(F.col("distance"), 6).alias("d"))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn.nearest(table(spark, sf_dir, "embeddings").filter("label = 1"), "embedding", query_vector(spark, sf_dir), 10, tie="vec_id")
    return near.select("vec_id", "label", scalar.round_half_up(F.col("distance"), 6).alias("d"))


def vec_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn.within(table(spark, sf_dir, "embeddings"), "embedding", query_vector(spark, sf_dir), 11.0)
    return near.select("vec_id", scalar.round_half_up(F.col("distance"), 6).alias("d"))


def knn_join_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vector of each label to vector 0: a minimum by distance, no sort."""
    all_ = table(spark, sf_dir, "embeddings")
    d = all_.select("label", "vec_id", l2(F.col("embedding"), query_vector(spark, sf_dir)).alias("d"))
    best = d.groupBy("label").agg(F.min(F.struct("d", "vec_id")).alias("m"))
    return best.select("label", F.col("m.vec_id").alias("vec_id"), scalar.round_half_up(F.col("m.d"), 6).alias("d"))


def vec_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of every vector to vector 0, which is a literal of the plan."""
    return table(spark, sf_dir, "embeddings").select("vec_id", scalar.round_half_up(l2(F.col("embedding"), query_vector(spark, sf_dir)), 6).alias("d"))


def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select("n_name", F.nullif("n_regionkey", F.lit(2)).alias("k"))
    b = table(spark, sf_dir, "region").select("r_name", F.nullif("r_regionkey", F.lit(2)).alias("j"))
    return joins.null_safe(a, b, [("k", "j")]).select("n_name", "r_name")


def top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest order of each customer; a window with a limit below it in each task."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("o_custkey", "o_orderkey", "o_totalprice")


def engine(spark: SparkSession) -> Engine:
    """An empty database in the shared folder; where the session names none, in a temporary one on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="db-")
    return Engine.open(spark, f"{root.rstrip('/')}/db-{uuid.uuid4().hex}")


def seeded(spark: SparkSession, sf_dir: str) -> Engine:
    """nation as a table of a database."""
    e = engine(spark)
    e.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT NOT NULL, n_regionkey INTEGER)")
    table(e.spark, sf_dir, "nation").createOrReplaceTempView("source_nation")
    source = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]  # 25 rows
    e.execute("INSERT INTO nation VALUES " + ", ".join(f"({a}, '{b}', {c})" for a, b, c in source))
    return e


def dml_insert_select_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seeded(spark, sf_dir)
    e.execute("INSERT INTO nation SELECT n_nationkey + 100, n_name, NULL FROM nation WHERE n_regionkey = 1")
    return e.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation")


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seeded(spark, sf_dir)
    e.execute("UPDATE nation SET n_regionkey = n_regionkey + 10, n_name = LOWER(n_name) WHERE n_regionkey >= 3")
    return e.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seeded(spark, sf_dir)
    e.execute("DELETE FROM nation WHERE n_regionkey = 0 OR n_name LIKE 'c%'")
    return e.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation")


def time_travel_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seeded(spark, sf_dir)
    before = e.last_xid
    e.execute("DELETE FROM nation WHERE n_regionkey < 4")
    return e.sql(f"SELECT n_nationkey, n_name FROM nation AS OF {before}")


def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seeded(spark, sf_dir)
    for text in ("BEGIN", "DELETE FROM nation", "INSERT INTO nation VALUES (1, 'x', 1)", "ROLLBACK", "BEGIN", "DELETE FROM nation WHERE n_nationkey = 7", "COMMIT"):
        e.execute(text)
    return e.sql("SELECT n_nationkey, n_name FROM nation")


def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seeded(spark, sf_dir)
    e.execute("CREATE INDEX by_region ON nation(n_regionkey, n_name)")
    return e.sql("SELECT n_name FROM nation WHERE n_regionkey = 3 AND n_name >= 'G'")


def replication_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.streaming.follower import Follower

    e = seeded(spark, sf_dir)
    e.execute("UPDATE nation SET n_regionkey = 0 WHERE n_regionkey = 4")
    root = f"{e.store.path}-replica"
    f = Follower(spark, e.store.path, root, f"{root}-checkpoint")
    f.start(None).awaitTermination()
    return f.engine.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation")


def told(run: Callable[[], object]) -> str:
    """What came of a statement: "ok", or the error up to its first colon, quote or bracket."""
    try:
        run()
    except EngineError as e:
        return re.split(r"[:\"\[(]", str(e))[0].strip()
    return "ok"


def rows_of(spark: SparkSession, *rows: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame([(a, str(b)) for a, b in rows], "step string, result string")


def values_of(*rows: tuple[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in rows) + ") AS t(step, result)"


def dml_update_random_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whichever rows a random condition takes, every key is there once."""
    e = seeded(spark, sf_dir)
    e.execute("UPDATE nation SET n_name = 'taken' WHERE RANDOM() < 0.5")
    return e.sql("SELECT n_nationkey, n_regionkey FROM nation")


def dml_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers given by the table, defaults, texts read as numbers, an update from a subquery."""
    e = engine(spark)
    e.execute("CREATE TABLE parcel (id INTEGER PRIMARY KEY, place TEXT NOT NULL, weight REAL DEFAULT 1.5, fragile BOOLEAN DEFAULT false)")
    e.execute("INSERT INTO parcel (place, weight) VALUES ('Oslo', '2.25'), ('Bergen', 'heavy')")
    e.execute("INSERT INTO parcel (place, fragile) VALUES ('Molde', true)")
    e.execute("UPDATE parcel SET weight = (SELECT MAX(weight) FROM parcel) WHERE place LIKE 'b%'")
    return e.sql("SELECT id, place, weight, fragile FROM parcel")


def drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seeded(spark, sf_dir)
    steps = ["DROP TABLE nation", "SELECT * FROM nation", "DROP TABLE nation", "DROP TABLE IF EXISTS nation", "CREATE TABLE nation (a TEXT)", "CREATE TABLE nation (b TEXT)", "CREATE TABLE IF NOT EXISTS nation (b TEXT)"]
    return rows_of(spark, *((f"{i} {t[:11]}", told(lambda: e.execute(t))) for i, t in enumerate(steps)))


def drop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that goes leaves the rows and takes its uniqueness along."""
    e = seeded(spark, sf_dir)
    for text in ("CREATE UNIQUE INDEX by_name ON nation(n_name)", "DROP INDEX by_name", "INSERT INTO nation VALUES (100, 'NATION_18', 9)"):
        e.execute(text)
    return e.sql("SELECT n_nationkey, n_name FROM nation WHERE n_name >= 'NATION_18'")


def unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seeded(spark, sf_dir)
    steps = ["CREATE UNIQUE INDEX u ON nation(n_regionkey)", "CREATE UNIQUE INDEX u ON nation(n_name)", "INSERT INTO nation VALUES (50, 'NATION_18', 0)", "INSERT INTO nation VALUES (51, NULL, 0)", "UPDATE nation SET n_name = 'NATION_18' WHERE n_nationkey < 3", "INSERT INTO nation VALUES (52, 'ATLANTIS', 0)"]
    return rows_of(spark, *((f"{i} {t[:6]}", told(lambda: e.execute(t))) for i, t in enumerate(steps)))


def index_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seeded(spark, sf_dir)
    e.execute("CREATE UNIQUE INDEX by_key ON nation(n_nationkey)")
    return e.sql("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")


def index_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seeded(spark, sf_dir)
    e.execute("CREATE INDEX by_name ON nation(n_name)")
    return e.sql("SELECT n_name FROM nation ORDER BY n_name LIMIT 11")


def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session sees of its own changes, and another one of those that aren't committed."""
    e = seeded(spark, sf_dir)
    a, b = e.session(), e.session()
    count = lambda s: s.execute("SELECT COUNT(*) FROM nation").rows[0][0]
    a.execute("BEGIN")
    a.execute("DELETE FROM nation WHERE n_regionkey = 0")
    rows = [("writer inside", count(a)), ("reader meanwhile", count(b))]
    a.execute("COMMIT")
    return rows_of(spark, *rows, ("reader after", count(b)))


def write_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second writer of a table fails until the first is done; one that lags behind a commit fails, too."""
    e = seeded(spark, sf_dir)
    a, other = e.session(), Engine.open(spark, e.store.path)
    put = lambda s, k: told(lambda: s.execute(f"INSERT INTO nation VALUES ({k}, 'X', 1)"))
    a.execute("BEGIN")
    rows = [("first", put(a, 60)), ("second in the engine", put(e, 61)), ("second elsewhere", put(other, 62)), ("commit", told(lambda: a.execute("COMMIT"))), ("again", put(e, 63))]
    return rows_of(spark, *rows, ("rows", e.execute("SELECT COUNT(*) FROM nation").rows[0][0]))


def ddl_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of a transaction go with it."""
    e = seeded(spark, sf_dir)
    for text in ("BEGIN", "CREATE TABLE extra (x TEXT)", "CREATE INDEX i ON nation(n_name)", "INSERT INTO extra VALUES ('x')", "DROP TABLE nation", "ROLLBACK"):
        e.execute(text)
    return rows_of(spark, ("extra", "extra" in e.tables), ("index", "i" in e.indexes), ("nation", e.execute("SELECT COUNT(*) FROM nation").rows[0][0]))


def txn_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark)
    return rows_of(spark, *((f"{i} {t}", told(lambda: e.execute(t))) for i, t in enumerate(["COMMIT", "ROLLBACK", "BEGIN", "BEGIN", "COMMIT", "START TRANSACTION", "ROLLBACK"])))


def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A process that dies inside a transaction leaves what was committed before."""
    e = seeded(spark, sf_dir)
    for text in ("DELETE FROM nation WHERE n_regionkey = 2", "BEGIN", "DELETE FROM nation", "INSERT INTO nation VALUES (1, 'lost', 1)"):
        e.execute(text)
    e.simulate_crash()
    return Engine.open(spark, e.store.path).sql("SELECT n_nationkey, n_name FROM nation")


def time_travel_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits beyond the window can't be read, nor those that aren't there yet."""
    e = Engine.open(spark, seeded(spark, sf_dir).store.path, depth=3)
    for k in range(4):
        e.execute(f"DELETE FROM nation WHERE n_nationkey = {k}")
    w, count = e.time_travel_window, lambda x: told(lambda: e.execute(f"SELECT COUNT(*) FROM nation AS OF {x}"))
    oldest = e.execute(f"SELECT COUNT(*) FROM nation AS OF {w['oldest']}").rows[0][0]
    return rows_of(spark, ("width", w["newest"] - w["oldest"] + 1), ("oldest", oldest), ("older", count(w["oldest"] - 1)), ("newer", count(w["newest"] + 1)))


def setop_arity_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seeded(spark, sf_dir)
    return rows_of(spark, *((word, told(lambda: e.execute(f"SELECT n_name FROM nation {word} SELECT n_name, n_nationkey FROM nation"))) for word in ("UNION", "INTERSECT ALL", "EXCEPT")))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seeded(spark, sf_dir)
    steps = {"vector sizes": "SELECT [1, 2, 3] <-> [1] AS d", "no vector": "SELECT 'far' <-> [1] AS d", "zero": "SELECT 1 / (n_nationkey - n_nationkey) AS x FROM nation", "domain": "SELECT LOG10(0 - n_nationkey) AS x FROM nation", "not null": "INSERT INTO nation (n_nationkey) VALUES (70)", "key": "INSERT INTO nation VALUES (3, 'x', 0)", "vector key": "CREATE TABLE v (x VECTOR UNIQUE)", "statement": "MERGE nation", "write explained": "EXPLAIN DELETE FROM nation"}
    rows = [(k, told(lambda: e.execute(t))) for k, t in steps.items()]
    return rows_of(spark, *rows, ("rows", e.execute("SELECT COUNT(*) FROM nation").rows[0][0]))


def explain_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN names a nearest-neighbour plan and pushed filters; ANALYZE counts rows without bringing them here."""
    e = seeded(spark, sf_dir)
    near = e.execute("EXPLAIN SELECT n_name FROM nation ORDER BY [n_nationkey, 1] <-> [3, 0] LIMIT 4").explain
    pushed = e.execute("EXPLAIN SELECT n_name FROM nation WHERE n_nationkey = 7").explain
    run = e.execute("EXPLAIN ANALYZE SELECT n_name FROM nation WHERE n_regionkey = 1")
    return rows_of(spark, ("near", near.startswith("knn k=4 metric=l2")), ("pushed", "EqualTo(n_nationkey,7)" in pushed), ("counted", run.analyze.split()[0]), ("rows here", len(run.rows)))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of statements, found without running them."""
    texts = ["SELECT 1", "EXPLAIN ANALYZE SELECT 1", "SELECT x FROM t AS OF 12", "(SELECT 1) UNION (SELECT 2)", "INSERT INTO t VALUES (1)", "UPDATE t SET a = 1", "DELETE FROM t", "CREATE TABLE t (a INT)", "CREATE UNIQUE INDEX i ON t(a)", "DROP INDEX i", "BEGIN", "ROLLBACK"]
    found = [parse(t) for t in texts]
    return rows_of(spark, *((t, f"{s.kind}{' explain' * s.explain}{' analyze' * s.analyze}{'' if s.as_of is None else f' as of {s.as_of}'}") for t, s in zip(texts, found)))


def function_of_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that the caller's session has registered."""
    own = spark.newSession()
    own.sql("CREATE TEMPORARY FUNCTION area(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN a * b")
    return seeded(own, sf_dir).sql("SELECT n_nationkey, AREA(n_nationkey, 2.5) AS x FROM nation")


def replication_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master that is created anew empties the replica; commits that were applied aren't applied again."""
    from quillon.streaming.follower import Follower

    e = seeded(spark, sf_dir)
    root = f"{e.store.path}-replica"
    f = Follower(spark, e.store.path, root, f"{root}-checkpoint")
    f.start(None).awaitTermination()
    applied = len(f.applied)
    f.start(None).awaitTermination()
    again = len(f.applied) - applied
    e = Engine.create(spark, e.store.path)
    e.execute("CREATE TABLE fresh (x TEXT)")
    g = Follower(spark, e.store.path, root, f"{root}-checkpoint2")
    g.start(None).awaitTermination()
    return rows_of(spark, ("applied", applied), ("again", again), ("tables", ",".join(sorted(g.engine.tables))))


VALUES: dict[str, list[tuple[str, str]]] = {
    "drop_table": [("0 DROP TABLE ", "ok"), ("1 SELECT * FR", "Table"), ("2 DROP TABLE ", "Table"), ("3 DROP TABLE ", "ok"), ("4 CREATE TABL", "ok"), ("5 CREATE TABL", "Table"), ("6 CREATE TABL", "ok")],
    "unique_index": [("0 CREATE", "UNIQUE constraint failed"), ("1 CREATE", "ok"), ("2 INSERT", "UNIQUE constraint failed"), ("3 INSERT", "NOT NULL constraint failed"), ("4 UPDATE", "UNIQUE constraint failed"), ("5 INSERT", "ok")],
    "snapshot_read": [("writer inside", "20"), ("reader meanwhile", "25"), ("reader after", "20")],
    "write_conflict": [("first", "ok"), ("second in the engine", "write conflict"), ("second elsewhere", "ok"), ("commit", "write conflict"), ("again", "ok"), ("rows", "27")],
    "ddl_rollback": [("extra", "False"), ("index", "False"), ("nation", "25")],
    "txn_states": [("0 COMMIT", "no transaction in progress"), ("1 ROLLBACK", "no transaction in progress"), ("2 BEGIN", "ok"), ("3 BEGIN", "already in a transaction"), ("4 COMMIT", "ok"), ("5 START TRANSACTION", "ok"), ("6 ROLLBACK", "ok")],
    "time_travel_window": [("width", "3"), ("oldest", "23"), ("older", "AS OF 3"), ("newer", "AS OF 7")],
    "setop_arity_error": [(w, "both sides of a set operation must have the same number of columns") for w in ("UNION", "INTERSECT ALL", "EXCEPT")],
    "errors": [("vector sizes", "vector distance dimension mismatch"), ("no vector", "vector distance"), ("zero", "Division by zero"), ("domain", "log10"), ("not null", "NOT NULL constraint failed"), ("key", "UNIQUE constraint failed"), ("vector key", "VECTOR column"), ("statement", "unsupported statement"), ("write explained", "EXPLAIN is for SELECT statements; a write is not run to be explained"), ("rows", "25")],
    "explain_plans": [("near", "True"), ("pushed", "True"), ("counted", "rows=5"), ("rows here", "0")],
    "parsed": [("SELECT 1", "select"), ("EXPLAIN ANALYZE SELECT 1", "select explain analyze"), ("SELECT x FROM t AS OF 12", "select as of 12"), ("(SELECT 1) UNION (SELECT 2)", "select"), ("INSERT INTO t VALUES (1)", "insert"), ("UPDATE t SET a = 1", "update"), ("DELETE FROM t", "delete"), ("CREATE TABLE t (a INT)", "create_table"), ("CREATE UNIQUE INDEX i ON t(a)", "create_index"), ("DROP INDEX i", "drop_index"), ("BEGIN", "begin"), ("ROLLBACK", "rollback")],
    "replication_reset": [("applied", "2"), ("again", "0"), ("tables", "fresh")],
}

FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "knn_topk": (knn_topk, "SELECT vec_id, floor(d * 1e6 + 0.5) / 1e6 AS d FROM (SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10"),
    "knn_filtered": (knn_filtered, "SELECT vec_id, label, floor(d * 1e6 + 0.5) / 1e6 AS d FROM (SELECT vec_id, label, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS d FROM embeddings WHERE label = 1) ORDER BY d, vec_id LIMIT 10"),
    "vec_filter": (vec_filter, "SELECT vec_id, floor(d * 1e6 + 0.5) / 1e6 AS d FROM (SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS d FROM embeddings) WHERE d < 11.0"),
    "knn_join_label": (knn_join_label, "SELECT label, vec_id, floor(d * 1e6 + 0.5) / 1e6 AS d FROM (SELECT label, vec_id, d, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS r FROM (SELECT label, vec_id, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS d FROM embeddings)) WHERE r = 1"),
    "vec_distance": (vec_distance, "SELECT vec_id, floor(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) * 1e6 + 0.5) / 1e6 AS d FROM embeddings"),
    "join_null_safe": (join_null_safe, "SELECT n_name, r_name FROM nation JOIN region ON NULLIF(n_regionkey, 2) IS NOT DISTINCT FROM NULLIF(r_regionkey, 2)"),
    "top_per_key": (top_per_key, "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1"),
    "dml_insert_select_back": (dml_insert_select_back, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, NULL FROM nation WHERE n_regionkey = 1"),
    "dml_update": (dml_update, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_regionkey >= 3 THEN lower(n_name) ELSE n_name END AS n_name, CAST(CASE WHEN n_regionkey >= 3 THEN n_regionkey + 10 ELSE n_regionkey END AS BIGINT) AS n_regionkey FROM nation"),
    "dml_update_random_keys": (dml_update_random_keys, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    "dml_defaults": (dml_defaults, "SELECT * FROM (VALUES (1::BIGINT, 'Oslo', 2.25::DOUBLE, false), (2, 'Bergen', 2.25, false), (3, 'Molde', 1.5, true)) AS t(id, place, weight, fragile)"),
    "drop_index": (drop_index, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_name >= 'NATION_18' UNION ALL SELECT 100, 'NATION_18'"),
    "index_point_lookup": (index_point_lookup, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey = 7"),
    "index_full_scan": (index_full_scan, "SELECT n_name FROM nation ORDER BY n_name LIMIT 11"),
    "crash_recovery": (crash_recovery, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey <> 2"),
    "function_of_caller": (function_of_caller, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_nationkey * 2.5::DOUBLE AS x FROM nation"),
    "dml_delete": (dml_delete, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE NOT (n_regionkey = 0 OR n_name ILIKE 'c%')"),
    "time_travel_as_of": (time_travel_as_of, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"),
    "txn_rollback": (txn_rollback, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey <> 7"),
    "index_scan": (index_scan, "SELECT n_name FROM nation WHERE n_regionkey = 3 AND n_name >= 'G'"),
    "replication_apply": (replication_apply, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(CASE WHEN n_regionkey = 4 THEN 0 ELSE n_regionkey END AS BIGINT) AS n_regionkey FROM nation"),
}


FRAMES |= {f.__name__: (f, values_of(*VALUES[f.__name__])) for f in (drop_table, unique_index, snapshot_read, write_conflict, ddl_rollback, txn_states, time_travel_window, setop_arity_error, errors, explain_plans, parsed, replication_reset)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: dialect(text) for k, (text, _) in TEXTS.items()} | {k: f for k, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql or text for k, (text, sql) in TEXTS.items()} | {k: sql for k, (_, sql) in FRAMES.items()}
