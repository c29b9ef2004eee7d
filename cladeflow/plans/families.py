"""Trees made from the order tables, in text form, and SQL for what they must give.

A tree stands for a period; its leaves are the nations. Family L is one ladder of all nations, from the
nation with the most orders in the period down; R has a ladder for each region below the root; B has two
ladders below the root, so its two root edges make one unrooted split. The length of a clade is one more
than its orders, that of a leaf its orders. Periods lacking a nation count it with 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.session import table

GROUP = {"L": "0", "R": "n_regionkey", "B": "CASE WHEN n_regionkey < 2 THEN 0 ELSE 1 END"}
GRAIN = {"year": "year(o_orderdate)", "month": "year(o_orderdate) * 100 + month(o_orderdate)"}


def counts(spark: SparkSession, sf_dir: str, family: str, grain: str) -> DataFrame:
    """(period, g, nation, key, cnt), zero-filled."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    per = orders.select(F.expr(GRAIN[grain]).cast("long").alias("period"), F.col("o_custkey"))
    per = per.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    per = per.groupBy("period", "c_nationkey").agg(F.count(F.lit(1)).alias("cnt"))
    # Periods and nations are two small lists; a constant key pairs them.
    names = nation.select(F.expr(GROUP[family]).alias("g"), F.col("n_name").alias("nation"), F.col("n_nationkey").alias("key"), F.lit(0).alias("one"))
    grid = per.select("period", F.lit(0).alias("one")).distinct().join(names, "one")
    full = grid.join(per, (grid["period"] == per["period"]) & (grid["key"] == per["c_nationkey"]), "left")
    return full.select(grid["period"], "g", "nation", "key", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def ladder(arr: Column, inner: Column | None = None) -> Column:
    """Text of the ladder of (neg, nation, label): "(a:1,(b:1,c:1):3)"."""
    m = F.size(arr)
    leaf = lambda x: F.concat(x["label"], F.lit(":"), (-x["neg"]).cast("string"))
    opened = F.array_join(F.transform(F.slice(arr, F.lit(1), m - 1), lambda x: F.concat(F.lit("("), leaf(x), F.lit(","))), "")
    closed = F.when(m > 2, F.array_join(F.transform(F.sequence(m - 1, F.lit(2), F.lit(-1)), lambda k: F.concat(F.lit("):"), length(arr, k))), "")).otherwise("")
    return F.concat(opened, leaf(F.element_at(arr, -1)), closed, F.lit(")"))


def length(arr: Column, k: Column) -> Column:
    """Orders of the nations from place k on, and one."""
    return (F.aggregate(F.slice(arr, k, F.size(arr)), F.lit(0).cast("long"), lambda a, x: a - x["neg"]) + 1).cast("string")


def trees(spark: SparkSession, sf_dir: str, family: str = "R", grain: str = "year", label: str = "nation") -> DataFrame:
    """(tree_id, name, newick): tree_id is the period."""
    c = counts(spark, sf_dir, family, grain)
    text = F.concat(F.lit("'"), F.col("nation"), F.lit("'")) if label == "nation" else F.col("key").cast("string")
    groups = c.groupBy("period", "g").agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), "nation", text.alias("label")))).alias("a"))
    part = F.concat(ladder(F.col("a")), F.lit(":"), length(F.col("a"), F.lit(1))) if family != "L" else ladder(F.col("a"))
    whole = groups.groupBy("period").agg(F.sort_array(F.collect_list(F.struct("g", part.alias("t")))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["t"]), ",")
    newick = F.concat(joined, F.lit(";")) if family == "L" else F.concat(F.lit("("), joined, F.lit(");"))
    return whole.select(F.col("period").alias("tree_id"), F.concat(F.lit("orders_STATE_"), F.col("period").cast("string")).alias("name"), newick.alias("newick"))


def sql(family: str, grain: str = "year") -> str:
    """CTEs for DuckDB: `ladder` (period, g, pos, nation, key, cnt, r, leaf_no), `clade` (period, g, k, members, length)."""
    first = 2 if family == "L" else 1
    return f"""
per AS (
  SELECT {GRAIN[grain]} AS period, c_nationkey AS key, count(*) AS cnt
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), ranks AS (
  SELECT n_nationkey AS key, n_name AS nation, {GROUP[family]} AS g, row_number() OVER (ORDER BY n_name) - 1 AS r FROM nation
), grid AS (
  SELECT p.period, ranks.*, coalesce(cnt, 0) AS cnt
  FROM (SELECT DISTINCT period FROM per) p CROSS JOIN ranks LEFT JOIN per ON per.period = p.period AND per.key = ranks.key
), ladder AS (
  SELECT *, row_number() OVER (PARTITION BY period, g ORDER BY cnt DESC, nation) AS pos,
    row_number() OVER (PARTITION BY period ORDER BY g, cnt DESC, nation) AS leaf_no
  FROM grid
), clade AS (
  SELECT a.period, a.g, a.pos AS k, list_sort(list(b.r)) AS members, (sum(b.cnt) + 1)::DOUBLE AS length
  FROM ladder a JOIN ladder b ON a.period = b.period AND a.g = b.g AND b.pos >= a.pos
  WHERE a.pos >= {first} GROUP BY ALL HAVING count(*) > 1
)"""


def split_sql(family: str, grain: str = "year", rooted: bool = False) -> str:
    """sql() and `split` (period, s, length), unrooted or rooted."""
    if rooted:
        return sql(family, grain) + ", split AS (SELECT period, array_to_string(members, ',') AS s, length FROM clade)"
    return (
        sql(family, grain)
        + """, side AS (
  SELECT period, CASE WHEN list_contains(members, 0) THEN list_filter(range(25), lambda x: NOT list_contains(members, x)) ELSE members END AS m, length FROM clade
), split AS (
  SELECT period, array_to_string(m, ',') AS s, sum(length) AS length FROM side WHERE len(m) > 1 AND len(m) < 24 GROUP BY ALL
)"""
    )


def distance_sql(family: str, metric: str, grain: str = "year", rooted: bool = False) -> str:
    """Distances of all pairs of periods, from the definition."""
    value = {
        "rf": "sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT",
        "weighted": "sum(CASE WHEN n = 1 THEN a + b ELSE abs(a - b) END)",
        "kf": "round(sqrt(sum((a - b) * (a - b))), 6)",
    }[metric]
    return f"""WITH {split_sql(family, grain, rooted)}, pair AS (
  SELECT x.period AS i, y.period AS j FROM (SELECT DISTINCT period FROM per) x JOIN (SELECT DISTINCT period FROM per) y ON x.period < y.period
), ends AS (
  SELECT i, j, s, length AS a, 0.0::DOUBLE AS b FROM pair JOIN split ON period = i
  UNION ALL SELECT i, j, s, 0.0::DOUBLE, length FROM pair JOIN split ON period = j
), d AS (
  SELECT i, j, s, sum(a) AS a, sum(b) AS b, count(*) AS n FROM ends GROUP BY i, j, s
)
SELECT i, j, {value} AS dist FROM d GROUP BY i, j"""
