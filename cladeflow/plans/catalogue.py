"""Queries of the tree engine over the provided tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeflow.functions import base_name, burn_in, complement, name_state, strip_annotations, tree_name
from cladeflow.operators import full_matrix, pairwise, parse, root_children, snapshots, to_splits
from cladeflow.operators.checks import leaf_sets
from cladeflow.operators.newick import clades
from cladeflow.plans import families
from cladeflow.plans.registry import ORACLES, QUERIES, register, text_of
from cladeflow.session import table

def distances(spark: SparkSession, sf_dir: str, family: str, metric: str, rooted: bool = False, grain: str = "year", method: str = "block") -> DataFrame:
    t = families.trees(spark, sf_dir, family, grain)
    d = pairwise(to_splits(t, rooted), t, metric, method)
    return d.withColumn("dist", F.round("dist", 6)) if metric == "kf" else d


for _name, _family, _metric, _rooted, _grain, _method in (
    ("rf_unrooted", "R", "rf", False, "year", "block"),
    ("rf_rooted", "R", "rf", True, "year", "block"),
    ("wrf_unrooted", "R", "weighted", False, "year", "block"),
    ("wrf_rooted", "R", "weighted", True, "year", "block"),
    ("kf_unrooted", "R", "kf", False, "year", "block"),
    ("kf_rooted", "R", "kf", True, "year", "block"),
    ("rf_ladder", "L", "rf", False, "year", "join"),
    ("wrf_ladder", "L", "weighted", False, "year", "join"),
    ("kf_ladder", "L", "kf", False, "year", "join"),
    ("rf_merged_root", "B", "rf", False, "year", "join"),
    ("wrf_merged_root", "B", "weighted", False, "year", "join"),
    ("kf_merged_root", "B", "kf", False, "year", "block"),
    ("rf_monthly", "R", "rf", False, "month", "block"),
    ("wrf_monthly", "R", "weighted", False, "month", "block"),
    ("kf_monthly", "R", "kf", False, "month", "block"),
    ("rf_monthly_join", "R", "rf", False, "month", "join"),
    ("wrf_monthly_join", "R", "weighted", True, "month", "join"),
    ("kf_monthly_join", "R", "kf", True, "month", "join"),
):
    QUERIES[_name] = lambda s, d, a=(_family, _metric, _rooted, _grain, _method): distances(s, d, *a)
    ORACLES[_name] = families.distance_sql(_family, _metric, _grain, _rooted)


@register("newick_leaves", f"WITH {families.sql('R')} SELECT period AS tree_id, leaf_no::INTEGER AS leaf_no, nation AS name, r::INTEGER AS rank FROM ladder")
def newick_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of every tree in order, with their ranks."""
    leaves, _, _ = parse(families.trees(spark, sf_dir))
    return leaves.select("tree_id", F.col("leaf_no").cast("int").alias("leaf_no"), "name", F.col("rank").cast("int").alias("rank"))


@register("newick_clades", f"WITH {families.sql('R')} SELECT period AS tree_id, array_to_string(members, ',') AS clade, length FROM clade")
def newick_clades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal nodes below the root."""
    return clades(families.trees(spark, sf_dir)).where("level > 1").select("tree_id", text_of("clade").alias("clade"), "length")


def _splits(spark: SparkSession, sf_dir: str, family: str, rooted: bool) -> DataFrame:
    return to_splits(families.trees(spark, sf_dir, family), rooted).select("tree_id", text_of("split").alias("split"), "length")


for _name, _family, _rooted in (("splits_unrooted", "R", False), ("splits_ladder", "L", False), ("root_split_merge", "B", False), ("clades_rooted", "B", True)):
    QUERIES[_name] = lambda s, d, a=(_family, _rooted): _splits(s, d, *a)
    ORACLES[_name] = f"WITH {families.split_sql(_family, 'year', _rooted)} SELECT period AS tree_id, s AS split, length FROM split"


@register("split_counts", f"WITH {families.split_sql('B', 'month')} SELECT period AS tree_id, count(*) AS parts, sum(length) AS total, 25 AS leaves FROM split GROUP BY period")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots: number of parts, their total length and the leaves of every monthly tree."""
    s = snapshots(families.trees(spark, sf_dir, "B", "month"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["length"])
    return s.select("tree_id", F.size("parts").cast("long").alias("parts"), total.alias("total"), F.col("n").alias("leaves"))


@register("complement", f"WITH {families.sql('R')} SELECT period AS tree_id, array_to_string(members, ',') AS clade, array_to_string(list_filter(range(25), lambda x: NOT list_contains(members, x)), ',') AS other FROM clade")
def complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clade and the leaves outside it."""
    c = clades(families.trees(spark, sf_dir)).where("level > 1").withColumn("rest", complement(F.col("clade"), F.col("n")))
    return c.select("tree_id", text_of("clade").alias("clade"), text_of("rest").alias("other"))


@register("root_children", f"WITH {families.sql('R')} SELECT period AS tree_id, string_agg(array_to_string(members, ','), ';' ORDER BY members) AS children FROM clade WHERE k = 1 GROUP BY period")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted clades right below the root."""
    c = root_children(families.trees(spark, sf_dir))
    return c.select("tree_id", F.array_join(F.transform("children", lambda x: F.concat_ws(",", x.cast("array<string>"))), ";").alias("children"))


@register("leaf_set_check", f"WITH {families.sql('L', 'month')} SELECT period AS tree_id, count(*) AS leaves, string_agg(nation, ',' ORDER BY nation) AS names, true AS same FROM ladder GROUP BY period")
def leaf_set_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf set of every tree, and whether it is that of the first."""
    s = leaf_sets(families.trees(spark, sf_dir, "L", "month"))
    first = s.agg(F.min(F.struct("tree_id", "names"))["names"].alias("want"))
    both = s.withColumn("one", F.lit(0)).join(first.withColumn("one", F.lit(0)), "one")
    return both.select("tree_id", F.size("names").cast("long").alias("leaves"), F.array_join("names", ",").alias("names"), (F.col("names") == F.col("want")).alias("same"))


@register("translate_rename", f"WITH {families.sql('L')} SELECT period AS tree_id, leaf_no::INTEGER AS leaf_no, CASE WHEN key % 7 <> 6 THEN nation END AS name FROM ladder")
def translate_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves renamed by a translate map; a label that the map lacks becomes null."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 7 <> 6")
    names = nation.agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name"))).alias("map"))
    t = families.trees(spark, sf_dir, "L", "year", "key").withColumn("one", F.lit(0)).join(names.withColumn("one", F.lit(0)), "one")
    leaves, _, _ = parse(t, use_map=True)
    return leaves.select("tree_id", F.col("leaf_no").cast("int").alias("leaf_no"), "name")


@register("rf_cross_file_maps", f"SELECT i * 10 AS i, j * 10 + 1 AS j, dist FROM ({families.distance_sql('R', 'rf')})")
def rf_cross_file_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances across two sources of the same trees, one labelled by name, one by number and translated."""
    nation = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("string").alias("k"))
    maps = nation.agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_name").alias("v")))).alias("own"), F.map_from_entries(F.collect_list(F.struct("k", F.col("n_name").alias("v")))).alias("numbered"))
    one = maps.withColumn("one", F.lit(0))
    a = families.trees(spark, sf_dir, "R").withColumn("one", F.lit(0)).join(one, "one").select((F.col("tree_id") * 10).alias("tree_id"), "newick", F.col("own").alias("map"))
    b = families.trees(spark, sf_dir, "R", "year", "key").withColumn("one", F.lit(0)).join(one, "one").select((F.col("tree_id") * 10 + 1).alias("tree_id"), "newick", F.col("numbered").alias("map"))
    t = a.union(b)
    d = pairwise(to_splits(t, False, use_map=True), t, "rf", "block")
    return d.where("i % 10 = 0 and j % 10 = 1 and i < j - 1")


@register("rf_matrix_symmetric", f"""WITH up AS ({families.distance_sql('L', 'rf')}), ids AS (SELECT i AS t FROM up UNION SELECT j FROM up)
SELECT i, j, dist FROM up UNION ALL SELECT j, i, dist FROM up UNION ALL SELECT t, t, 0 FROM ids""")
def rf_matrix_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both triangles and the diagonal."""
    t = families.trees(spark, sf_dir, "L")
    return full_matrix(pairwise(to_splits(t), t, "rf", "block"), t)


@register("tsv_rows", f"""WITH up AS ({families.distance_sql('R', 'rf')}), ids AS (SELECT i AS t FROM up UNION SELECT j FROM up),
f AS (SELECT i, j, dist FROM up UNION ALL SELECT j, i, dist FROM up UNION ALL SELECT t, t, 0 FROM ids)
SELECT 'orders_STATE_' || i || chr(9) || string_agg(dist::VARCHAR, chr(9) ORDER BY j) AS line FROM f GROUP BY i""")
def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the labelled table."""
    t = families.trees(spark, sf_dir)
    m = full_matrix(pairwise(to_splits(t), t, "rf", "block"), t).join(t.select(F.col("tree_id").alias("i"), "name"), "i")
    row = m.groupBy("i", "name").agg(F.sort_array(F.collect_list(F.struct("j", "dist"))).alias("r"))
    return row.select(F.concat_ws("\t", "name", F.array_join(F.transform("r", lambda x: x["dist"].cast("string")), "\t")).alias("line"))


@register("pair_counts", """WITH per AS (SELECT DISTINCT year(o_orderdate) * 100 + month(o_orderdate) AS period FROM orders)
SELECT count(*) AS trees, count(*) * (count(*) - 1) // 2 AS pairs, (SELECT count(*) FROM nation) AS taxa FROM per""")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that the command line reports."""
    leaves, _, _ = parse(families.trees(spark, sf_dir, "R", "month"))
    return leaves.agg(F.countDistinct("tree_id").alias("trees"), F.countDistinct("name").alias("taxa")).select("trees", F.expr("trees * (trees - 1) div 2").alias("pairs"), "taxa")


BODY = "concat('(a[&rate=', l_orderkey, ']:', l_linenumber, ',b[x]:', l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN ')[&open' ELSE ')[&R];' END)"


@register("strip_annotations", f"SELECT l_orderkey, l_linenumber, regexp_replace({BODY}, '\\[&[^\\]]*(\\]|$)', '', 'g') AS body FROM lineitem")
def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations taken out of tree text; plain brackets stay."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(BODY).alias("body"))
    return lines.select("l_orderkey", "l_linenumber", strip_annotations(F.col("body")).alias("body"))


HEADER = """CASE o_orderkey % 6 WHEN 0 THEN concat('tree STATE_', o_orderkey) WHEN 1 THEN concat('TREE x_state_', o_custkey, ' [&lnP]') WHEN 2 THEN 'tree foo'
WHEN 3 THEN concat('treeSTATE_', o_orderkey) WHEN 4 THEN 'tree STATE_' ELSE concat('tree STATE_', o_orderkey, '99999999999999999999') END"""


@register("extract_name_state", f"""WITH h AS (SELECT o_orderkey, {HEADER} AS header FROM orders), p AS (
  SELECT *, regexp_extract(header, '^[^ ]* \\s*(\\S+)', 1) AS n, regexp_extract(header, '(?i)STATE_(\\d*)', 1) AS d FROM h
), q AS (SELECT *, n <> '' AND d <> '' AND TRY_CAST(d AS UBIGINT) IS NOT NULL AS ok FROM p)
SELECT o_orderkey, CASE WHEN ok THEN n ELSE '' END AS name, CASE WHEN ok THEN d ELSE '0' END AS state FROM q""")
def header_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and state of tree headers."""
    h = table(spark, sf_dir, "orders").select("o_orderkey", name_state(F.expr(HEADER)).alias("x"))
    return h.select("o_orderkey", F.col("x.name").alias("name"), F.col("x.state").cast("string").alias("state"))


@register("tree_names", """SELECT o_orderkey, concat('file', o_orderkey % 3, '_', CASE WHEN regexp_replace(f, '(\\.trees)+$', '') = '' THEN 'unknown' ELSE regexp_replace(f, '(\\.trees)+$', '') END, '_', 'STATE_', o_orderkey) AS name
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'run.trees' WHEN 1 THEN 'run.trees.trees' WHEN 2 THEN '.trees' ELSE 'run.tre' END AS f FROM orders)""")
def tree_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names composed of file number, file name and tree name."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN '/a/run.trees' WHEN 1 THEN 'b/run.trees.trees' WHEN 2 THEN 'c/.trees' ELSE 'run.tre' END AS path")
    return o.select("o_orderkey", tree_name(base_name(F.col("path")), F.concat(F.lit("STATE_"), F.col("o_orderkey").cast("string")), F.col("o_orderkey") % 3).alias("name"))


def _burn(spark: SparkSession, sf_dir: str, trees: int, states: int) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("file"), "o_orderkey")
    o = o.withColumn("idx", F.row_number().over(Window.partitionBy("file").orderBy("o_orderkey")) - 1)
    o = o.withColumn("state", (F.col("idx") * 10).cast("decimal(20,0)"))
    return o.where(burn_in(F.col("idx"), F.col("state"), trees, states)).select("file", "o_orderkey", F.col("idx").cast("int").alias("idx"))


for _name, _trees, _states, _where in (("burnin_none", 0, 0, "true"), ("burnin_trees", 50, 0, "idx >= 50"), ("burnin_states", 0, 300, "idx * 10 > 300"), ("burnin_or", 50, 300, "idx >= 50 OR idx * 10 > 300")):
    QUERIES[_name] = lambda s, d, a=(_trees, _states): _burn(s, d, *a)
    ORACLES[_name] = f"""SELECT file, o_orderkey, idx::INTEGER AS idx FROM (SELECT year(o_orderdate)::INTEGER AS file, o_orderkey,
  row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) - 1 AS idx FROM orders) WHERE {_where}"""


from cladeflow.plans import file_catalogue  # noqa: E402, F401  (adds its queries to the same tables)
