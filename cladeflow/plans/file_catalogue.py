"""Queries of the file path: tree files, translate blocks, Newick lists, entry points, sinks; with their DuckDB equivalents.

The trees are those of `families`. Where a query starts from files, it first writes them to the shared folder: a
collection of the yearly ladders, labelled by nation key, with a TRANSLATE block, an annotation on every tree
and lines that are no trees around the block.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import cladeflow
from cladeflow import api
from cladeflow.functions import count_ones, packed, packed_union, set_union
from cladeflow.functions.sets import Bitset
from cladeflow.operators import first_trees, pairwise, parse, root_children, to_splits
from cladeflow.operators.splits import rename_leaf_nodes, snapshots
from cladeflow.operators.tree_values import TreeSnapshot, kf_from_snapshots, rf_from_snapshots, weighted_rf_from_snapshots
from cladeflow.plans import families
from cladeflow.plans.registry import register, text_of
from cladeflow.session import scratch, ship, table
from cladeflow.sources import format_number, newick_iter, newick_list, read_beast_trees, read_tree_files, write_matrix_tsv
from cladeflow.sources.nexus import translate_table, tree_lines

#: Newick text of the yearly ladders, labelled by nation key.
TEXT = families.sql("L") + """, spine AS (
  SELECT *, count(*) OVER (PARTITION BY period) AS m, sum(cnt) OVER (PARTITION BY period ORDER BY pos DESC) + 1 AS len FROM ladder
), newick AS (
  SELECT period, string_agg('(' || key || ':' || cnt || ',', '' ORDER BY pos) FILTER (pos < m)
    || max(key || ':' || cnt) FILTER (pos = m) || coalesce(string_agg('):' || len, '' ORDER BY pos DESC) FILTER (pos > 1 AND pos < m), '') || ');' AS newick
  FROM spine GROUP BY period
)"""
#: Every pair of yearly trees in both directions, and the diagonal, with names; `{d}` is a table of (i, j, dist).
NAMED = """, full_ AS (
  SELECT i, j, dist FROM {d} UNION ALL SELECT j, i, dist FROM {d} UNION ALL SELECT t, t, 0 FROM (SELECT i AS t FROM {d} UNION SELECT j FROM {d})
)"""


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.trees(spark, sf_dir, "L", "year", "key")


def write_tree_files(spark: SparkSession, sf_dir: str, files: int = 1, broken: bool = False) -> list[str]:
    """`files` tree files run0.trees, run1.trees.trees, ... in the shared folder, the years dealt by remainder; of a broken one every third tree is cut off."""
    t = ladders(spark, sf_dir).withColumn("f", (F.col("tree_id") % files).cast("int"))
    text = F.when(F.col("tree_id") % 3 == 0, F.substring("newick", 1, 40)).otherwise(F.col("newick")) if broken else F.col("newick")
    line = F.concat(F.lit("tree STATE_"), F.col("tree_id").cast("string"), F.lit(" [&lnP=-1.5] = [&R] "), F.replace(text, F.lit(","), F.lit("[&rate=0.5],")))
    trees = t.groupBy("f").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tree_id", line.alias("x")))), lambda p: p["x"]), "\n").alias("trees"))
    entry = F.concat(F.lit("\t\t"), F.col("n_nationkey").cast("string"), F.lit(" '"), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("',"))
    labels = table(spark, sf_dir, "nation").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n_nationkey", entry.alias("x"))))["x"], "\n").alias("labels"))
    whole = trees.withColumn("one", F.lit(0)).join(labels.withColumn("one", F.lit(0)), "one")
    head, middle, tail = "#NEXUS\n[x = y]\nBegin trees;\n\tTranslate\n", "\n\t\t;\n", "\nno tree here\nEnd;\ntree after = (1,2);\n"
    whole = whole.select("f", F.concat(F.lit(head), "labels", F.lit(middle), "trees", F.lit(tail)).alias("value"))
    folder = scratch(spark, "tree-files")
    whole.repartition(1, "f").sortWithinPartitions("f").write.partitionBy("f").option("lineSep", "\n").text(folder)
    return [_renamed(spark, f"{folder}/f={i}", f"run{i}{'.trees' * (i + 1)}") for i in range(files)]


def _renamed(spark: SparkSession, folder: str, name: str) -> str:
    """The only file that Spark wrote into a folder, under another name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(path(folder)) if x.getPath().getName().startswith("part-"))
    fs.rename(part, path(f"{folder}/{name}"))
    return f"{folder}/{name}"


@register("nexus_scan", f"WITH {TEXT} SELECT period - 1995 AS idx, 'run0_STATE_' || period AS name, period::VARCHAR AS state, newick, 25 AS labels FROM newick WHERE period > 1996")
def nexus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree file: its trees past a burn-in of states, annotations gone, each with the labels of the TRANSLATE block."""
    _, trees = read_beast_trees(spark, write_tree_files(spark, sf_dir)[0], burnin_states=1996)
    return trees.select(F.col("idx").cast("long").alias("idx"), "name", F.col("state").cast("string").alias("state"), F.trim("newick").alias("newick"), F.size("map").alias("labels"))


@register("nexus_real_taxa", f"WITH {TEXT} SELECT period - 1995 AS tree_id, leaf_no::INTEGER AS leaf_no, replace(nation, ' ', '_') AS name FROM ladder")
def nexus_real_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the trees of a file, named by its TRANSLATE block."""
    leaves, _, _ = parse(read_beast_trees(spark, write_tree_files(spark, sf_dir)[0])[1], use_map=True)
    return leaves.select("tree_id", F.col("leaf_no").cast("int").alias("leaf_no"), "name")


@register("multi_file_trees", f"""WITH {TEXT}, f AS (
  SELECT (period + 1) % 2 AS file_idx, period, row_number() OVER (PARTITION BY period % 2 ORDER BY period) - 1 AS idx FROM newick
), k AS (SELECT * FROM f WHERE idx >= 1)
SELECT row_number() OVER (ORDER BY file_idx, idx) - 1 AS tree_id, file_idx::INTEGER AS file_idx, idx::INTEGER AS idx, 'file' || file_idx || '_run' || (1 - file_idx) || '_STATE_' || period AS name FROM k""")
def multi_file_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files, the second first, with a burn-in of one tree a file."""
    paths = write_tree_files(spark, sf_dir, files=2)
    return read_tree_files(spark, paths[::-1], burnin_trees=1).select("tree_id", F.col("file_idx").cast("int").alias("file_idx"), F.col("idx").cast("int").alias("idx"), "name")


@register("parse_failures", f"WITH {TEXT} SELECT row_number() OVER (ORDER BY period) - 1 AS tree_id, period - 1995 AS idx, newick FROM newick WHERE period % 3 <> 0")
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that do not parse are left out; the others keep their place in the file."""
    trees = read_tree_files(spark, write_tree_files(spark, sf_dir, broken=True))
    return trees.select("tree_id", F.col("idx").cast("long").alias("idx"), F.trim("newick").alias("newick"))


LINES = """SELECT year(o_orderdate)::INT AS file_idx, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 1 THEN concat('TREE STATE_', o_orderkey, ' = (a,b);') WHEN o_orderkey % 7 = 2 THEN concat('  tree x', o_orderkey, ' = (a = c);  ')
WHEN o_orderkey % 7 = 3 THEN 'tree without' WHEN o_orderkey % 7 = 4 THEN concat('odd prefix', ' = ', o_custkey) WHEN o_orderkey % 7 = 5 THEN concat('y=', o_custkey) WHEN o_custkey % 400 = 1 THEN ' eNd; ' ELSE '' END AS line FROM orders"""


@register("tree_block_lines", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY file_idx ORDER BY k) - 1 AS ln FROM ({LINES})),
a AS (SELECT *, min(ln) FILTER (upper(line) LIKE 'TREE %') OVER (PARTITION BY file_idx) AS b FROM l), c AS (SELECT * FROM a WHERE ln >= b),
e AS (SELECT *, min(ln) FILTER (upper(trim(line)) LIKE 'END;%') OVER (PARTITION BY file_idx) AS e FROM c)
SELECT file_idx, row_number() OVER (PARTITION BY file_idx ORDER BY ln) - 1 AS idx, trim(substr(line, 1, instr(line, ' = ') - 1)) AS header, trim(substr(line, instr(line, ' = ') + 3)) AS body
FROM e WHERE (e IS NULL OR ln < e) AND instr(line, ' = ') > 0""")
def tree_block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree lines of files made from the orders of a year: the block from the first unindented TREE to END, split once."""
    found = tree_lines(_lines(spark, sf_dir, LINES, "orders"))
    return found.select("file_idx", F.col("idx").cast("long").alias("idx"), "header", "body")


def _lines(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    table(spark, sf_dir, source).createOrReplaceTempView(f"cladeflow_{source}")
    rows = spark.sql(sql.replace(f"FROM {source}", f"FROM cladeflow_{source}"))
    return rows.selectExpr("file_idx", "concat('file', file_idx) AS path", "CAST(row_number() OVER (PARTITION BY file_idx ORDER BY k) - 1 AS INT) AS ln", "line")


LABELS = """SELECT CAST(c_nationkey % 3 AS INT) AS file_idx, c_custkey AS k, CASE WHEN c_custkey < 10 THEN 'before 1 x' WHEN c_custkey < 20 THEN ' tRANSLATE 9 lost,' WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 11 = 1 THEN 'lonely'
WHEN c_custkey > 130 THEN '  ; 7 z' WHEN c_custkey % 11 = 2 THEN concat(c_nationkey, '   ''', c_name, '''', ',,') ELSE concat(' ', c_nationkey, ' t', c_custkey, ' more,') END AS line FROM customer"""


@register("translate_scan", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY file_idx ORDER BY k) - 1 AS ln FROM ({LABELS})),
a AS (SELECT *, min(ln) FILTER (upper(trim(line)) LIKE 'TRANSLATE%') OVER (PARTITION BY file_idx) AS b FROM l), c AS (SELECT * FROM a WHERE ln > b),
e AS (SELECT *, min(ln) FILTER (trim(line) LIKE ';%') OVER (PARTITION BY file_idx) AS e FROM c),
w AS (SELECT file_idx, ln, regexp_split_to_array(rtrim(trim(line), ','), '\\s+') AS w FROM e WHERE e IS NULL OR ln < e)
SELECT file_idx, w[1] AS id, arg_max(trim(w[2], ''''), ln) AS label FROM w WHERE len(w) >= 2 AND w[1] <> '' GROUP BY file_idx, w[1]""")
def translate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translate entries of files made from the customers: first two words, quotes and commas off, the last entry for an id."""
    return translate_table(_lines(spark, sf_dir, LABELS, "customer"))


def _lists(spark: SparkSession, sf_dir: str) -> tuple[list[str], list[str], list[dict[str, str]], list[int]]:
    """Names, trees, two translate maps (nation names, and the same in lower case) and a map for each tree, by turns."""
    rows = ladders(spark, sf_dir).orderBy("tree_id").collect()
    nations = {str(r[0]): r[1] for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()}
    maps = [nations, {k: v.lower() for k, v in nations.items()}]
    return [r["name"] for r in rows], [r["newick"].replace(",", "[&r=1],") for r in rows], maps, [r["tree_id"] % 2 for r in rows]


MAPPED = f"WITH {TEXT} SELECT period - 1995 AS tree_id, 'orders_STATE_' || period AS tree, leaf_no::INTEGER AS leaf_no, CASE WHEN period % 2 = 1 THEN lower(nation) ELSE nation END AS name FROM ladder"


def _mapped_leaves(trees: DataFrame) -> DataFrame:
    leaves, _, _ = parse(trees, use_map=True)
    return leaves.join(trees.select("tree_id", F.col("name").alias("tree")), "tree_id").select("tree_id", "tree", F.col("leaf_no").cast("int").alias("leaf_no"), "name")


@register("newick_list_maps", MAPPED)
def newick_list_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of Newick strings, each with the translate map that its index picks."""
    return _mapped_leaves(newick_list(spark, *_lists(spark, sf_dir)))


@register("newick_iterator", f"WITH {TEXT} SELECT period - 1995 AS tree_id, 'orders_STATE_' || period AS name, newick FROM newick")
def newick_iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same drawn from an iterator, a few at a time, checked as they come."""
    names, newicks, maps, picks = _lists(spark, sf_dir)
    return newick_iter(spark, names, iter(newicks), maps[:1], [0] * len(picks), portion=4).select("tree_id", "name", "newick")


@register("missing_edges", f"""WITH {families.sql('R')} SELECT period AS tree_id, array_to_string(members, ',') AS split, CASE WHEN period % 2 = 1 THEN 0 ELSE length END AS length FROM clade""")
def missing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clades of trees of which every other has no branch lengths: these count as 0."""
    t = families.trees(spark, sf_dir).withColumn("newick", F.when(F.col("tree_id") % 2 == 1, F.regexp_replace("newick", r":[0-9]+", "")).otherwise(F.col("newick")))
    return to_splits(t, rooted=True).select("tree_id", text_of("split").alias("split"), "length")


PACKED = families.split_sql("R") + ", bits AS (SELECT period, s, list_sum(list_transform(string_split(s, ','), lambda r: 1::BIGINT << r::INTEGER))::BIGINT AS w, len(string_split(s, ',')) AS k FROM split)"


@register("packed_splits", f"WITH {PACKED} SELECT period AS tree_id, s AS split, upper(printf('%016x', w)) AS bits, k::BIGINT AS ones, row_number() OVER (PARTITION BY period ORDER BY w) AS place FROM bits")
def packed_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits as bits, their sizes counted from the bits, and their places in the order of the bits."""
    s = to_splits(families.trees(spark, sf_dir)).withColumn("b", packed(F.col("split"), F.col("n")))
    place = F.row_number().over(Window.partitionBy("tree_id").orderBy("b")).cast("long")
    return s.select("tree_id", text_of("split").alias("split"), F.hex("b").alias("bits"), count_ones(F.col("b")).cast("long").alias("ones"), place.alias("place"))


@register("split_unions", f"""WITH {families.sql('R')}, top AS (SELECT period, members FROM clade WHERE k = 1)
SELECT a.period AS tree_id, array_to_string(list_sort(list_distinct(flatten(list(b.members)))), ',') AS below, upper(printf('%016x', list_sum(list_transform(list_distinct(flatten(list(b.members))), lambda r: 1::BIGINT << r::INTEGER))::BIGINT)) AS bits
FROM top a JOIN top b ON a.period = b.period AND b.members <= a.members GROUP BY a.period, a.members""")
def split_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of the first, the first two, ... clades below the root, as ranks and as bits."""
    c = root_children(families.trees(spark, sf_dir))
    upto = F.transform(F.sequence(F.lit(1), F.size("children")), lambda k: F.slice("children", 1, k))
    c = c.select("tree_id", F.explode(upto).alias("some"))
    ranks = F.aggregate("some", F.array().cast("array<int>"), lambda a, x: set_union(a, x))
    n = F.lit(25)
    bits = F.aggregate("some", packed(F.array().cast("array<int>"), n), lambda a, x: packed_union(a, packed(x, n)))
    return c.select("tree_id", F.concat_ws(",", ranks.cast("array<string>")).alias("below"), F.hex(bits).alias("bits"))


@register("bitset_values", f"WITH {PACKED} SELECT period AS tree_id, s AS split, upper(printf('%016x', w)) AS bits, k::BIGINT AS ones, (SELECT upper(printf('%016x', bit_or(x.w))) FROM bits x WHERE x.period = bits.period) AS together FROM bits")
def bitset_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with Bitset objects, as a caller on the driver has them: set bits one by one, count, unite."""
    out = []
    for row in snapshots(families.trees(spark, sf_dir)).collect():
        sets, union = [], Bitset.for_leaves(row.n)
        for p in row.parts:
            b = Bitset.for_leaves(row.n)
            for r in p.split:
                b.set(r)
            union.or_assign(b)
            sets.append((",".join(map(str, p.split)), b))
        out += [(row.tree_id, s, b.to_bytes().hex().upper(), b.count_ones(), union.to_bytes().hex().upper()) for s, b in sets]
    return spark.createDataFrame(out, "tree_id long, split string, bits string, ones long, together string")


def _matrix(spark: SparkSession, names: list[str], matrix: list[list], kind: str) -> DataFrame:
    rows = [(a, b, x) for a, line in zip(names, matrix, strict=True) for b, x in zip(names, line, strict=True)]
    return spark.createDataFrame(rows, f"name_i string, name_j string, dist {kind}")


def _named(metric: str, name: str, where: str = "true") -> str:
    d = families.distance_sql("L", metric)
    return f"WITH d_ AS ({d}){NAMED.format(d='d_')} SELECT {name.format('i')} AS name_i, {name.format('j')} AS name_j, dist FROM full_ WHERE {where}"


def _entry_point(f, metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names, matrix = f([write_tree_files(spark, sf_dir)[0]], burnin_trees=2)
        out = _matrix(spark, names, matrix, "long" if metric == "rf" else "double")
        return out.withColumn("dist", F.round("dist", 6)) if metric == "kf" else out

    run.__doc__ = f"{f.__name__} on a tree file, as the lists that it returns."
    return run


for _name, _f, _metric in (("api_pairwise_rf", api.pairwise_rf, "rf"), ("api_pairwise_weighted_rf", api.pairwise_weighted_rf, "weighted"), ("api_pairwise_kf", api.pairwise_kf, "kf")):
    register(_name, _named(_metric, "'file0_run0_STATE_' || {}", "i >= 1997 AND j >= 1997"))(_entry_point(_f, _metric))


@register("api_rf_from_newicks", _named("rf", "'orders_STATE_' || {}"))
def api_rf_from_newicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairwise_rf_from_newicks on lists."""
    names, newicks, maps, picks = _lists(spark, sf_dir)
    return _matrix(spark, *api.pairwise_rf_from_newicks(names, newicks, maps[:1], [0] * len(picks)), "long")


@register("api_rf_from_newick_iter", _named("rf", "'orders_STATE_' || {}"))
def api_rf_from_newick_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairwise_rf_from_newick_iter: the bytes that it returns, read as 32-bit unsigned integers."""
    names, newicks, maps, picks = _lists(spark, sf_dir)
    names, raw = api.pairwise_rf_from_newick_iter(names, iter(newicks), maps[:1], [0] * len(picks))
    flat = memoryview(raw).cast("I").tolist()
    return _matrix(spark, names, [flat[i : i + len(names)] for i in range(0, len(flat), len(names))], "long")


@register("api_errors", """SELECT * FROM (VALUES
 ('no files', 'No trees found in any of the provided files'), ('all burnt', 'after burnin removal'), ('no such file', 'No trees found in file'),
 ('names', 'names length (1) must equal newicks length (2)'), ('indices', 'newicks length (2) must equal map_indices length (1)'), ('bounds', 'map_indices[1] = 1 is out of bounds'),
 ('parse', 'Failed to parse newick at index 1'), ('one tree', 'Need at least 2 trees'), ('no tree', 'No trees to compare'), ('more leaves', 'Tree 1 has 3 leaves'), ('other leaves', 'Tree 1 has a different leaf set'),
 ('iter indices', 'names length (2) must equal map_indices length (1)'), ('iter parse before more', 'Failed to parse newick at index 1'), ('iter leaves before more', 'Tree 1 has a different leaf set'), ('iter more', 'yielded more than 2'), ('iter less', 'yielded 1 trees but names has 2')
) t(fault, message)""")
def api_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the entry points say of wrong input, in the order in which they check it."""
    a, b, other, more = "((1,2),(3,4));", "((1,3),(2,4));", "((1,2),(3,5));", "(1,(2,3));"
    one = [{str(i): str(i) for i in range(9)}]
    lists = lambda names, newicks, picks=None: api.pairwise_rf_from_newicks(names, newicks, one, [0] * len(newicks) if picks is None else picks)
    drawn = lambda names, newicks, picks=None: api.pairwise_rf_from_newick_iter(names, iter(newicks), one, [0] * len(names) if picks is None else picks)
    cases = {
        "no files": (lambda: api.pairwise_rf([]), "No trees found in any of the provided files"),
        "all burnt": (lambda: api.pairwise_rf(write_tree_files(spark, sf_dir), burnin_trees=99), "after burnin removal"),
        "no such file": (lambda: api.pairwise_rf([f"{scratch(spark, 'none')}/x.trees"]), "No trees found in file"),
        "names": (lambda: lists(["x"], [a, b]), "names length (1) must equal newicks length (2)"),
        "indices": (lambda: lists(["x", "y"], [a, b], [0]), "newicks length (2) must equal map_indices length (1)"),
        "bounds": (lambda: lists(["x", "y"], [a, b], [0, 1]), "map_indices[1] = 1 is out of bounds"),
        "parse": (lambda: lists(["x", "y"], [a, "((1,2"]), "Failed to parse newick at index 1"),
        "one tree": (lambda: lists(["x"], [a]), "Need at least 2 trees"),
        "no tree": (lambda: lists([], []), "No trees to compare"),
        "more leaves": (lambda: lists(["x", "y"], [a, more]), "Tree 1 has 3 leaves"),
        "other leaves": (lambda: lists(["x", "y"], [a, other]), "Tree 1 has a different leaf set"),
        "iter indices": (lambda: drawn(["x", "y"], [a, b], [0]), "names length (2) must equal map_indices length (1)"),
        "iter parse before more": (lambda: drawn(["x", "y"], [a, "((1", b]), "Failed to parse newick at index 1"),
        "iter leaves before more": (lambda: drawn(["x", "y"], [a, other, b]), "Tree 1 has a different leaf set"),
        "iter more": (lambda: drawn(["x", "y"], [a, b, a]), "yielded more than 2"),
        "iter less": (lambda: drawn(["x", "y"], [a]), "yielded 1 trees but names has 2"),
    }

    def said(call) -> str:
        try:
            call()
        except ValueError as e:
            return str(e)
        return ""

    found = {fault: (said(call), want) for fault, (call, want) in cases.items()}
    return spark.createDataFrame([(fault, want if want in text else text) for fault, (text, want) in found.items()], "fault string, message string")


TSV = f"""WITH d_ AS ({families.distance_sql('L', 'rf')}){NAMED.format(d='d_')}
SELECT 0 AS place, chr(9) || string_agg(DISTINCT 'run0_STATE_' || i, chr(9) ORDER BY 'run0_STATE_' || i) AS line FROM full_
UNION ALL SELECT (i - 1994)::INTEGER, 'run0_STATE_' || i || chr(9) || string_agg(dist::VARCHAR, chr(9) ORDER BY j) FROM full_ GROUP BY i"""


def _tsv(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


@register("command_line_tsv", TSV)
def command_line_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line on a tree file: the lines of the table that it writes, and with .gz and - the same ones."""
    from cladeflow.__main__ import main

    path, texts = write_tree_files(spark, sf_dir)[0], []
    with tempfile.TemporaryDirectory() as folder:
        for name in ("d.tsv", "d.tsv.gz"):
            out = os.path.join(folder, name)
            main(["-i", path, "-o", out, "--use-real-taxa", "-q"])
            with (gzip.open if name.endswith(".gz") else open)(out, "rt", encoding="utf-8", newline="") as f:
                texts.append(f.read())
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        main(["-i", path, "-o", "-", "--use-real-taxa", "-q"])
    same = texts[0] == texts[1] == said.getvalue()
    return _tsv(spark, texts[0].removesuffix("\n").split("\n") if same else ["files differ"])


@register("write_matrix_tsv", f"""WITH d_ AS ({families.distance_sql('L', 'weighted')}){NAMED.format(d='d_')}
SELECT 0 AS place, chr(9) || string_agg(DISTINCT 't' || i, chr(9) ORDER BY 't' || i) AS line FROM full_
UNION ALL SELECT (i - 1994)::INTEGER, 't' || i || chr(9) || string_agg(regexp_replace(regexp_replace(printf('%.20f', dist / 1024.0), '0+$', ''), '\\.$', ''), chr(9) ORDER BY j) FROM full_ GROUP BY i""")
def matrix_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of small fractions written as a gzip table and read again: shortest digits, no exponents."""
    t = ladders(spark, sf_dir)
    ids = sorted(r[0] for r in t.select("tree_id").collect())
    at = {x: k for k, x in enumerate(ids)}
    m = [[0.0] * len(ids) for _ in ids]
    for r in pairwise(to_splits(t), t, "weighted").collect():
        m[at[r.i]][at[r.j]] = m[at[r.j]][at[r.i]] = r.dist / 1024
    with tempfile.TemporaryDirectory() as folder:
        out = os.path.join(folder, "m.tsv.gz")
        write_matrix_tsv(out, [f"t{x}" for x in ids], m)
        with gzip.open(out, "rt", encoding="utf-8", newline="") as f:
            return _tsv(spark, f.read().removesuffix("\n").split("\n"))


@register("number_format", "SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(printf('%.20f', CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey % 1000 / 1024.0 ELSE l_linenumber / 1048576.0 END), '0+$', ''), '\\.$', '') AS shown FROM lineitem")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as the sinks write them."""
    ship(spark)
    shown = F.udf(format_number, "string", useArrow=True)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey % 1000 / 1024D ELSE l_linenumber / 1048576D END").alias("x"))
    return lines.select("l_orderkey", "l_linenumber", shown("x").alias("shown"))


def _pair_sql(where: str) -> str:
    parts = [f"(SELECT dist FROM ({families.distance_sql('R', m)}) x WHERE x.i = p.i AND x.j = p.j) AS {m}" for m in ("rf", "weighted", "kf")]
    return f"SELECT i, j, {', '.join(parts)} FROM ({families.distance_sql('R', 'rf')}) p WHERE {where}"


@register("pair_functions", _pair_sql("i = 1995 AND j = 2001"))
def pair_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three distances of two Newick strings."""
    t = {r.tree_id: r.newick for r in families.trees(spark, sf_dir).where("tree_id in (1995, 2001)").collect()}
    a, b = t[1995], t[2001]
    row = (1995, 2001, cladeflow.robinson_foulds(a, b), cladeflow.weighted_robinson_foulds(a, b), round(cladeflow.kuhner_felsenstein(a, b), 6))
    return spark.createDataFrame([row], "i long, j long, rf long, weighted double, kf double")


@register("snapshot_functions", _pair_sql("true"))
def snapshot_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three distances of snapshots that a caller holds."""
    held = sorted((r.tree_id, TreeSnapshot.from_row(r)) for r in snapshots(families.trees(spark, sf_dir)).collect())
    rows = [(i, j, rf_from_snapshots(a, b), weighted_rf_from_snapshots(a, b), round(kf_from_snapshots(a, b), 6)) for i, a in held for j, b in held if i < j]
    return spark.createDataFrame(rows, "i long, j long, rf long, weighted double, kf double")


@register("snapshot_parts", f"WITH {families.split_sql('B')} SELECT period AS tree_id, row_number() OVER (PARTITION BY period ORDER BY list_transform(string_split(s, ','), lambda x: x::INTEGER)) - 1 AS place, s AS split, length FROM split")
def snapshot_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted parts of snapshots, with their places."""
    s = snapshots(families.trees(spark, sf_dir, "B")).select("tree_id", F.posexplode("parts").alias("place", "p"))
    return s.select("tree_id", F.col("place").cast("long").alias("place"), F.concat_ws(",", F.col("p.split").cast("array<string>")).alias("split"), "p.length")


@register("rename_leaf_nodes", f"WITH {families.sql('L')} SELECT period AS tree_id, leaf_no::INTEGER AS leaf_no, CASE WHEN key < 20 THEN nation END AS name FROM ladder")
def renamed_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves renamed by a join with a table of labels; null without one."""
    labels = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"))
    leaves, _, _ = parse(ladders(spark, sf_dir))
    return rename_leaf_nodes(leaves, labels).select("tree_id", F.col("leaf_no").cast("int").alias("leaf_no"), "name")


@register("rf_first_trees", f"SELECT * FROM ({families.distance_sql('R', 'rf', 'month')}) WHERE j < 199507")
def rf_first_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the first six monthly trees only, as measurements on a part take them."""
    t = first_trees(families.trees(spark, sf_dir, "R", "month"), 6)
    return pairwise(to_splits(t), t, "rf")


@register("exported_names", "SELECT * FROM (VALUES ('Bitset', true), ('TreeSnapshot', true), ('read_beast_trees', true), ('rename_leaf_nodes', true), ('strip_beast_annotations', true), ('write_matrix_tsv', true)) t(name, there)")
def exported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that callers import from the package itself, and whether they can be called."""
    names = ("Bitset", "TreeSnapshot", "read_beast_trees", "rename_leaf_nodes", "strip_beast_annotations", "write_matrix_tsv")
    return spark.createDataFrame([(n, callable(getattr(cladeflow, n, None))) for n in names], "name string, there boolean")
