"""NEXUS/BEAST tree files as DataFrames.

Files are read whole (line order counts), one row a file, and split to numbered lines; everything else is
filters, windows and expressions on those lines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeflow.functions.text import base_name, burn_in, name_state, strip_annotations, tree_name
from cladeflow.operators.newick import parse


def file_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_idx, path, ln, line) of all files, in the order given; one scan reads them all, however many.

    The list of paths is a small table that meets the files by their full names; a path given twice counts twice.
    """
    if not paths:
        return spark.createDataFrame([], "file_idx int, path string, ln int, line string")
    order = spark.createDataFrame([(i, p, _full_name(spark, p)) for i, p in enumerate(paths)], "file_idx int, path string, key string")
    key = F.regexp_replace("_metadata.file_path", "^([^:/]+):/+", "$1:/")
    whole = spark.read.text(sorted(set(paths)), wholetext=True).select(key.alias("key"), "value")
    return whole.join(F.broadcast(order), "key").select("file_idx", "path", F.posexplode(F.split("value", "\r?\n", -1)).alias("ln", "line"))


def _full_name(spark: SparkSession, path: str) -> str:
    """The name by which Spark knows a file, with one slash after the scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()
    return re.sub("^([^:/]+):/+", r"\1:/", full)


def tree_lines(lines: DataFrame) -> DataFrame:
    """(file_idx, path, idx, header, body) of the tree lines.

    The block begins at the first line that starts with "TREE " in any case (not indented) and ends before
    the next line that starts with "END;" once trimmed; inside it every line with " = " is a tree, split there once.
    """
    upper = F.upper("line")
    f = Window.partitionBy("file_idx")
    a = lines.withColumn("begin", F.min(F.when(upper.startswith("TREE "), F.col("ln"))).over(f)).where(F.col("ln") >= F.col("begin"))
    a = a.withColumn("end", F.min(F.when(F.upper(F.trim("line")).startswith("END;"), F.col("ln"))).over(f))
    a = a.where((F.col("end").isNull() | (F.col("ln") < F.col("end"))) & F.contains("line", F.lit(" = ")))
    parts = F.split("line", " = ", 2)
    idx = F.row_number().over(Window.partitionBy("file_idx").orderBy("ln")) - 1
    return a.select("file_idx", "path", idx.alias("idx"), F.trim(parts[0]).alias("header"), F.trim(parts[1]).alias("body"))


def translate_table(lines: DataFrame) -> DataFrame:
    """(file_idx, id, label) of the TRANSLATE block: lines after the one that begins it up to one that begins
    with ";"; trailing commas off, the first two words count, quotes around the label off, the last entry for an id wins."""
    trimmed = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    f = Window.partitionBy("file_idx")
    a = lines.withColumn("line", trimmed).withColumn("begin", F.min(F.when(F.upper("line").startswith("TRANSLATE"), F.col("ln"))).over(f)).where(F.col("ln") > F.col("begin"))
    a = a.withColumn("end", F.min(F.when(F.col("line").startswith(";"), F.col("ln"))).over(f)).where(F.col("end").isNull() | (F.col("ln") < F.col("end")))
    words = F.split(F.regexp_replace("line", ",+$", ""), r"\s+")
    a = a.select("file_idx", "ln", words.alias("w")).where((F.size("w") >= 2) & (F.col("w")[0] != ""))
    a = a.select("file_idx", "ln", F.col("w")[0].alias("id"), F.regexp_replace(F.col("w")[1], "^'+|'+$", "").alias("label"))
    return a.groupBy("file_idx", "id").agg(F.max_by("label", "ln").alias("label"))


def translate_maps(lines: DataFrame) -> DataFrame:
    """(file_idx, map)."""
    return translate_table(lines).groupBy("file_idx").agg(F.map_from_entries(F.collect_list(F.struct("id", "label"))).alias("map"))


def read_tree_files(spark: SparkSession, paths: list[str], burnin_trees: int = 0, burnin_states: int = 0, use_real_taxa: bool = True, number_files: bool = True) -> DataFrame:
    """(tree_id, file_idx, idx, name, state, newick, map): trees past the burn-in that parse, in file order.

    `map` is null unless use_real_taxa; tree_id counts from 0 over all files.
    """
    lines = file_lines(spark, paths)
    trees = tree_lines(lines).withColumn("ns", name_state(F.col("header")))
    kept = trees.where(burn_in(F.col("idx"), F.col("ns.state"), burnin_trees, burnin_states))
    name = tree_name(base_name(F.col("path")), F.col("ns.name"), F.col("file_idx") if number_files else None)
    kept = kept.select("file_idx", "idx", name.alias("name"), F.col("ns.state").alias("state"), strip_annotations(F.col("body")).alias("newick"))
    kept = kept.withColumn("tree_id", F.col("file_idx").cast("long") * (1 << 40) + F.col("idx"))
    _, _, status = parse(kept.select("tree_id", "newick"))
    good = kept.join(status.where("ok").select("tree_id"), "tree_id", "left_semi")
    if use_real_taxa:
        # No TRANSLATE block is an empty map: every label is then unknown.
        empty = F.create_map().cast("map<string,string>")
        good = good.join(translate_maps(lines), "file_idx", "left").withColumn("map", F.coalesce("map", empty))
    else:
        good = good.withColumn("map", F.lit(None).cast("map<string,string>"))
    return _numbered(good).select("tree_id", "file_idx", "idx", "name", "state", "newick", "map")


def _numbered(trees: DataFrame) -> DataFrame:
    """tree_id 0, 1, ... in order of file and line: places within a file, plus the sizes of the files before it."""
    own = F.row_number().over(Window.partitionBy("file_idx").orderBy("idx")) - 1
    sizes = trees.groupBy("file_idx").count()
    before = sizes.select("file_idx", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("file_idx")) - F.col("count")).alias("before"))
    return trees.withColumn("own", own).join(before, "file_idx").withColumn("tree_id", (F.col("own") + F.col("before")).cast("long")).drop("own", "before")


def read_beast_trees(spark: SparkSession, path: str, burnin_trees: int = 0, burnin_states: int = 0, use_real_taxa: bool = True) -> tuple[DataFrame, DataFrame]:
    """(translate table, trees) of one file; empty where the file cannot be read."""
    try:
        lines = file_lines(spark, [path])
        lines.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "FileNotFound" not in str(e):
            raise
        lines = None
    if lines is None:
        return spark.createDataFrame([], "file_idx int, id string, label string"), spark.createDataFrame([], "tree_id long, file_idx int, idx int, name string, state decimal(20,0), newick string, map map<string,string>")
    return translate_table(lines), read_tree_files(spark, [path], burnin_trees, burnin_states, use_real_taxa, number_files=False)
