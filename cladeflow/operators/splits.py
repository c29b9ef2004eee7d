"""Trees to sets of splits (unrooted) or clades (rooted), each with a branch length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions.sets import canonical_side
from cladeflow.operators.newick import clades


def to_splits(trees: DataFrame, rooted: bool = False, use_map: bool = False) -> DataFrame:
    """(tree_id, split, copy, length, n).

    Unrooted: the side without the first taxon of every split with two leaves or more on both sides; splits
    that two edges share (at a root with two children, along unary nodes) are one, their lengths added.
    Rooted: every clade with two leaves or more; repeated clades stay, numbered by `copy`. Edges to leaves
    and the root never count; a missing length is 0.
    """
    # Filters use the number of leaves, not the array: a filter on the array would compute it twice.
    c = clades(trees, use_map).where("level > 1 and k > 1")
    length = F.coalesce("length", F.lit(0.0)).alias("length")
    if rooted:
        copy = Window.partitionBy("tree_id", "clade").orderBy("length", "level")
        rows = c.select("tree_id", F.col("clade").alias("split"), length, "n", "clade", "level")
        return rows.withColumn("copy", F.row_number().over(copy)).select("tree_id", "split", "copy", "length", "n")
    s = c.where("k < n - 1").select("tree_id", canonical_side(F.col("clade"), F.col("n")).alias("split"), length, "n")
    return s.groupBy("tree_id", "split", "n").agg(F.sum("length").alias("length")).select("tree_id", "split", F.lit(1).alias("copy"), "length", "n")


def snapshots(trees: DataFrame, rooted: bool = False, use_map: bool = False) -> DataFrame:
    """One row per tree: parts as an array of (split, length), sorted by split, and the number of leaves."""
    s = to_splits(trees, rooted, use_map)
    parts = s.groupBy("tree_id").agg(F.sort_array(F.collect_list(F.struct("split", "length"))).alias("parts"))
    n = clades(trees, use_map).groupBy("tree_id").agg(F.max("n").alias("n"))
    empty = F.array().cast("array<struct<split:array<int>,length:double>>")
    return n.join(parts, "tree_id", "left").select("tree_id", F.coalesce("parts", empty).alias("parts"), "n", F.lit(rooted).alias("rooted"))


def root_children(trees: DataFrame, use_map: bool = False) -> DataFrame:
    """(tree_id, children): the sorted internal clades right below the root."""
    c = clades(trees, use_map).where("level = 2")
    return c.groupBy("tree_id").agg(F.sort_array(F.collect_list("clade")).alias("children"))


def first_trees(trees: DataFrame, k: int) -> DataFrame:
    """The k trees with the least tree_id: for measurements on a part of a large collection, not for results."""
    return trees.orderBy("tree_id").limit(k)


def rename_leaf_nodes(leaves: DataFrame, labels: DataFrame) -> DataFrame:
    """leaves (tree_id, leaf_no, name) with the names that labels (id, label) gives them, null where it has none."""
    new = labels.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    return leaves.join(new, F.col("name") == F.col("_id"), "left").withColumn("name", F.col("_label")).drop("_id", "_label")
