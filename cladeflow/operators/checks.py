"""Checks ahead of a comparison, with the messages that callers rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators.newick import parse


def leaf_sets(trees: DataFrame, use_map: bool = False) -> DataFrame:
    """(tree_id, names): the sorted distinct names that are not null."""
    leaves, _, _ = parse(trees, use_map)
    return leaves.groupBy("tree_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def first_fault(trees: DataFrame, use_map: bool = False, want: list[str] | None = None) -> tuple[int, bool, list[str]] | None:
    """(tree_id, whether it parses, its leaf names) of the first tree that does not parse or whose leaf set is not `want`; None without such."""
    leaves, _, status = parse(trees, use_map)
    sets = leaves.groupBy("tree_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = status.join(sets, "tree_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    if want is not None:
        rows = differing(rows, want)
    found = rows.where("not ok or differs" if want is not None else "not ok").orderBy("tree_id").first()
    return (found["tree_id"], found["ok"], found["names"]) if found else None


def differing(sets: DataFrame, want: list[str]) -> DataFrame:
    """sets (tree_id, names, ...) with `differs`; the wanted names are one row that Spark sends to the others."""
    one = sets.sparkSession.createDataFrame([(0, want)], "_one int, _want array<string>")
    both = sets.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one")
    return both.withColumn("differs", ~F.col("names").eqNullSafe(F.col("_want"))).drop("_one", "_want")


def difference(tree: int, names: list[str], want: list[str]) -> ValueError:
    if len(names) != len(want):
        return ValueError(f"Tree {tree} has {len(names)} leaves, but the first tree has {len(want)} leaves")
    return ValueError(f"Tree {tree} has a different leaf set than the first tree")


def check_leaf_sets(trees: DataFrame, use_map: bool = False) -> None:
    """ValueError unless there are two trees or more and all have the leaf set of the first.

    The first tree's names (one tree) and the first tree that differs come to the driver, no more.
    """
    total = trees.count()
    if total == 0:
        raise ValueError("No trees to compare")
    if total == 1:
        raise ValueError("Need at least 2 trees to compute distances")
    sets = leaf_sets(trees, use_map)
    first = trees.agg(F.min("tree_id")).first()[0]
    base = sets.where(F.col("tree_id") == first).select("names").first()
    want = base[0] if base else []
    other = differing(sets, want).where("differs").orderBy("tree_id").first()
    if other:
        raise difference(other["tree_id"], other["names"], want)
