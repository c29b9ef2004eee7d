"""Trees given as strings: lists, and iterators that are drawn a portion at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.text import strip_annotations
from cladeflow.operators.checks import difference, first_fault, leaf_sets
from cladeflow.session import scratch

SCHEMA = "tree_id long, name string, newick string, map_idx int"


def map_table(spark: SparkSession, translate_maps: list[dict[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, m) for i, m in enumerate(translate_maps)], "map_idx int, map map<string,string>")


def check_indices(map_indices: list[int], n_maps: int) -> None:
    for i, k in enumerate(map_indices):
        if not 0 <= k < n_maps:
            raise ValueError(f"map_indices[{i}] = {k} is out of bounds for {n_maps} translate maps")


def with_maps(trees: DataFrame, translate_maps: list[dict[str, str]]) -> DataFrame:
    maps = map_table(trees.sparkSession, translate_maps)
    out = trees.join(maps, "map_idx").withColumn("newick", strip_annotations(F.col("newick")))
    return out.select("tree_id", "name", "newick", "map_idx", "map")


def newick_list(spark: SparkSession, names: list[str], newicks: list[str], translate_maps: list[dict[str, str]], map_indices: list[int]) -> DataFrame:
    """(tree_id, name, newick, map_idx, map)."""
    if len(newicks) != len(map_indices):
        raise ValueError(f"newicks length ({len(newicks)}) must equal map_indices length ({len(map_indices)})")
    check_indices(map_indices, len(translate_maps))
    rows = list(zip(range(len(names)), names, newicks, map_indices, strict=True))
    return with_maps(spark.createDataFrame(rows, SCHEMA), translate_maps)


def newick_iter(spark: SparkSession, names: list[str], newicks: Iterable[str], translate_maps: list[dict[str, str]], map_indices: list[int], portion: int = 1000) -> DataFrame:
    """newick_list from an iterator: `portion` trees at a time are checked and appended to a table in the shared folder.

    Faults come up in the order of the trees: what is wrong with a tree (its text, then its leaf set) before that
    there are more trees than names, and that before there are fewer.
    """
    if len(names) != len(map_indices):
        raise ValueError(f"names length ({len(names)}) must equal map_indices length ({len(map_indices)})")
    check_indices(map_indices, len(translate_maps))
    path, done, want = scratch(spark, "newicks"), 0, None
    for rows in _portions(iter(newicks), names, map_indices, portion):
        trees = with_maps(spark.createDataFrame(rows, SCHEMA), translate_maps)
        if want is None:
            first = trees.where(F.col("tree_id") == 0)
            if first_fault(first, True):
                raise ValueError("Failed to parse newick at index 0")
            want = leaf_sets(first, True).first()["names"]
        if fault := first_fault(trees, True, want):
            i, parses, found = fault
            raise difference(i, found, want) if parses else ValueError(f"Failed to parse newick at index {i}")
        trees.select("tree_id", "name", "newick", "map_idx").write.mode("append").parquet(path)
        done += len(rows)
    if done < len(names):
        raise ValueError(f"newick_iter yielded {done} trees but names has {len(names)}")
    trees = spark.read.schema(SCHEMA).parquet(path) if done else spark.createDataFrame([], SCHEMA)
    return with_maps(trees, translate_maps)


def _portions(it: Iterator[str], names: list[str], map_indices: list[int], portion: int) -> Iterator[list[tuple]]:
    rows: list[tuple] = []
    for i, newick in enumerate(it):
        if i >= len(names):
            if rows:
                yield rows
            raise ValueError(f"newick_iter yielded more than {len(names)} trees")
        rows.append((i, names[i], newick, map_indices[i]))
        if len(rows) == portion:
            yield rows
            rows = []
    if rows:
        yield rows
