"""Entry points: distance matrices from tree files and from Newick text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.operators import check_leaf_sets, pairwise, parse, to_splits
from cladeflow.session import written
from cladeflow.sources import matrix_bytes, matrix_lists, newick_iter, newick_list, read_tree_files


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("cladeflow").getOrCreate()


def _whole(value: int, name: str) -> int:
    if value < 0:
        raise OverflowError(f"can't convert negative {name} to unsigned")
    return value


def load(paths: list[str], burnin_trees: int = 0, burnin_states: int = 0, use_real_taxa: bool = True, spark: SparkSession | None = None) -> DataFrame:
    """Trees of all files as a written table; ValueError for files without trees."""
    spark = spark or session()
    _whole(burnin_trees, "burnin_trees"), _whole(burnin_states, "burnin_states")
    if not paths:
        raise ValueError("No trees found in any of the provided files")
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            raise ValueError(f"No trees found in file '{p}' after burnin removal")
    trees = written(read_tree_files(spark, paths, burnin_trees, burnin_states, use_real_taxa), "trees")
    some = {r[0] for r in trees.select("file_idx").distinct().collect()}
    for i, p in enumerate(paths):
        if i not in some:
            raise ValueError(f"No trees found in file '{p}' after burnin removal")
    return trees


def compare(trees: DataFrame, metric: str, rooted: bool, use_map: bool, method: str = "block") -> DataFrame:
    """(i, j, dist) of checked trees."""
    check_leaf_sets(trees, use_map)
    splits = written(to_splits(trees, rooted, use_map), "splits")
    return pairwise(splits, trees, metric, method)


def names_of(trees: DataFrame) -> list[str]:
    return [r[0] for r in trees.select("name", "tree_id").orderBy("tree_id").collect()]


def _from_files(metric: str, paths: list[str], burnin_trees: int, burnin_states: int, use_real_taxa: bool, rooted: bool) -> tuple[list[str], list[list]]:
    trees = load(paths, burnin_trees, burnin_states, use_real_taxa)
    pairs = compare(trees, metric, rooted, use_real_taxa)
    names = names_of(trees)
    return names, matrix_lists(pairs, len(names), metric == "rf")


def pairwise_rf(paths: list[str], burnin_trees: int = 0, burnin_states: int = 0, use_real_taxa: bool = True, rooted: bool = False) -> tuple[list[str], list[list[int]]]:
    """Names and Robinson-Foulds matrix of all trees in the files."""
    return _from_files("rf", paths, burnin_trees, burnin_states, use_real_taxa, rooted)


def pairwise_weighted_rf(paths: list[str], burnin_trees: int = 0, burnin_states: int = 0, use_real_taxa: bool = True, rooted: bool = False) -> tuple[list[str], list[list[float]]]:
    """Names and weighted Robinson-Foulds matrix."""
    return _from_files("weighted", paths, burnin_trees, burnin_states, use_real_taxa, rooted)


def pairwise_kf(paths: list[str], burnin_trees: int = 0, burnin_states: int = 0, use_real_taxa: bool = True, rooted: bool = False) -> tuple[list[str], list[list[float]]]:
    """Names and Kuhner-Felsenstein matrix."""
    return _from_files("kf", paths, burnin_trees, burnin_states, use_real_taxa, rooted)


def _parsed(trees: DataFrame) -> DataFrame:
    trees = written(trees, "trees")
    bad = parse(trees)[2].where("not ok").agg(F.min("tree_id")).first()[0]
    if bad is not None:
        raise ValueError(f"Failed to parse newick at index {bad}")
    return trees


def _from_list(metric: str, names: list[str], newicks: list[str], translate_maps: list[dict[str, str]], map_indices: list[int], rooted: bool) -> tuple[list[str], list[list]]:
    if len(names) != len(newicks):
        raise ValueError(f"names length ({len(names)}) must equal newicks length ({len(newicks)})")
    pairs = compare(_parsed(newick_list(session(), names, newicks, translate_maps, map_indices)), metric, rooted, True)
    return list(names), matrix_lists(pairs, len(names), metric == "rf")


def pairwise_rf_from_newicks(names: list[str], newicks: list[str], translate_maps: list[dict[str, str]], map_indices: list[int], rooted: bool = False) -> tuple[list[str], list[list[int]]]:
    """Robinson-Foulds matrix of Newick strings, each read with one of the translate maps."""
    return _from_list("rf", names, newicks, translate_maps, map_indices, rooted)


def pairwise_weighted_rf_from_newicks(names: list[str], newicks: list[str], translate_maps: list[dict[str, str]], map_indices: list[int], rooted: bool = False) -> tuple[list[str], list[list[float]]]:
    return _from_list("weighted", names, newicks, translate_maps, map_indices, rooted)


def pairwise_kf_from_newicks(names: list[str], newicks: list[str], translate_maps: list[dict[str, str]], map_indices: list[int], rooted: bool = False) -> tuple[list[str], list[list[float]]]:
    return _from_list("kf", names, newicks, translate_maps, map_indices, rooted)


def pairwise_rf_from_newick_iter(names: list[str], newick_iterator: Iterable[str], translate_maps: list[dict[str, str]], map_indices: list[int], rooted: bool = False) -> tuple[list[str], bytes]:
    """As pairwise_rf_from_newicks, drawing trees one by one; the matrix as row-major 32-bit unsigned integers."""
    trees = written(newick_iter(session(), names, newick_iterator, translate_maps, map_indices), "trees")
    pairs = compare(trees, "rf", rooted, True)
    return list(names), matrix_bytes(pairs, len(names))


def _pair(metric: str, a: str, b: str) -> float:
    trees = session().createDataFrame([(0, a), (1, b)], "tree_id long, newick string")
    return pairwise(to_splits(trees), trees, metric, "block").first()["dist"]


def robinson_foulds(a: str, b: str) -> int:
    """Unrooted distance of two Newick strings."""
    return _pair("rf", a, b)


def weighted_robinson_foulds(a: str, b: str) -> float:
    return _pair("weighted", a, b)


def kuhner_felsenstein(a: str, b: str) -> float:
    return _pair("kf", a, b)
