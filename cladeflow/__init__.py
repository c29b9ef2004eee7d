"""cladeflow: tree-distance analytics and corpus preparation on PySpark."""

from cladeflow.api import (
    kuhner_felsenstein,
    pairwise_kf,
    pairwise_kf_from_newicks,
    pairwise_rf,
    pairwise_rf_from_newick_iter,
    pairwise_rf_from_newicks,
    pairwise_weighted_rf,
    pairwise_weighted_rf_from_newicks,
    robinson_foulds,
    weighted_robinson_foulds,
)
from cladeflow.functions.sets import Bitset
from cladeflow.functions.text import strip_beast_annotations
from cladeflow.operators.tree_values import TreeSnapshot, kf_from_snapshots, rf_from_snapshots, weighted_rf_from_snapshots
from cladeflow.operators.splits import rename_leaf_nodes
from cladeflow.sources import read_beast_trees, write_matrix_tsv

__version__ = "0.1.0"

__all__ = [
    "Bitset", "TreeSnapshot", "kf_from_snapshots", "kuhner_felsenstein", "pairwise_kf", "pairwise_kf_from_newicks", "pairwise_rf",
    "pairwise_rf_from_newick_iter", "pairwise_rf_from_newicks", "pairwise_weighted_rf", "pairwise_weighted_rf_from_newicks", "read_beast_trees",
    "rename_leaf_nodes", "rf_from_snapshots", "robinson_foulds", "strip_beast_annotations", "weighted_rf_from_snapshots", "weighted_robinson_foulds", "write_matrix_tsv",
]
