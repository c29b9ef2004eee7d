"""Relational operators of the tree engine."""

from cladeflow.operators.checks import check_leaf_sets, first_fault
from cladeflow.operators.distances import METRICS, full_matrix, pairwise
from cladeflow.operators.newick import clades, parse, tokens
from cladeflow.operators.splits import first_trees, root_children, snapshots, to_splits

__all__ = ["METRICS", "check_leaf_sets", "clades", "first_fault", "first_trees", "full_matrix", "pairwise", "parse", "root_children", "snapshots", "to_splits", "tokens"]
