"""Where trees come from and where distances go."""

from cladeflow.sources.newick_lists import newick_iter, newick_list
from cladeflow.sources.nexus import read_beast_trees, read_tree_files, tree_lines, translate_table
from cladeflow.sources.sinks import format_number, matrix_bytes, matrix_lists, write_matrix_tsv, write_pairs

__all__ = ["format_number", "matrix_bytes", "matrix_lists", "newick_iter", "newick_list", "read_beast_trees", "read_tree_files", "translate_table", "tree_lines", "write_matrix_tsv", "write_pairs"]
