"""Column functions for tree text and leaf sets."""

from cladeflow.functions.sets import canonical_side, complement, count_ones, packed, packed_union, set_union
from cladeflow.functions.text import base_name, burn_in, name_state, strip_annotations, strip_beast_annotations, tree_name

__all__ = ["base_name", "burn_in", "canonical_side", "complement", "count_ones", "name_state", "packed", "packed_union", "set_union", "strip_annotations", "strip_beast_annotations", "tree_name"]
