"""Command line: trees of one file to a distance matrix as TSV."""

from __future__ import annotations

import argparse
import sys
import time

from cladeflow import api
from cladeflow.operators import pairwise, to_splits
from cladeflow.session import written
from cladeflow.sources import matrix_lists, read_beast_trees, write_matrix_tsv


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cladeflow", description=__doc__)
    p.add_argument("-i", "--input", required=True, help="NEXUS/BEAST tree file")
    p.add_argument("-o", "--output", required=True, help="TSV file; .gz compresses, - is standard output")
    p.add_argument("-t", "--burnin-trees", type=int, default=0, help="trees to skip at the start")
    p.add_argument("-s", "--burnin-states", type=int, default=0, help="keep only states greater than this")
    p.add_argument("--use-real-taxa", action="store_true", help="names of the TRANSLATE block for the leaves")
    p.add_argument("--metric", choices=("rf", "weighted", "kf"), default="rf")
    p.add_argument("--rooted", action="store_true", help="compare clades instead of splits")
    p.add_argument("-q", "--quiet", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    """0, or 2 without trees, 3 where trees cannot be compared, 4 where the output cannot be written."""
    args = arguments(argv)
    began = time.time()
    say = (lambda *x: None) if args.quiet else (lambda *x: print(f"[{time.time() - began:.1f} s]", *x, file=sys.stderr if args.output == "-" else sys.stdout))
    spark = api.session()
    table, trees = read_beast_trees(spark, args.input, args.burnin_trees, args.burnin_states, args.use_real_taxa)
    trees = written(trees, "trees")
    names = api.names_of(trees)
    if not names:
        print("No trees found", file=sys.stderr)
        return 2
    say(f"{len(names)} trees, {table.count()} taxa, {len(names) * (len(names) - 1) // 2} pairs")
    try:
        if len(names) > 1:
            api.check_leaf_sets(trees, args.use_real_taxa)
        splits = written(to_splits(trees, args.rooted, args.use_real_taxa), "splits")
        matrix = matrix_lists(pairwise(splits, trees, args.metric, "block"), len(names), args.metric == "rf")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 3
    try:
        write_matrix_tsv(args.output, names, matrix)
    except OSError as e:
        print(e, file=sys.stderr)
        return 4
    say(f"wrote {args.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
