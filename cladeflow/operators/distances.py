"""Robinson-Foulds, weighted Robinson-Foulds and Kuhner-Felsenstein distances of all pairs of trees.

Two plans, same results. "block", the default: trees are packed to arrays, cut into blocks of bounded size, and each
pair of blocks is compared in one task with array kernels; the shuffle is trees times blocks, and no task holds more
than two blocks. "join": an equi-join of the splits with themselves finds what two trees share, and the totals of
each tree give the rest, so pairs that share nothing cost nothing in the join; Catalyst plans it all. A split
that all trees have meets itself once for each pair of blocks of trees, so that no task joins more than one block with
another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.session import ship

METRICS = ("rf", "weighted", "kf")
BLOCK = 512
#: Cells of the matrices that a task lays out at once (two of them, 8 bytes each).
CELLS = 4 << 20
RESULT = "i long, j long, dist double"


def pairwise(splits: DataFrame, trees: DataFrame, metric: str = "rf", method: str = "block", block: int = BLOCK) -> DataFrame:
    """(i, j, dist) for i < j over the tree_ids of `trees`; dist is a long for rf, else a double.

    rf: splits that only one of the two has (copies counted). weighted: sum of |a - b| over shared splits plus
    the lengths of the others as they are. kf: root of the sum of (a - b)^2, an absent split counting 0.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    out = _by_blocks(splits, trees, metric, block) if method == "block" else _by_join(splits, trees, metric)
    return out.withColumn("dist", F.col("dist").cast("long")) if metric == "rf" else out


def in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """rows once for each block that theirs meets: `blk` of tree_id, and the pair of blocks lo <= hi."""
    own = F.pmod(F.xxhash64("tree_id"), F.lit(blocks)).cast("int")
    out = rows.withColumns({"blk": own, "other": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    return out.withColumns({"lo": F.least("blk", "other"), "hi": F.greatest("blk", "other")}).drop("other")


def pair_scaffold(ids: DataFrame, block: int = 1024) -> DataFrame:
    """(i, j) of all i < j, by an equi-join of blocks of ids: no cross join and no broadcast of all ids."""
    a = in_blocks(ids.select("tree_id"), max(1, -(-ids.count() // block)))
    left = a.where("blk = lo").select("lo", "hi", F.col("tree_id").alias("u"))
    right = a.where("blk = hi").select("lo", "hi", F.col("tree_id").alias("v"))
    both = left.join(right, ["lo", "hi"]).where("u <> v and (lo <> hi or u < v)")
    return both.select(F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"))


def _by_join(splits: DataFrame, trees: DataFrame, metric: str, block: int = 1024) -> DataFrame:
    ids = trees.select("tree_id")
    x = F.col("length")
    own = {"rf": F.lit(1.0), "weighted": x, "kf": x * x}[metric]
    totals = ids.join(splits.groupBy("tree_id").agg(F.sum(own).alias("total"), F.count(F.lit(1)).alias("n")), "tree_id", "left")
    totals = totals.select("tree_id", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))
    cut = in_blocks(splits.select("tree_id", "split", "copy", "length"), max(1, -(-ids.count() // block)))
    a = cut.where("blk = lo").select("split", "copy", "lo", "hi", F.col("tree_id").alias("u"), F.col("length").alias("lu"))
    b = cut.where("blk = hi").select("split", "copy", "lo", "hi", F.col("tree_id").alias("v"), F.col("length").alias("lv"))
    lu, lv = F.col("lu"), F.col("lv")
    # What a shared split counts, and what of either total it stands for.
    both = {"rf": F.lit(0.0), "weighted": F.abs(lu - lv), "kf": (lu - lv) * (lu - lv)}[metric]
    of = lambda c: {"rf": F.lit(1.0), "weighted": c, "kf": c * c}[metric]
    shared = a.join(b, ["split", "copy", "lo", "hi"]).where("u <> v and (lo <> hi or u < v)")
    first = F.col("u") < F.col("v")
    shared = shared.select(F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"), both.alias("both"), F.when(first, of(lu)).otherwise(of(lv)).alias("si"), F.when(first, of(lv)).otherwise(of(lu)).alias("sj"))
    shared = shared.groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("si").alias("si"), F.sum("sj").alias("sj"), F.count(F.lit(1)).alias("k"))
    pairs = pair_scaffold(ids)
    for c in ("i", "j"):
        pairs = pairs.join(totals.select(F.col("tree_id").alias(c), F.col("total").alias(f"t{c}"), F.col("n").alias(f"n{c}")), c)
    # Where all splits of a tree are shared, nothing is left of its total, whatever the rounding of the sums.
    left = lambda c: F.when(F.col("k") == F.col(f"n{c}"), 0.0).otherwise(F.col(f"t{c}") - F.coalesce(f"s{c}", F.lit(0.0)))
    rest = lambda c: F.greatest(left(c), F.lit(0.0)) if metric == "kf" else left(c)
    dist = F.coalesce("both", F.lit(0.0)) + rest("i") + rest("j")
    return pairs.join(shared, ["i", "j"], "left").select("i", "j", (F.sqrt(dist) if metric == "kf" else dist).alias("dist"))


def _by_blocks(splits: DataFrame, trees: DataFrame, metric: str, block: int) -> DataFrame:
    spark = trees.sparkSession
    ship(spark)
    # Two 64-bit hashes of a split stand for it; those of one block pair become columns of a dense matrix.
    k1, k2 = F.xxhash64("split", "copy"), F.xxhash64(F.lit("second"), "copy", "split")
    packed = splits.groupBy("tree_id").agg(F.collect_list(F.struct(k1.alias("k1"), k2.alias("k2"), "length")).alias("p"))
    rows = trees.select("tree_id").join(packed, "tree_id", "left").select("tree_id", "p.k1", "p.k2", F.col("p.length").alias("l"))
    dealt = in_blocks(rows, max(1, -(-trees.count() // block)))

    def compare(t: pa.Table) -> pa.Table:
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        ids, blk = t.column("tree_id").to_numpy(), t.column("blk").to_numpy()
        first, second, owner, lengths = _flat(t)
        a, b = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        d = _block_distances(len(ids), _numbered(first, second), owner, lengths, a, b, metric)
        r, c = np.nonzero(ids[a][:, None] < ids[b][None, :] if lo == hi else np.ones((len(a), len(b)), bool))
        u, v = ids[a][r], ids[b][c]
        return pa.table({"i": pa.array(np.minimum(u, v), pa.int64()), "j": pa.array(np.maximum(u, v), pa.int64()), "dist": pa.array(d[r, c], pa.float64())})

    return dealt.groupBy("lo", "hi").applyInArrow(compare, RESULT)


def _block_distances(n: int, col: np.ndarray, owner: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances between the trees a and b of n trees, given as (split number, tree, length) triples.

    A split that one tree alone has adds the same to each of its distances; only the others are laid out, tree
    by split, in pieces of at most CELLS.
    """
    per = {"rf": np.ones(len(col)), "weighted": lengths, "kf": lengths * lengths}[metric]
    often = np.bincount(col)
    alone = often[col] == 1 if len(col) else np.zeros(0, bool)
    own = np.bincount(owner[alone], per[alone], n).astype(float)  # whole numbers where nothing is counted
    d = own[a][:, None] + own[b][None, :]
    shared = np.flatnonzero(often > 1)
    place = np.full(len(often), -1)
    place[shared] = np.arange(len(shared))
    at, who, x = place[col[~alone]], owner[~alone], lengths[~alone]
    order = np.argsort(at, kind="stable")
    at, who, x = at[order], who[order], x[order]
    step, signed = max(1, CELLS // max(1, n)), bool((lengths < 0).any())
    for lo in range(0, len(shared), step):
        i, j = np.searchsorted(at, (lo, lo + step))
        width = min(step, len(shared) - lo)
        col, own, value = at[i:j] - lo, who[i:j], x[i:j]
        has = np.zeros((n, width), np.float32 if metric == "rf" else float)
        has[own, col] = 1.0
        if metric == "rf":
            count = has.sum(axis=1)
            d += count[a][:, None] + count[b][None, :] - 2 * (has[a] @ has[b].T)
            continue
        cells = np.zeros((n, width))
        cells[own, col] = value
        # What the second tree has and the first lacks: sums of its own lengths, without any difference.
        d += (1 - has[a]) @ (cells[b] * cells[b] if metric == "kf" else cells[b]).T
        columns = np.ascontiguousarray(cells[b].T)  # a row a split: those of the first tree are taken out whole
        marks = np.ascontiguousarray(has[b].T) if signed and metric == "weighted" else None
        for r, row in enumerate(a):
            mine = np.flatnonzero(has[row])
            value = cells[row, mine][:, None]
            diff = columns[mine]
            diff -= value
            if metric == "kf":
                diff *= diff
            else:
                np.abs(diff, out=diff)
                if marks is not None:  # a length that the other tree lacks counts as it is, not as its amount
                    diff = np.where(marks[mine] > 0, diff, value)
            d[r] += diff.sum(axis=0)
    return np.sqrt(d) if metric == "kf" else d


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of all splits of a table of trees, the row each belongs to, and their lengths."""
    lists = [t.column(c).combine_chunks() for c in ("k1", "k2", "l")]
    counts = pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False)
    first, second, lengths = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    return first, second, np.repeat(np.arange(len(counts)), counts), lengths


def _numbered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Equal pairs of hashes get equal numbers, from 0 without gaps."""
    order = np.argsort(first, kind="stable")
    same = first[order][1:] == first[order][:-1]
    if (same & (second[order][1:] != second[order][:-1])).any():
        order = np.lexsort((second, first))
        same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    out = np.empty(len(first), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ~same])) if len(first) else 0
    return out


def full_matrix(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """(i, j, dist) in both directions, with a zero for each tree and itself."""
    kind = dict(pairs.dtypes)["dist"]
    back = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist")
    diagonal = trees.select(F.col("tree_id").alias("i"), F.col("tree_id").alias("j"), F.lit(0).cast(kind).alias("dist"))
    return pairs.select("i", "j", "dist").union(back).union(diagonal)
