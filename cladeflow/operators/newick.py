"""Newick text to leaves and clades, with built-in expressions only.

A tree is a row (tree_id, newick, and optionally map, a map from leaf label to taxon). Its text is cut into
tokens; windows over a tree's tokens give depth, neighbours and the number of leaves so far. Leaves below a
node stand next to each other, so a clade is a range of leaf numbers: no recursion and no join with itself.
Everything after the one shuffle by tree_id stays in the partition of the tree.

Grammar: nested lists of nodes; labels unquoted or in single quotes ('' is a quote), lengths after ":",
comments in brackets ignored, blanks outside quotes ignored, ";" at the end. A leaf without a name is
named "". A tree that breaks these rules has ok = false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUOTED = r"'(?:[^']|'')*'"
TOKEN = rf"({QUOTED}|[(),;]|:[^(),;']*|[^(),:;']+|')"


def clean(newick: Column) -> Column:
    """Without comments and blanks outside quotes."""
    return F.regexp_replace(newick, rf"({QUOTED})|\[[^\]]*\]|\s+", "$1")


def tokens(trees: DataFrame) -> DataFrame:
    """(tree_id, pos, tok) and for each token the depth, its neighbours and the number of leaves up to it."""
    t = trees.select("tree_id", F.posexplode(F.regexp_extract_all(clean(F.col("newick")), F.lit(TOKEN), F.lit(1))).alias("pos", "tok"))
    w = Window.partitionBy("tree_id").orderBy("pos")
    t = t.withColumns({"prev": F.lag("tok").over(w), "next": F.lead("tok").over(w), "next2": F.lead("tok", 2).over(w)})
    is_label = ~F.substring("tok", 1, 1).isin("(", ")", ",", ";", ":")
    opens = F.col("prev").isNull() | F.col("prev").isin("(", ",")
    # A list item with no label is a leaf too: what follows "(" or "," ends it at once.
    nameless = F.col("prev").isin("(", ",") & (F.col("tok").isin(",", ")", ";") | F.col("tok").startswith(":"))
    named = is_label & opens
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)
    return t.withColumns({"is_label": is_label, "is_leaf": named | nameless, "named": named, "depth": F.sum(step).over(upto), "leaf_no": F.sum((named | nameless).cast("int")).over(upto)})


def _label(tok: Column) -> Column:
    return F.when(tok.startswith("'"), F.replace(F.substring(tok, F.lit(2), F.length(tok) - 2), F.lit("''"), F.lit("'"))).otherwise(tok)


def _length(tok: Column) -> Column:
    return F.substring(tok, F.lit(2), F.length(tok)).try_cast("double")


def parse(trees: DataFrame, use_map: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, clades, status).

    leaves: tree_id, leaf_no (from 1), name (null where a map lacks the label), rank (from 0; by name, then order).
    clades: tree_id, level (root 1), lo, hi (leaf numbers lo + 1 .. hi), length (null where there is none).
    status: tree_id, ok.
    """
    t = tokens(trees)
    c1 = F.substring("tok", 1, 1)
    wrong = (
        (F.col("depth") < 0)
        | (F.col("tok") == "'")
        | ((c1 == ":") & (_length(F.col("tok")).isNull() | F.col("prev").startswith(":")))
        | (F.col("is_label") & ~F.col("named") & (F.col("prev") != ")"))
        | ((F.col("tok") == "(") & F.col("prev").isNotNull() & ~F.col("prev").isin("(", ","))
        | ((F.col("tok") == ";") & (F.col("next").isNotNull() | (F.col("depth") != 0) | F.col("prev").isNull()))
        | ((F.col("tok") == ",") & (F.col("depth") < 1))
        | (F.col("next").isNull() & (F.col("tok") != ";"))
    )
    seen = t.groupBy("tree_id").agg(F.max(F.coalesce(wrong, F.lit(False))).alias("wrong"))
    status = trees.select("tree_id").join(seen, "tree_id", "left").select("tree_id", (~F.coalesce("wrong", F.lit(True))).alias("ok"))
    name = F.when(F.col("named"), _label(F.col("tok"))).otherwise(F.lit(""))
    leaves = t.where("is_leaf").select("tree_id", "leaf_no", name.alias("name"))
    if use_map:
        leaves = leaves.join(trees.select("tree_id", "map"), "tree_id").select("tree_id", "leaf_no", F.try_element_at("map", F.col("name")).alias("name"))
    by_name = Window.partitionBy("tree_id").orderBy(F.coalesce("name", F.lit("")), "leaf_no")
    leaves = leaves.withColumn("rank", F.row_number().over(by_name) - 1)
    brackets = t.where(F.col("tok").isin("(", ")")).withColumn("level", F.col("depth") + (F.col("tok") == ")").cast("int"))
    same = Window.partitionBy("tree_id", "level").orderBy("pos")
    own = F.when(F.col("next").startswith(":"), _length(F.col("next"))).when(~F.substring("next", 1, 1).isin("(", ")", ",", ";", ":") & F.col("next2").startswith(":"), _length(F.col("next2")))
    b = brackets.select("tree_id", "level", "pos", "tok", "leaf_no", own.alias("own"))
    b = b.withColumns({"hi": F.lead("leaf_no").over(same), "length": F.lead("own").over(same)})
    return leaves, b.where("tok = '('").select("tree_id", "level", F.col("leaf_no").alias("lo"), "hi", "length"), status


def clades(trees: DataFrame, use_map: bool = False) -> DataFrame:
    """(tree_id, level, k, clade, length, n): every internal node with the k sorted ranks below it; the root has level 1."""
    leaves, ranges, _ = parse(trees, use_map)
    order = leaves.groupBy("tree_id").agg(F.sort_array(F.collect_list(F.struct("leaf_no", "rank"))).alias("o"), F.count(F.lit(1)).alias("n"))
    both = ranges.join(order.select("tree_id", F.transform("o", lambda x: x["rank"]).alias("ranks"), "n"), "tree_id")
    clade = F.sort_array(F.slice("ranks", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")))
    return both.select("tree_id", "level", (F.col("hi") - F.col("lo")).cast("int").alias("k"), clade.alias("clade"), "length", F.col("n").cast("int").alias("n"))
