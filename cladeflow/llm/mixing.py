"""Mixing sources to target weights: Sainte-Laguë apportionment of equal blocks of words.

DataFrame functions only. The words of all sources, times `volume`, are shared out by weight; a target
stops at `max_repeats` times its source, and what is above is shared again among the others. The mix is
cut into blocks of `block_words` words, and the blocks go to the highest quotients target / (2 n - 1): to
sources first, then to the shards of a source by their size, then to the parts of a shard. A source has as many shards,
and a shard as many parts, as leave about `part_blocks` blocks or more to a part, and `fan` of each at most. (In a part
of less than a block, what is apportioned above `max_repeats` times its size would be lost.)
Every part so has a whole number of blocks. Inside a part the documents stand in a seeded order on a ring
of their words, and its blocks are the ring's from a seeded first one on, round and round; a document gives
the words that the blocks cover, `max_repeats` times its size at most.

A round of apportionment ranks only the quotients that can decide: each member gets what it has for
certain, from a divisor that is too large, and about three candidates a member are ranked for the rest.
No ranking sees more than `fan` members of one group, however many documents a source has; documents meet
only inside their part, one of fan * fan of a large source. The table of sources has one row a source.

Defined cases: null text has no words and null sources form a source of their own, the last; documents without words have a
target but give nothing; repeated rows count each and share words alike; reruns agree, whatever the
partitions; an empty table gives none; extra columns pass through `materialise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeflow.session import few_files, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SEED = "mix"


def hash60(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts, as a long."""
    return F.conv(F.substring(F.md5(F.encode(F.concat_ws("\x01", *parts), "UTF-8")), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def apportion(members: DataFrame, group: list[str], order: list[str], share: str, seats: str, out: str) -> DataFrame:
    """members with `out`: of the `seats` of its group (the same in all its rows), those with the highest
    quotients share / (2 n - 1), ties to the first in `order`."""
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    a = members.withColumns({"_sum": F.sum(F.col(share).cast("double")).over(g), "_n": F.count(F.lit(1)).over(g)})
    quota = lambda by: F.when(F.col("_sum") > 0, F.col(share).cast("double") * by / F.col("_sum")).otherwise(F.lit(0.0))
    a = a.withColumn("_sure", F.greatest(F.lit(0), F.floor(quota(F.col(seats) - F.col("_n") / 2.0) + 0.5)).cast("long"))
    a = a.withColumn("_most", F.greatest(F.col("_sure"), F.floor(quota(F.col(seats) + F.col("_n") / 2.0) + 0.5).cast("long") + 1))
    a = a.withColumn("_left", F.col(seats) - F.sum("_sure").over(g))
    b = a.withColumn("_seat", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_most")))))
    b = b.withColumn("_quotient", F.when((F.col(share) > 0) & F.col("_seat").isNotNull(), F.col(share).cast("double") / (2 * F.col("_seat") - 1)))
    best = g.orderBy(F.col("_quotient").desc_nulls_last(), *order, "_seat")
    b = b.withColumn("_won", (F.col("_quotient").isNotNull() & (F.row_number().over(best) <= F.col("_left"))).cast("long"))
    keys = [c for c in members.columns]
    return b.groupBy(*keys).agg((F.max("_sure") + F.sum("_won")).alias(out))


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    other = right.withColumnsRenamed({k: f"_of{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys]
    return left.join(other, on).drop(*(f"_of{k}" for k in keys))


def targets(sources: DataFrame, volume: float, max_repeats: int) -> DataFrame:
    """sources (source, source_size) with rank, weight and target."""
    one = Window.partitionBy(F.lit(0))
    a = sources.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    a = a.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") - 1) % len(WEIGHTS) + 1))
    a = a.withColumns({"cap": F.col("source_size") * max_repeats, "_all": F.sum("source_size").over(one) * F.lit(volume)})
    # In order of cap / weight: with all before it at their caps, the rest is shared; the first that stays below its cap fixes the level.
    up = one.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    a = a.withColumns({"_at": F.row_number().over(up), "_level": (F.col("_all") - before) / after})
    fixed = F.min(F.when(F.col("_level") <= F.col("cap") / F.col("weight"), F.struct("_at", "_level"))).over(one)["_level"]
    a = a.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * fixed, F.col("cap").cast("double"))))
    return a.select("source", "source_size", "rank", "weight", "target", F.col("_all").alias("volume"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", volume: float = 1.5, max_repeats: int = 2, block_words: int = 8, part_blocks: int = 64, fan: int = 256, seed: str = SEED) -> DataFrame:
    """id, row_hash, size, source_size, target, taken, and the mix's share of each row: copies and parts.

    `copies` are whole uses of the document, `parts` are (begin, end) word positions of the rest.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), hash60(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).alias("_h"))
    rows = written(rows.withColumns({"_a": F.col("_h") % fan, "_b": F.expr(f"_h div {fan}") % fan}), "sizes")
    cells = written(rows.groupBy("source", "_a", "_b").agg(F.sum("size").alias("cell_size")), "cells", few_files(docs, rows))
    sources = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    root = F.floor(F.sqrt(F.col("source_size") / (part_blocks * block_words))).cast("long")
    cells = lookup(cells, sources.withColumn("_fan", F.greatest(F.lit(1), F.least(F.lit(fan), root))).drop("source_size"), ["source"])
    cells = cells.withColumns({"shard": F.col("_a") % F.col("_fan"), "part": F.col("_b") % F.col("_fan")}).drop("_fan")
    parts = cells.groupBy("source", "shard", "part").agg(F.sum("cell_size").alias("part_size"))
    shards = parts.groupBy("source", "shard").agg(F.sum("part_size").alias("shard_size"))
    sources = apportion(targets(sources, volume, max_repeats).withColumn("_blocks", F.floor(F.col("volume") / block_words + 0.5)), [], ["rank"], "target", "_blocks", "source_blocks")
    shards = apportion(lookup(shards, sources.select("source", "source_blocks"), ["source"]), ["source"], ["shard"], "shard_size", "source_blocks", "shard_blocks")
    parts = lookup(parts, shards.select("source", "shard", "shard_blocks"), ["source", "shard"])
    parts = apportion(parts, ["source", "shard"], ["part"], "part_size", "shard_blocks", "blocks").drop("shard_blocks")
    parts = lookup(parts, sources.select("source", "source_size", "target"), ["source"])
    d = lookup(rows, lookup(cells.drop("cell_size"), parts, ["source", "shard", "part"]), ["source", "_a", "_b"])
    ring = Window.partitionBy("source", "shard", "part").orderBy("_h", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_end", F.sum("size").over(ring))
    words = F.least(F.col("blocks") * block_words, F.col("part_size") * max_repeats)
    some = F.col("part_size") > 0
    first = F.when(some, hash60(F.lit(seed), F.coalesce("source", F.lit("")), F.col("shard"), F.col("part")) % F.ceil(F.col("part_size") / block_words) * block_words)
    d = d.withColumns({"_begin": F.col("_end") - F.col("size"), "copies": F.coalesce(F.when(some, F.floor(words / F.col("part_size"))), F.lit(0)).cast("long"), "_first": first})
    d = d.withColumn("_rest", F.coalesce(words - F.col("copies") * F.col("part_size"), F.lit(0)))
    # The rest covers [first, first + rest) of the ring: at most two pieces of a document.
    piece = lambda shift: F.struct(
        (F.greatest(F.col("_begin"), F.col("_first") + shift) - F.col("_begin")).cast("long").alias("begin"),
        (F.least(F.col("_end"), F.col("_first") + F.col("_rest") + shift) - F.col("_begin")).cast("long").alias("end"),
    )
    pieces = F.filter(F.array(piece(-F.col("part_size")), piece(F.lit(0))), lambda p: p["end"] > p["begin"])
    d = d.withColumn("parts", F.when(some, pieces).otherwise(F.filter(F.array(piece(F.lit(0))), lambda p: F.lit(False))))
    taken = F.col("copies") * F.col("size") + F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["end"] - p["begin"])
    return d.select(F.col("_id").alias(id_col), F.col("_h").alias("row_hash"), "size", "source_size", "target", taken.cast("long").alias("taken"), "copies", "parts")


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole use, and one for each part, cut at words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seed = options.get("seed", SEED)
    share = mix(docs, id_col, text_col, source_col, **options).where("taken > 0").select(F.col(id_col).alias("_id"), F.col("row_hash").alias("_k"), "copies", "parts")
    # Repeated rows are told apart by their number among equals.
    again = Window.partitionBy("_id", "_k").orderBy("copies", "parts")
    share = share.withColumn("_no", F.row_number().over(again)).withColumnsRenamed({"_id": "_id2", "_k": "_k2", "_no": "_no2"})
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), hash60(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).alias("_k"))
    d = d.withColumn("_no", F.row_number().over(Window.partitionBy("_id", "_k").orderBy(F.lit(0))))
    m = d.join(share, d["_id"].eqNullSafe(share["_id2"]) & (d["_k"] == share["_k2"]) & (d["_no"] == share["_no2"]))
    own = F.coalesce(F.col("_row")[text_col].cast("string"), F.lit(""))
    tokens = F.regexp_extract_all(own, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    whole = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(1), F.col("copies")), lambda _: own)).otherwise(F.array().cast("array<string>"))
    cut = F.when(F.size("parts") > 0, F.transform("parts", lambda p: F.array_join(F.slice(tokens, p["begin"].cast("int") + 1, (p["end"] - p["begin"]).cast("int")), ""))).otherwise(F.array().cast("array<string>"))
    m = m.select("_row", F.explode_outer(F.concat(whole, cut)).alias("_text")).where(F.col("_text").isNotNull())
    kind = dict(docs.dtypes)
    out = [F.col("_text").alias(c) if c == text_col else F.char_length("_text").cast(kind[c]).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns]
    return m.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _rounds(name: str, members: str, group: str, order: str, share: str, seats: str, out: str) -> str:
    """The CTEs of one round of apportionment in SQL."""
    by = f"PARTITION BY {group}" if group else ""
    return f"""
{name}_a AS (
  SELECT *, sum({share}::DOUBLE) OVER ({by}) AS w_, count(*) OVER ({by}) AS n_ FROM {members}
), {name}_b AS (
  SELECT *, greatest(0, floor(CASE WHEN w_ > 0 THEN {share}::DOUBLE * ({seats} - n_ / 2.0) / w_ ELSE 0 END + 0.5))::BIGINT AS sure_,
    floor(CASE WHEN w_ > 0 THEN {share}::DOUBLE * ({seats} + n_ / 2.0) / w_ ELSE 0 END + 0.5)::BIGINT + 1 AS most_
  FROM {name}_a
), {name}_c AS (
  SELECT *, {seats} - sum(sure_) OVER ({by}) AS left_ FROM {name}_b
), {name}_d AS (
  SELECT *, unnest(range(sure_ + 1, greatest(sure_, most_) + 1)) AS seat_ FROM {name}_c
), {name}_e AS (
  SELECT *, {share}::DOUBLE / (2 * seat_ - 1) AS q_ FROM {name}_d WHERE {share} > 0
), {name}_f AS (
  SELECT *, row_number() OVER ({by} ORDER BY q_ DESC, {order}, seat_) AS r_ FROM {name}_e
), {name}_g AS (
  SELECT {group + ',' if group else ''} {order}, count(*) FILTER (WHERE r_ <= left_) AS won_ FROM {name}_f GROUP BY ALL
), {name} AS (
  SELECT c.*, c.sure_ + coalesce(g.won_, 0) AS {out} FROM {name}_c c LEFT JOIN {name}_g g ON {' AND '.join(f'c.{k} = g.{k}' for k in [*(group.split(', ') if group else []), order])}
)"""


def _hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(chr(1), {', '.join(parts)})), 1, 15))::BIGINT"


#: Rank 1, 2, ... stands for the source in the joins.
ORACLE = f"""
WITH src AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM (SELECT DISTINCT source FROM documents)
), d AS (
  SELECT doc_id, documents.source, rank, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    {_hash("'" + SEED + "'", "coalesce(doc_id::VARCHAR, '')", "coalesce(text, '')")} AS h
  FROM documents JOIN src ON documents.source IS NOT DISTINCT FROM src.source
), z AS (
  SELECT rank, sum(size) AS source_size, greatest(1, least(256, floor(sqrt(sum(size)::DOUBLE / 512))))::BIGINT AS fan FROM d GROUP BY rank
), r AS (
  SELECT d.*, h % 256 % fan AS a, (h // 256) % 256 % fan AS b FROM d JOIN z USING (rank)
), p0 AS (
  SELECT rank, a, b, sum(size)::BIGINT AS part_size FROM r GROUP BY ALL
), s0 AS (
  SELECT rank, a, sum(part_size)::BIGINT AS shard_size FROM p0 GROUP BY ALL
), t0 AS (
  SELECT rank, sum(shard_size)::BIGINT AS source_size, [5, 2, 1][(rank - 1) % 3 + 1] AS weight FROM s0 GROUP BY rank
), t1 AS (
  SELECT *, source_size * 2 AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS volume FROM t0
), t2 AS (
  SELECT *, row_number() OVER o AS pos,
    (volume - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM t1 WINDOW o AS (ORDER BY cap / weight, rank)
), t3 AS (
  SELECT *, least(cap::DOUBLE, weight * (SELECT arg_min(level, pos) FROM t2 WHERE level <= cap / weight)) AS target, floor(volume / 8 + 0.5)::BIGINT AS blocks FROM t2
), {_rounds("t", "t3", "", "rank", "target", "blocks", "source_blocks")},
s1 AS (
  SELECT s0.*, source_blocks FROM s0 JOIN t USING (rank)
), {_rounds("s", "s1", "rank", "a", "shard_size", "source_blocks", "shard_blocks")},
p1 AS (
  SELECT p0.*, shard_blocks FROM p0 JOIN s USING (rank, a)
), {_rounds("p", "p1", "rank, a", "b", "part_size", "shard_blocks", "part_blocks")},
m AS (
  SELECT r.*, part_size, least(part_blocks * 8, part_size * 2) AS words, source_size, target,
    sum(size) OVER (PARTITION BY r.rank, a, b ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
  FROM r JOIN p USING (rank, a, b) JOIN t ON r.rank = t.rank
), x AS (
  SELECT *, e - size AS s, words // nullif(part_size, 0) AS copies,
    {_hash("'" + SEED + "'", "coalesce(source, '')", "a", "b")} % nullif(ceil(part_size / 8)::BIGINT, 0) * 8 AS f
  FROM m
), y AS (
  SELECT *, words - copies * part_size AS rest FROM x
)
SELECT doc_id, size, source_size, target,
  coalesce(copies * size + greatest(0, least(e, f + rest) - greatest(s, f))
    + greatest(0, least(e, f + rest - part_size) - greatest(s, f - part_size)), 0)::BIGINT AS taken
FROM y
"""
