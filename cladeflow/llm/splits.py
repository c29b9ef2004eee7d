"""Which rows models may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS, HELD_OUT = 4, 2


def held_out(id_col: str) -> Column:
    """Rows kept back from learning: crc32 of the id as text, modulo 4, is 2. False where the id is null."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % PARTS == HELD_OUT, F.lit(False))


def may_learn(id_col: str) -> Column:
    """Rows that models may learn from; a row without an id is none of them."""
    return F.col(id_col).isNotNull() & ~held_out(id_col)


def shares(counts: dict, most: int, in_all: int) -> dict:
    """How many rows of each value: at most `most`, `in_all` together, shared out so that values with few rows leave theirs to the others.

    The in_all // most values with the most rows get most // 4 whatever the number of others.
    """
    first = set(sorted(counts, key=lambda v: (-counts[v], repr(v)))[: in_all // most])
    least = {v: min(n, most // 4) if v in first else 0 for v, n in counts.items()}
    at = lambda level: {v: max(least[v], min(n, most, level)) for v, n in counts.items()}
    low, high = 0.0, float(most)
    if sum(at(high).values()) <= in_all:
        return at(high)
    for _ in range(50):
        level = (low + high) / 2
        low, high = (level, high) if sum(at(level).values()) <= in_all else (low, level)
    return at(low)


def bounded(rows: DataFrame, by: str, id_col: str, most: int, in_all: int, size_col: str | None = None, size_in_all: int = 0, values: int = 1000) -> DataFrame:
    """About `most` rows of each value of `by`, and `in_all` together, picked by a hash of the id: the same in every run.

    Only the `values` commonest values count (ties to the value that sorts first). Their counts are collected (one
    row a value) and shared out by `shares`; where the picked rows would come to more than `size_in_all` in
    `size_col`, all shares shrink alike. The pick is a join with the shares (sent to the executors), not a sort.
    """
    size = F.sum(size_col).cast("double") if size_col else F.lit(0.0)
    found = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_n"), size.alias("_size"))
    found = found.orderBy(F.col("_n").desc(), by).limit(values).collect()
    if not found:
        return rows.limit(0)
    counts = {r[0]: r["_n"] for r in found}
    taken = shares(counts, most, in_all)
    expected = sum(r["_size"] * taken[r[0]] / r["_n"] for r in found)
    shrink = min(1.0, size_in_all / expected) if size_col and expected else 1.0
    u = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    kind = rows.schema[by].dataType.simpleString()
    rates = rows.sparkSession.createDataFrame([(v, min(1.0, x / counts[v] * shrink)) for v, x in taken.items()], f"_value {kind}, _rate double")
    return rows.join(F.broadcast(rates), F.col(by) == F.col("_value")).where(u < F.col("_rate")).select(*rows.columns)
