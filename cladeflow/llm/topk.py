"""Exact top-k inner-product search by distributed histogram selection.

Every query is scored against every candidate, in blocks of queries of bounded size. Nothing but
histograms leaves a task until the k-th value is known: each pass counts a query's scores in `bins`
equal slices of the range that must hold its k-th value, the counts are added up over all tasks, and
the slice with the k-th value becomes the next range, until a slice is one integer wide. A last pass
keeps what lies above the k-th value, and of the ties at it the smallest ids that are still needed.
Scores are recomputed in each pass; no score table is ever stored or shuffled.

Queries are taken in pages that are bounded by `block` and `block_bytes`; a page costs one scan of the candidates
for each pass. What a page finds is appended to one table in the shared folder, so the plan does not grow with
the number of pages.

Defined cases: rows whose id or vector is null, or whose vector holds a null or non-finite component,
take no part. Repeated candidate rows count each; of the usable query rows that share an id the smallest vector
counts. A candidate with another length than the query's takes no part in that query's ranking. Fewer than k
candidates: all are returned. Empty tables give an empty result. Components saturate at 2^63 and scores at
2^63 - 1, above and below zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeflow.session import scratch, ship, table, trimmed, written

#: Where products and their sums stay below this, doubles hold them exactly.
EXACT = 2.0**53
FOUND = "query_id long, vec_id long, score long"
SATURATE = 2**63 - 1
#: Counts that a task holds: queries of a page times slices.
CELLS = 4 << 20


def _usable(ids: pa.Array, vectors: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of floor(scale * x) as doubles) for each vector length in a batch."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    vectors = vectors.cast(pa.large_list(pa.float64()))
    offsets = np.asarray(vectors.offsets)
    flat = vectors.values.to_numpy(zero_copy_only=False)  # null components become NaN
    start, length = offsets[:-1], np.diff(offsets)
    valid = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = []
    for d in np.unique(length[valid]):
        rows = np.flatnonzero(valid & (length == d))
        m = flat[start[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0))
        fine = np.isfinite(m).all(axis=1)
        with np.errstate(over="ignore"):
            m = np.clip(np.floor(m[fine] * scale), -(2.0**63), 2.0**63)
        out.append((ids[rows[fine]], m))
    return out


def _scores(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, candidates by queries."""
    bound = (np.abs(m).max(initial=0) * np.abs(q).sum(axis=1).max(initial=0)) if m.size and q.size else 0
    if bound < EXACT:
        return (m @ q.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in m], object) @ np.array([[int(x) for x in row] for row in q], object).T
    return np.array([[max(-SATURATE, min(SATURATE, x)) for x in row] for row in whole], np.int64).reshape(len(m), len(q))


def _chunks(batches, plan: dict, scale: float):
    """(positions of queries, ids, scores, own) for bounded pieces of all candidates."""
    for b in batches:
        for ids, m in _usable(b.column(0), b.column(1), scale):
            at, q = plan["by_length"].get(m.shape[1], (None, None))
            if at is None:
                continue
            step = max(1, 1_000_000 // max(1, len(at)))
            for i in range(0, len(ids), step):
                part = ids[i : i + step]
                yield at, part, _scores(m[i : i + step], q), part[:, None] == plan["ids"][at][None, :]


def _histogram(batches, plan: dict, scale: float):
    n, bins = len(plan["ids"]), plan["bins"]
    counts = np.zeros((n, bins), np.int64)
    lo, width, hi = plan["lo"], plan["width"], plan["hi"]
    for at, _, s, own in _chunks(batches, plan, scale):
        inside = ~own & (s >= lo[at]) & (s <= hi[at])
        _, c = np.nonzero(inside)
        # Unsigned: the range of scores can be wider than a signed number.
        slot = ((s[inside].view(np.uint64) - lo[at][c].view(np.uint64)) // width[at][c].view(np.uint64)).astype(np.int64)
        counts += np.bincount(at[c] * bins + slot, minlength=n * bins).reshape(n, bins)
    # Slices below a task's own k-th value cannot hold the k-th value of all tasks.
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
    q, slot = np.nonzero((counts > 0) & (above < plan["need"][:, None]))
    yield pa.record_batch({"q": pa.array(q, pa.int32()), "slot": pa.array(slot, pa.int32()), "n": pa.array(counts[q, slot], pa.int64())})


def _select(batches, plan: dict, scale: float):
    kth, ties = plan["kth"], plan["ties"]
    tied: list[tuple[np.ndarray, np.ndarray]] = []

    def rows(q, ids, score):
        return pa.record_batch({"query_id": pa.array(plan["ids"][q], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})

    def least(q, ids):
        """For each query the `ties` smallest ids."""
        order = np.lexsort((ids, q))
        q, ids = q[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = rank < ties[q]
        return q[keep], ids[keep]

    for at, ids, s, own in _chunks(batches, plan, scale):
        r, c = np.nonzero(~own & (s > kth[at]))
        if len(r):
            yield rows(at[c], ids[r], s[r, c])
        r, c = np.nonzero(~own & (s == kth[at]))
        if len(r):
            tied.append((at[c], ids[r]))
            if sum(len(x) for x, _ in tied) > 200_000:
                tied = [least(*map(np.concatenate, zip(*tied, strict=True)))]
    if tied:
        q, ids = least(*map(np.concatenate, zip(*tied, strict=True)))
        yield rows(q, ids, kth[q])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, block: int = 16384, bins: int = 4096, block_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, the query's own id excepted.

    `block` queries at most (and `block_bytes` of their vectors) are held by the driver and sent out at
    once; the candidates are scanned again for each page, so no task holds more than a page of queries, CELLS
    counts and a batch of candidates, however many there are of any.
    """
    spark = candidates.sparkSession
    ship(spark)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"))
    cand = pick(candidates)
    # Rows that take no part go first: one of them must not stand for the others of its id.
    unusable = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = pick(queries).where(F.col("i").isNotNull() & F.col("v").isNotNull()).where(~unusable)
    todo = written(usable.groupBy("i").agg(F.min("v").alias("v")), "queries")
    head = cand.where("i is not null and v is not null").agg(F.max(F.array_max(F.transform("v", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.abs(x))))), F.max(F.size("v"))).first()
    peak, dims = float(head[0] or 0.0), int(head[1] or 0)
    block = max(1, min(block, block_bytes // max(1, 8 * dims)))
    path, last, pages = scratch(spark, "best"), None, 0
    while True:
        page = todo if last is None else todo.where(F.col("i") > last)
        rows = page.orderBy("i").limit(block).collect()
        if not rows:
            break
        last = rows[-1]["i"]
        _one_page(cand, rows, k, scale, max(2, min(bins, CELLS // len(rows))), peak).write.mode("append").parquet(path)
        pages += 1
        if len(rows) < block:
            break
    found = spark.read.schema(FOUND).parquet(path) if pages else spark.createDataFrame([], FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_page(cand: DataFrame, rows: list, k: int, scale: float, bins: int, peak: float) -> DataFrame:
    sc = cand.sparkSession.sparkContext
    by_length, ids, bound, done = {}, [], [], 0
    for i, m in _usable(pa.array([r["i"] for r in rows], pa.int64()), pa.array([r["v"] for r in rows], pa.list_(pa.float64())), scale):
        by_length[m.shape[1]] = (np.arange(done, done + len(i)), m)
        ids.append(i)
        # Sums of large doubles are rounded: a little more than they say.
        bound += [min(SATURATE, int(x * min(2.0**63, np.ceil(peak * scale) + 1) * (1 + 1e-9)) + 1) for x in np.abs(m).sum(axis=1)]
        done += len(i)
    plan = {"by_length": by_length, "ids": np.concatenate(ids) if ids else np.zeros(0, np.int64), "bins": bins}
    n = len(plan["ids"])
    hi = np.array(bound, np.int64)
    lo, need = -hi, np.full(n, k, np.int64)
    open_ = np.ones(n, bool)  # k-th value not pinned down yet
    kth = lo.copy()
    while open_.any():
        width = np.array([max(1, -((int(a) - int(b) - 1) // bins)) for a, b in zip(lo, hi, strict=True)], np.int64)
        # A settled query takes no more counts: its range is empty.
        plan |= {"lo": np.where(open_, lo, 1), "hi": np.where(open_, hi, 0), "width": width, "need": need}
        sent = sc.broadcast(plan)
        counted = cand.mapInArrow(trimmed(lambda b, sent=sent, scale=scale: _histogram(b, sent.value, scale), 10_000), "q int, slot int, n long")
        total = counted.groupBy("q", "slot").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.col("slot").desc())
        # Slices with fewer than k above them: at most k for a query, the one with the k-th value among them.
        top = total.withColumn("upto", F.sum("n").over(down)).where(F.col("upto") - F.col("n") < k)
        marks = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("upto", "slot", "n"))).alias("steps")).collect()
        seen = np.zeros(n, bool)
        for r in marks:
            q = r["q"]
            seen[q] = True
            step = next((s for s in r["steps"] if s["upto"] >= need[q]), None)
            if step is None:  # fewer than k candidates in all
                open_[q], kth[q] = False, -SATURATE - 1
                continue
            need[q] -= step["upto"] - step["n"]
            lo[q] = int(lo[q]) + step["slot"] * int(width[q])
            hi[q] = min(int(hi[q]), int(lo[q]) + int(width[q]) - 1)
            if lo[q] == hi[q]:
                open_[q], kth[q] = False, lo[q]
        for q in np.flatnonzero(open_ & ~seen):
            open_[q], kth[q] = False, -SATURATE - 1
    plan |= {"kth": kth, "ties": need}
    sent = sc.broadcast(plan)
    return cand.mapInArrow(trimmed(lambda b, sent=sent, scale=scale: _select(b, sent.value, scale), 10_000), FOUND)


def divisible(column: str, by: int) -> Column:
    return F.pmod(F.col(column), F.lit(by)) == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: ten best rows for every embedding whose vec_id is divisible by 100, over all embeddings."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where(divisible("vec_id", 100)), vectors)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
