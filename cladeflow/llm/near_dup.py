"""Near duplicates: b-bit MinHash candidates, confirmed on full shingle sets, joined to components.

A text's set is its distinct shingles of `words` words (fewer words: the whole text is one shingle), as
64-bit hashes. Texts with one set form a class; one row of it stands for all. For a class, 256 minima are
taken; bands of four make bucket keys of half of them, and the low four bits of every minimum are packed
into a signature. Similarity is estimated from two signatures by counting equal four-bit groups with bit
operations, corrected for chance agreement (1 in 16); a pair estimated clearly below the threshold (more than four
standard errors) is dropped, any other is confirmed or refused on the full sets.

Buckets are not expanded to pairs. First each member is paired with the head of its bucket: for a group of
copies that links nearly all of it. Then only buckets whose members still lie in different components are
gone through, in blocks of bounded size: members with a likely partner in another component are named, their
full sets are sent to the same blocks, and the links that join components come out, fewer than members. So
every pair that shares a bucket is linked, or refused, or already in one component, and no list of pairs is made.
A pair at similarity 0.75 shares no bucket with probability 5e-6, at 0.8 with 6e-8.

Full sets are computed again for the classes that need them; a bitmap of fixed size over the hashes of
their texts tells the scan which rows to take (a wrong hit costs time only). Intermediate tables are
written to the shared folder; nothing that grows with the input goes to the driver.

Defined cases: null texts and texts without words have an empty set, are linked with nothing and are
components of their own; repeated rows share a class; null ids never name a component unless all ids in it
are null, and then its id is null; an empty table gives none; extra columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.session import few_files, ship, table, trimmed, written

BANDS, ROWS = 32, 4
#: Minima in a signature, of which the bands use the first BANDS * ROWS, and the bits kept of each.
MINIMA, BITS = 256, 4
WORDS, THRESHOLD = 5, 0.75
#: Pairs estimated further than this below the threshold are not confirmed: at 0.75 itself, an estimate from
#: 256 minima falls so low once in 10^5 (4.3 standard errors), at 0.8 once in 10^10.
SLACK = 0.12
#: Members in a block of a bucket of k: BLOCK, or sqrt(WIDEN * k) where that is more. So a bucket sends k * sqrt(k / WIDEN) rows
#: at most, and a task holds two blocks, whose pairs it goes through CHUNK at a time.
BLOCK, WIDEN, CHUNK = 512, 64, 1 << 15
PORTION = 256
MASK = 0x1111111111111111

_rng = np.random.default_rng(20240501)
_odd = lambda n: _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE, MULTIPLY, JOIN = _odd(64), _odd(MINIMA), _odd(ROWS)
SHUFFLE = _odd(2)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * SHUFFLE[0]
    x = (x ^ (x >> np.uint64(29))) * SHUFFLE[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8; A-Z are lower-cased, ASCII blanks part words."""
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    size = min(n, words)
    s = np.full(n - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        s += h[i : n - size + 1 + i] * PLACE[i]
    return np.unique(mixed(s))


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set that is not empty."""
    out = np.full(len(MULTIPLY), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(out, (MULTIPLY[:, None] * s[None, i : i + 1024]).min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    return mixed((m[: BANDS * ROWS].reshape(BANDS, ROWS) * JOIN).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low four bits of every minimum, sixteen to a word."""
    low = (m & np.uint64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(low, axis=1).view(np.int64)


N_SIG = MINIMA * BITS // 64
SIGNATURE = f"rid long, doc_id long, th long, n long, set_a long, set_b long, bands array<long>, sig array<long>"


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """SIGNATURE for every row; rid numbers the rows of this (written) table."""

    def run(batches):
        hashes, task, count = WordHashes(), TaskContext.get().partitionId() << 33, 0
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for i in range(0, len(texts), 512):
                out: dict[str, list] = {k: [] for k in ("n", "set_a", "set_b", "bands", "sig")}
                for t in texts.slice(i, 512):
                    s = shingles(t.as_py() or b"", hashes, words)
                    out["n"].append(len(s))
                    if len(s):
                        key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                        m = minima(s)
                        out["set_a"].append(int(key[0]))
                        out["set_b"].append(int(key[1]))
                        out["bands"].append(band_keys(m))
                        out["sig"].append(packed(m))
                    else:
                        for k in ("set_a", "set_b", "bands", "sig"):
                            out[k].append(None)
                k = len(out["n"])
                longs, many = pa.int64(), pa.list_(pa.int64())
                yield pa.record_batch({"rid": pa.array(range(task + count, task + count + k), longs), "doc_id": b.column(0).slice(i, 512), "th": b.column(2).slice(i, 512), "n": pa.array(out["n"], longs), "set_a": pa.array(out["set_a"], longs), "set_b": pa.array(out["set_b"], longs), "bands": pa.array(out["bands"], many), "sig": pa.array(out["sig"], many)})
                count += k

    return _rows(docs, id_col, text_col).mapInArrow(trimmed(run), SIGNATURE)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two signatures, corrected for groups that agree by chance."""
    differ = F.lit(0)
    for i in range(N_SIG):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(MASK))
        differ = differ + F.bit_count(x)
    same = 1.0 - differ / F.lit(float(MINIMA))
    return (same - 1 / 16) / (1 - 1 / 16)


def shared_sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, words: int, bitmap_bits: int) -> DataFrame:
    """(cid, s): the sorted shingle hashes of the classes in needed (cid, doc_id, th)."""
    spark = docs.sparkSession
    at = F.pmod("th", F.lit(bitmap_bits))
    pages = needed.select(F.floor(at / 32768).alias("page"), (at % 32768).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros(bitmap_bits // 8, np.uint8)
    for p in pages:
        bits[p["page"] * 4096 : p["page"] * 4096 + 4096] = np.frombuffer(p["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(bits)

    def run(batches):
        hashes, bits = WordHashes(), sent.value
        for b in batches:
            th = b.column(2).to_numpy(zero_copy_only=False)
            at = np.mod(th, bitmap_bits)
            hit = np.flatnonzero((bits[at >> 3] >> (at & 7)) & 1)
            b = b.take(pa.array(hit))
            texts = b.column(1).cast(pa.binary())
            for i in range(0, len(texts), 512):
                sets = [shingles(t.as_py() or b"", hashes, words).tobytes() for t in texts.slice(i, 512)]
                yield pa.record_batch({"doc_id": b.column(0).slice(i, 512), "th": b.column(2).slice(i, 512), "s": pa.array(sets, pa.binary())})

    found = _rows(docs, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, th long, s binary")
    want = needed.select("cid", F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    # Rows that repeat have equal sets: any one of them does.
    return found.join(want, found["th"].eqNullSafe(want["_t"]) & found["doc_id"].eqNullSafe(want["_d"])).select("cid", "s").dropDuplicates(["cid"])


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, bitmap_bits: int, slack: float = SLACK, files: int | None = None) -> DataFrame:
    """The pairs (u, v) of classes whose full sets are at the threshold or above, as a written table."""
    a = reps.select(F.col("cid").alias("u"), F.col("sig").alias("sig_u"), F.col("n").alias("n_u"))
    b = reps.select(F.col("cid").alias("v"), F.col("sig").alias("sig_v"), F.col("n").alias("n_v"))
    likely = pairs.join(a, "u").join(b, "v")
    likely = likely.where((F.least("n_u", "n_v") >= F.greatest("n_u", "n_v") * threshold) & (estimate(F.col("sig_u"), F.col("sig_v")) >= threshold - slack))
    likely = written(likely.select("u", "v"), "likely", files)
    ends = likely.select(F.explode(F.array("u", "v")).alias("cid")).distinct()
    needed = written(reps.select("cid", "doc_id", "th").join(ends, "cid"), "needed", files)
    sets = written(shared_sets(docs, needed, id_col, text_col, words, bitmap_bits), "sets", files)
    # u is the head, whose set travels once for a portion of its members, ahead of theirs.
    # A hot u is split into portions of at most about PORTION members, each with a copy of its set.
    portions = likely.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("long").alias("np"))
    heads = portions.join(sets.withColumnRenamed("cid", "u"), "u").select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("np") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), "s")
    tails = likely.join(portions, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("np"))).join(sets.withColumnRenamed("cid", "v"), "v").select("u", "part", "v", "s")
    dealt = heads.union(tails).repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())

    def run(batches):
        head = np.zeros(0, np.uint64)
        for b in batches:
            us, vs = [], []
            for u, v, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                if v is None:
                    head = own.copy()
                    continue
                if similar(own, head, threshold):
                    us.append(u)
                    vs.append(v)
            yield pa.record_batch({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    links = dealt.mapInArrow(trimmed(run), "u long, v long")
    return written(links.repartition(files) if files else links, "links")  # few rows, but long work for each


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(cid, comp) for every end of a link: the least end that it is connected with.

    Labels move to the least neighbour's label and then to their label's label, until none changes; a star
    is done in one round, a chain in about the logarithm of its length.
    """
    edges = written(links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).distinct(), "edges", files)
    labels = written(edges.groupBy(F.col("u").alias("cid")).agg(F.least("u", F.min("v")).alias("comp")), "labels", files)
    while True:
        near = edges.join(labels.withColumnRenamed("cid", "v"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        moved = labels.join(near, labels["cid"] == near["u"]).select("cid", F.col("comp").alias("old"), F.least("comp", "near").alias("at"))
        jump = labels.select(F.col("cid").alias("at"), F.col("comp").alias("far"))
        moved = written(moved.join(jump, "at", "left").select("cid", "old", F.least("at", "far").alias("comp")), "labels", files)
        changed = moved.where("comp <> old").limit(1).count()
        labels = moved.select("cid", "comp")
        if not changed:
            return labels


def joined(comps: DataFrame, links: DataFrame, files: int | None = None) -> DataFrame:
    """comps with more links: only the components that these connect are gone through again."""
    if not links.limit(1).count():
        return comps
    ends = links.select(F.explode(F.array("u", "v")).alias("cid")).distinct().join(comps, "cid", "left_anti")
    all_ends = written(comps.select("cid", "comp").union(ends.select("cid", F.col("cid").alias("comp"))), "ends", files)
    u, v = all_ends.select(F.col("cid").alias("u"), F.col("comp").alias("cu")), all_ends.select(F.col("cid").alias("v"), F.col("comp").alias("cv"))
    between = components(links.join(u, "u").join(v, "v").where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")), files)
    moved = between.select(F.col("cid").alias("comp"), F.col("comp").alias("to"))
    return written(all_ends.join(moved, "comp", "left").select("cid", F.coalesce("to", "comp").alias("comp")), "labels", files)


PIECE = "key long, lo long, hi long, blk long, cid long, comp long, n long, sig array<long>, bands array<long>"


def pieces(batches):
    """Tables of the rows that share (key, lo, hi), the first three columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        keys = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e == s:
                continue
            key = tuple(keys[s])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def likely_pairs(part: pa.Table, threshold: float, slack: float = SLACK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, estimates) of a piece's pairs in different components that may be similar, out of CHUNK pairs at a time.

    A pair that shares several buckets counts in the first of them only.
    """
    cid, comp, n, blk = (part.column(c).to_numpy() for c in ("cid", "comp", "n", "blk"))
    if (comp == comp[0]).all():
        return
    sig = part.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, N_SIG).view(np.uint64)
    bands = part.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    key, lo, hi = (part.column(c)[0].as_py() for c in ("key", "lo", "hi"))
    left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
    step = max(1, CHUNK // max(1, len(right)))
    for i in range(0, len(left), step):
        rows = left[i : i + step]
        x = sig[rows][:, None, :] ^ sig[right][None, :, :]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        same = 1 - np.bitwise_count(x & np.uint64(MASK)).sum(axis=2, dtype=np.int64) / MINIMA
        near = (same - 1 / 16) / (1 - 1 / 16)
        a, b = n[rows][:, None], n[right][None, :]
        ok = (near >= threshold - slack) & (np.minimum(a, b) >= threshold * np.maximum(a, b)) & (comp[rows][:, None] != comp[right][None, :])
        if lo == hi:
            ok &= cid[rows][:, None] < cid[right][None, :]
        r, c = np.nonzero(ok)
        if not len(r):
            continue
        u, v = rows[r], right[c]
        first = (bands[u] == bands[v]).argmax(axis=1)
        here = bands[u, first] == key
        if here.any():
            yield u[here], v[here], near[r, c][here]


def apart(members: DataFrame, reps: DataFrame, comps: DataFrame, threshold: float, slack: float = SLACK) -> DataFrame:
    """PIECE rows: the members of buckets (key, cid) that have a likely partner in another component.

    A bucket is cut into blocks and every pair of blocks (lo, hi) is a piece of work of its own. A member is
    named once for each piece, however many partners it has.
    """
    m = members.join(comps, "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp"))
    split = m.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("k")).where("a <> b").select("key", "k")
    m = m.join(split, "key").join(reps.select("cid", "n", "sig", "bands"), "cid")
    blocks = F.ceil(F.col("k") / F.greatest(F.lit(float(BLOCK)), F.sqrt(F.col("k") * WIDEN))).cast("long")
    m = m.withColumns({"nb": blocks, "blk": F.pmod(F.xxhash64("cid"), blocks)})
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    m = m.select("key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "cid", "comp", "n", "sig", "bands")

    def run(batches):
        for part in pieces(batches):
            named = np.zeros(len(part), bool)
            for u, v, _ in likely_pairs(part, threshold, slack):
                named[u] = named[v] = True
            if named.any():
                yield from part.take(pa.array(np.flatnonzero(named))).combine_chunks().to_batches()

    return m.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(trimmed(run), PIECE)


def links_across(rows: DataFrame, sets: DataFrame, threshold: float, slack: float = SLACK) -> DataFrame:
    """(u, v) of PIECE rows that join components, confirmed on the full sets; in a piece at most one for each member."""
    dealt = rows.join(sets, "cid").select("key", "lo", "hi", "blk", "cid", "comp", "n", "sig", "bands", "s")

    def run(batches):
        for part in pieces(batches):
            comp, cid, s = part.column("comp").to_pylist(), part.column("cid").to_pylist(), part.column("s").combine_chunks()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in s]
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            us, vs = [], []
            for u, v, near in likely_pairs(part, threshold, slack):
                for i in np.argsort(-near, kind="stable").tolist():
                    a, b = top(comp[u[i]]), top(comp[v[i]])
                    if a != b and similar(sets[u[i]], sets[v[i]], threshold):
                        up[max(a, b)] = min(a, b)
                        us.append(cid[u[i]])
                        vs.append(cid[v[i]])
            yield pa.record_batch({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(trimmed(run), "u long, v long")


def similar(p: np.ndarray, q: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets have the similarity."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return False
    common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return common >= threshold * (len(p) + len(q) - common)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, bitmap_bits: int = 1 << 26, slack: float = SLACK) -> DataFrame:
    """id, n_shingles, component_id, kept, set_key (equal for texts with equal sets) and text_hash for every row.

    With a slack of 2 no pair of a bucket is dropped by its estimate (which may be below zero): all of them are compared on the full sets.
    """
    ship(docs.sparkSession)
    signed = written(signatures(docs, id_col, text_col, words), "signatures")
    files = few_files(docs, signed)
    classes = signed.where("n > 0").groupBy("set_a", "set_b").agg(F.min(F.struct("rid", "doc_id", "th", "n", "sig", "bands")).alias("r"), F.min("doc_id").alias("first_id"))
    reps = written(classes.select("set_a", "set_b", "first_id", F.col("r.rid").alias("cid"), "r.doc_id", "r.th", "r.n", "r.sig", "r.bands"), "classes", files)
    keyed = reps.select(F.explode("bands").alias("key"), "cid")
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = written(keyed.join(full, "key"), "members", files)
    # The head of a bucket is the member that meets most others in all its buckets: of edited copies, mostly their source.
    weights = members.groupBy("cid").agg(F.sum("k").alias("w"))
    weighted = members.select("key", "cid").join(weights, "cid")
    heads = weighted.groupBy("key").agg(F.max(F.struct("w", "cid"))["cid"].alias("head"))
    pairs = members.select("key", "cid").join(heads, "key").where("cid <> head").select(F.col("head").alias("u"), F.col("cid").alias("v")).distinct()
    comps = components(confirmed(pairs, reps, docs, id_col, text_col, words, threshold, bitmap_bits, slack, files), files)
    open_ = apart(members.select("key", "cid"), reps, comps, threshold, slack)
    open_ = written(open_.repartition(files) if files else open_, "apart")
    if open_.limit(1).count():
        needed = written(reps.select("cid", "doc_id", "th").join(open_.select("cid").distinct(), "cid"), "needed", files)
        sets = written(shared_sets(docs, needed, id_col, text_col, words, bitmap_bits), "sets", files)
        comps = joined(comps, written(links_across(open_, sets, threshold, slack).distinct(), "links", files), files)
    named = reps.select("cid", "first_id").join(comps, "cid").groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_class = comps.join(named, "comp").select("cid", "component_id")
    sets = reps.select("set_a", "set_b", "cid", "first_id").join(of_class, "cid", "left").select("set_a", "set_b", F.coalesce("component_id", "first_id").alias("component_id"))
    out = signed.select("doc_id", "th", "n", "set_a", "set_b").join(sets, ["set_a", "set_b"], "left")
    of_row = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), of_row.alias("component_id"), F.col("doc_id").eqNullSafe(of_row).alias("kept"), F.when(F.col("n") > 0, F.concat_ws(":", "set_a", "set_b")).alias("set_key"), F.col("th").alias("text_hash"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without near duplicates: one of each component, and all rows without words."""
    found = near_duplicates(docs, id_col, text_col, **options).select(F.col(id_col).cast("long").alias("_i"), "text_hash", "component_id", "set_key", "kept")
    found = written(found, "components", few_files(docs))
    first = found.where("kept and set_key is not null").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("set_key")).alias("_set")).agg(F.min(F.struct("text_hash", "_i")).alias("_m"))
    stay = first.select(F.col("_m._i").alias("_i"), F.col("_m.text_hash").alias("_t"), F.lit(True).alias("_words"))
    empty = found.where("set_key is null").select("_i", F.col("text_hash").alias("_t"), F.lit(False).alias("_words")).distinct()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_th"))
    stay = stay.union(empty)
    kept = rows.join(stay, rows["_id"].eqNullSafe(stay["_i"]) & (rows["_th"] == stay["_t"]))
    # Rows repeated as they are make one group too; only then is another pass over the rows needed.
    if found.where("set_key is not null").groupBy("_i", "text_hash").count().where("count > 1").limit(1).count():
        kept = kept.where("_words").dropDuplicates(["_id", "_th"]).unionByName(kept.where("not _words"))
    return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""
