"""Exact top-k against brute force; WARC archives there and back."""

import gzip
import io
import random
import zlib

import pytest

from cladeflow.llm import topk, warc

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    import math

    q = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            import numpy as np

            q.append((i, [max(-(2**63), min(2**63, math.floor(1024.0 * float(np.float32(x))))) for x in v]))
    out = set()
    for i, v in {i: v for i, v in sorted(q, reverse=True)}.items():
        if i % every == 0:
            best = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j) for j, w in q if j != i and len(w) == len(v))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("values", ["small", "ties", "huge"])
def test_top_k(spark, values):
    r = random.Random(1)
    draw = {"small": lambda: r.uniform(-1, 1), "ties": lambda: r.choice([0.0, 0.5]), "huge": lambda: r.uniform(-1, 1) * 10 ** r.randint(0, 30)}[values]
    rows = [(i, [draw() for _ in range(5)], 0) for i in range(150)]
    rows += [(150 + i, [0.5] * 5, 0) for i in range(60)] + [(7, [0.5] * 5, 0)]
    rows += [(None, [1.0] * 5, 0), (300, None, 0), (400, [1.0, None, 1.0, 1.0, 1.0], 0), (500, [float("nan")] * 5, 0), (600, [float("inf")] * 5, 0), (700, [1.0, 2.0], 0), (701, [1.0, 3.0], 0), (800, [], 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = topk.top_k(df.where("vec_id % 10 = 0"), df, k=10, block=7, bins=16)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    rowset = got.collect()
    assert {tuple(x) for x in rowset} == brute(rows, 10, 10)
    assert len(rowset) == len({(x.query_id, x["rank"]) for x in rowset})


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 0, "x", 1), (1, [2.0], 0, "y", 2)], VECTORS + ", score string, rank int")
    assert [tuple(x) for x in topk.top_k(df.where("vec_id = 0"), df).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_k(df.limit(0), df).count() == topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_unusable_rows_do_not_stand_for_their_id(spark):
    rows = [(100, [None, 1.0], 0), (100, [0.5, 0.5], 0), (200, [float("-inf"), 0.0], 0), (200, [1.0, 0.0], 0), (200, [2.0, 0.0], 0), (1, [1.0, 1.0], 0), (300, [float("nan")] * 2, 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {tuple(x) for x in topk.top_k(df.where("vec_id % 100 = 0"), df, k=3).collect()}
    assert got == brute(rows, 3, 100) and {x[0] for x in got} == {100, 200}


def test_top_k_over_many_pages(spark):
    r = random.Random(4)
    rows = [(i, [r.choice((0.0, 0.25, 1.0)) for _ in range(3)], 0) for i in range(60)]
    df = spark.createDataFrame(rows, VECTORS)
    found = topk.top_k(df, df, k=2, block=16)
    assert {tuple(x) for x in found.collect()} == brute(rows, 2, 1)
    assert "Union" not in found._jdf.queryExecution().toString()


PAGES = "page_id long, url string, html string, digest string"


def test_round_trip(spark):
    big = "".join(random.Random(2).choice("abcdefgh<>é") for _ in range(200_000)) * 100  # over 16 MiB
    rows = [(1, "http://a/ b\r\nX: y", "<p>é</p>", "x"), (2, None, None, None), (3, "u", "", None), (4, "u", "<p>é</p>", None), (None, "u", "<p>é</p>", None), (5, "v", big, None), (6, "w", "only", None), (6, "w", "only", None), (None, "n", "no id", None), (None, "n", "no id", None)]
    out = warc.round_trip(spark.createDataFrame(rows, PAGES), archive_bytes=1000).collect()
    assert not [r for r in out if r.error] and len(out) == len(rows)
    assert len({r.archive for r in out}) > 1
    got = sorted((r.source_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, r.payload_digest) for r in out)
    want = []
    for i, kind, to, text in [(0, "revisit", 4, "<p>é</p>"), (0, "response", 0, "no id"), (0, "response", 0, "no id"), (1, "revisit", 4, "<p>é</p>"), (2, "revisit", 3, ""), (3, "response", 0, ""), (4, "response", 0, "<p>é</p>"), (5, "response", 0, big), (6, "response", 0, "only"), (6, "response", 0, "only")]:
        b = text.encode()
        want.append((i, kind, to, len(b), warc.base32_sha1(b)))
    assert got == sorted(want)
    by_id = {r.source_id: r for r in out if r.source_id}
    assert bytes(by_id[5].payload) == big.encode() and by_id[1].url == "http://a/%20b%0D%0AX:%20y"
    assert by_id[1].refers_to_record == by_id[4].record_id


def test_min_bytes_and_empty_table(spark):
    rows = [(1, "u", "ab", None), (2, "u", "ab", None), (3, "u", "abc", None), (4, "u", "abc", None)]
    out = warc.round_trip(spark.createDataFrame(rows, PAGES), min_bytes=3).collect()
    assert {r.source_id: r.record_type for r in out} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def archive(*payloads):
    return b"".join(warc.member(warc.record_bytes(i, "u", p, None, "1970-01-01T00:00:00Z"), 6) for i, p in enumerate(payloads))


def test_archives_are_gzip_members():
    data = archive(b"one", b"x" * (17 << 20), b"")
    assert data[-1] == 0 and gzip.decompress(data).count(b"WARC/1.1\r\n") == 3
    assert [r["payload_bytes"] for r in warc.read_archive(io.BytesIO(data))] == [3, 17 << 20, 0]
    small = [c for _, c in warc.members(io.BytesIO(data), piece=7)]
    assert len(small) == 3


@pytest.mark.parametrize("harm", ["cut", "flip", "digest", "length", "no gzip"])
def test_damage_is_reported(harm):
    data = archive(b"one", b"two two two")
    if harm == "cut":
        data = data[:-5]
    elif harm == "flip":
        data = data[:-20] + bytes([data[-20] ^ 255]) + data[-19:]
    elif harm == "no gzip":
        data += b"rest"
    else:
        record = warc.record_bytes(5, "u", b"three", None, "d")
        record = record.replace(b"three", b"THREE") if harm == "digest" else record.replace(b"Content-Length: 5\r\n\r\nthree", b"Content-Length: 5\r\n\r\nthreethree")
        data += zlib.compress(record, 6, 31)
    rows = list(warc.read_archive(io.BytesIO(data)))
    assert rows[0]["error"] is None and rows[0]["payload"] == b"one"
    assert rows[-1]["error"]
