"""The pipeline against a version in plain Python, odd rows through every stage, and queries against their SQL."""

import hashlib
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
import tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from cladeflow import session
from cladeflow.llm import bpe, mixing
from tests.llm.test_corpus_ops import DOCS, brute_components, brute_rules, corpus
from tests.llm.test_text_ops import plain

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def redacted(t):
    out, done = "", 0
    for a, k, b in plain(t):
        if a >= done:
            out += t[done:a] + f"<{('EMAIL', 'IP', 'CARD', 'PHONE')[k]}>"
        done = max(done, b)
    return out + t[done:]


def test_run_against_plain_python(spark):
    got = sorted((r.doc_id, r.lang, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = {x[0] for x in brute_rules(rows) if x[8]}
    rows = [r for r in rows if r[0] in good]
    one = {x[0] for x in brute_components(rows) if x[3] or not x[1]}
    rows = [(r[0], redacted(r[1]), *r[2:4], 0) for r in rows if r[0] in one]
    share = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    ref = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = []
    for i, text, lang, source, _ in rows:
        s = share[i]
        spans = list(re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text))
        for t in [text] * s.copies + ["".join(m[0] for m in spans[p.begin : p.end]) for p in s.parts]:
            ids = ref.encode(t, add_special_tokens=False).ids
            want.append((i, lang, source, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want) and len(got) > 100


def test_stages_on_odd_rows(spark):
    rows = [(*r, i % 2, "k", 1) for i, r in enumerate(corpus(7))]
    docs = spark.createDataFrame(rows, DOCS + ", kept int, set_key string, n_words int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.count() > 0
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert out.count() == docs.count()


def test_few_documents_behind_many_partitions_are_few_files(spark, tmp_path, monkeypatch):
    """Every file has an executor on a local folder start processes; only tables of heavy tasks have a file for each of these."""
    wide = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    spark.read.parquet(f"{SF}/documents.parquet").limit(600).repartition(60).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(session, "_scratch", ["keeps the list from a second exit hook"])
    monkeypatch.setattr(corpus_pipeline, "drop_scratch", lambda *a, **b: None)
    old = {k: spark.conf.get(k) for k in wide}
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        got = corpus_pipeline.run(spark, str(tmp_path)).count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got > 100
    files = {p: len(list(Path(p.removeprefix("file:")).glob("part-*"))) for p in session._scratch[1:]}
    heavy = re.compile("/cladeflow-(measured|signatures|sizes|stage-personal-data|stage-tokens)-")
    few = max(5, spark.sparkContext.defaultParallelism)
    assert len(files) > 20 and all(k <= few for p, k in files.items() if not heavy.search(p)), files


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    mine = sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(clean(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr) and mine
