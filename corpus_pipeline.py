"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's input.

Quality rules drop documents and lines, near-duplicate removal leaves one of each group, personal data is replaced by
its kind, sources are mixed to their target weights (documents repeated, cut or dropped as the mix says), and
what is left is encoded and decoded with a public vocabulary. A stage that ends behind a shuffle writes few files for
few documents, however many partitions the shuffle has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.llm import bpe, mixing, near_dup, pii, quality_rules
from cladeflow.session import drop_scratch, few_files, merged, scratch_mark, table, written


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars brought up to date where the documents have it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above the limit."""
    files = few_files(docs)
    return merged(quality_rules.keep_good(docs, files=files), files)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return merged(near_dup.keep_one(docs), few_files(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data, plain or disguised, replaced by its kind."""
    return _counted(pii.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use that the mix makes of a document."""
    return merged(mixing.materialise(docs), few_files(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row, with the digests that show the round trip."""
    done = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"))
    return done.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mixing", mix),
    ("tokens", tokens),
]

#: Deobfuscation and the tokenization automaton are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        drop_scratch(spark, since=mark, last=1)  # this stage's output is all that the next one reads
    return docs
