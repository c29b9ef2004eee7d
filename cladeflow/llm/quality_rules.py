"""Quality rules: counts of words, symbols and repetition, and lines that too many documents of a host share.

DataFrame functions only. The counts of a document come from its own row. For shared lines, each
document's lines are normalised (lower case, blanks to one space, trimmed) and hashed, and the distinct
documents of a host that have a line are counted; a document is told by the hash of its whole text, so exact
copies count as one (finding them is the task of near-duplicate detection). Lines in more than
`limit_docs` distinct documents of a host are removed, however many the host holds. A document that loses more
than `depleted` of its words with those lines is rejected; `clean_text` is its text without those lines, all
else in it unchanged.

Each text is read once, for its counts and its line hashes (with their words), which are written to the shared
folder. Everything else joins and adds these numbers: no text is shuffled for the verdicts. A line that a third
of all documents share is spread over the tasks by document before it is counted, and the few lines above the
limit meet the others in a join that Spark can split. Only `keep_good` and `quality_rules`, which give texts
back, join verdicts to the rows.

Defined cases: null text has no words and fails the base rules; a null host is a host of its own; repeated
rows are copies and share a verdict; near copies are documents of their own; an empty table gives none; other columns pass through
where their names do not clash with the new ones, which replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.session import table, written

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")
CLEAN = "clean_text"


def line_hash(line: Column) -> Column:
    """60 bits of the MD5 of a line, as a long."""
    return F.conv(F.substring(F.md5(F.encode(line, "UTF-8")), 1, 15), 16, 10).cast("long")


def repeated_words(hashes: Column, sorted_windows: Column) -> Column:
    """Words inside 3-word windows found twice or more: sorted_windows is [(hash of window, position)]."""
    twice = F.filter(
        sorted_windows,
        lambda x, i: F.coalesce(x["h"] == F.get(sorted_windows, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(sorted_windows, i + 1)["h"], F.lit(False)),
    )
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))).cast("long")


def counts(docs: DataFrame, text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """`extra` columns of docs with the counts of its texts."""
    keep = extra or []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    a = docs.select(*keep, text.alias("_t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    b = a.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_t", NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    windows = F.when(F.size("_h") >= 3, F.transform(F.sequence(F.lit(0), F.size("_h") - 3), lambda i: F.struct(F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)).alias("h"), i.alias("p"))))
    c = b.select(*keep, "n_words", "word_chars", "n_symbols", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.sort_array(windows).alias("_s"))
    return c.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(F.when(F.col("_s").isNotNull(), repeated_words(F.col("_s"), F.col("_s"))), F.lit(0)).cast("long").alias("n_repeat_words"))


def measured(docs: DataFrame, ident: list[Column], host: Column, text: Column) -> DataFrame:
    """A written table with a row per row of docs: rid, _id, _k, _host, the text's hash _th, its counts, and its
    normalised lines as an array of (hash, words)."""
    plain = F.filter(F.transform(F.split(F.lower(F.coalesce("_text", F.lit(""))), "\n", -1), lambda x: F.trim(F.regexp_replace(x, BLANKS, " "))), lambda x: x != "")
    lines = F.transform(plain, lambda x: F.struct(line_hash(x).alias("h"), F.size(F.split(x, " ")).alias("n")))
    rows = docs.select(*ident, host.alias("_host"), text.alias("_text"))
    rows = rows.select("_id", "_k", "_host", "_text", F.coalesce(line_hash(F.col("_text")), F.lit(-1)).alias("_th"), lines.alias("_lines"))
    stats = counts(rows, "_text", ["_id", "_k", "_host", "_th", "_lines"])
    return written(stats.withColumn("rid", F.monotonically_increasing_id()), "measured")


def shared_lines(rows: DataFrame, limit_docs: int) -> DataFrame:
    """(_host, h) of the lines that more than limit_docs distinct documents of a host have."""
    lines = rows.select("_host", "_th", F.explode("_lines.h").alias("h"))
    return lines.groupBy("_host", "h").agg(F.countDistinct("_th").alias("docs")).where(F.col("docs") > limit_docs).select("_host", "h")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit_docs: int = 10, depleted: float = 0.5, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """_id, _k (a hash of host and text), the columns NEW and the removed lines `_gone` (null for none) of every row."""
    text = F.col(text_col).cast("string")
    rows = measured(docs, [F.col(id_col).alias("_id"), row_key(text_col, host_col).alias("_k")], F.col(host_col), text)
    shared = shared_lines(rows, limit_docs).withColumnsRenamed({"_host": "_on", "h": "_line"})
    lines = rows.select("rid", "_host", F.explode("_lines").alias("x")).select("rid", "_host", "x.h", "x.n")
    hit = lines.join(shared, F.col("_host").eqNullSafe(F.col("_on")) & (F.col("h") == F.col("_line")))
    hit = hit.groupBy("rid").agg(F.sum("n").cast("long").alias("removed_words"), F.collect_set("h").alias("_gone"))
    both = rows.drop("_lines", "_host", "_th").join(hit, "rid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * F.lit(max_repeat))
    lost = F.col("removed_words") > F.col("n_words") * F.lit(depleted)
    return both.select("_id", "_k", *NEW[:6], failed.alias("base_failed"), (~(failed | lost)).alias("kept"), "_gone")


def row_key(text_col: str, host_col: str) -> Column:
    """With the id it tells rows apart that differ in what the rules look at; of null text and empty text the verdict is the same."""
    return F.xxhash64(F.col(host_col), F.col(text_col).cast("string"))


def without(text: Column, gone: Column) -> Column:
    """text without the lines whose hashes are in `gone`."""
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), BLANKS, " "))
    left = F.filter(F.split(text, "\n", -1), lambda x: (norm(x) == "") | ~F.array_contains(gone, line_hash(norm(x))))
    return F.when(gone.isNotNull(), F.array_join(left, "\n")).otherwise(text)


def beside(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Every row as a struct `_row`, with the columns of verdicts (_id, _k and others) for it, or nulls."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(row, F.col(id_col).alias("_id1"), row_key(text_col, host_col).alias("_k1"))
    return rows.join(verdicts, F.col("_id1").eqNullSafe(F.col("_id")) & (F.col("_k1") == F.col("_k")), "left")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """docs with the columns NEW and CLEAN; a column of docs by one of these names is replaced."""
    verdicts = written(judged(docs, id_col, text_col, host_col, **options), "verdicts").dropDuplicates(["_id", "_k"])
    rows = beside(docs, verdicts, id_col, text_col, host_col)
    clean = without(F.col("_row")[text_col].cast("string"), F.col("_gone")).alias(CLEAN)
    return rows.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in (*NEW, CLEAN)), *NEW, clean)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", files: int | None = None, **options) -> DataFrame:
    """The rows of docs that the rules keep, without the lines above the limit; n_chars is brought up to date where lines went.

    Only the verdicts of rows that go or lose lines are joined to the rows; they are written as at most `files` files.
    """
    verdicts = written(judged(docs, id_col, text_col, host_col, **options).where("not kept or _gone is not null").select("_id", "_k", "kept", "_gone"), "verdicts", files)
    rows = beside(docs, verdicts.dropDuplicates(["_id", "_k"]), id_col, text_col, host_col).where("coalesce(kept, true)")
    kind = dict(docs.dtypes)
    own = F.col("_row")[text_col]
    new = {text_col: F.when(F.col("_gone").isNotNull(), without(own.cast("string"), F.col("_gone")).cast(kind[text_col])).otherwise(own)}
    rows = rows.select("_row", "_gone", new[text_col].alias("_new"))
    new = {text_col: F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_gone").isNotNull(), F.char_length("_new").cast(kind["n_chars"])).otherwise(F.col("_row")["n_chars"])
    return rows.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: counts and verdict of every document."""
    return judged(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(F.col("_id").alias("doc_id"), *NEW)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, md5(text) AS th FROM documents
), w AS (
  SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT rid, p, ws[p] || chr(1) || ws[p + 1] || chr(1) || ws[p + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)
), rep AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n >= 2
), cover AS (
  SELECT rid, count(DISTINCT p + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), lines AS (
  SELECT rid, th, source, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS x
  FROM (SELECT rid, th, source, unnest(string_split(t, chr(10))) AS line FROM d)
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE x <> '' GROUP BY rid
), hashed AS (
  SELECT rid, th, source, ('0x' || substr(md5(x), 1, 15))::BIGINT AS h, len(string_split(x, ' ')) AS n FROM lines WHERE x <> ''
), shared AS (
  SELECT source, h FROM hashed GROUP BY source, h HAVING count(DISTINCT th) > 10
), gone AS (
  SELECT rid, sum(n) AS n FROM hashed JOIN shared ON hashed.h = shared.h AND hashed.source IS NOT DISTINCT FROM shared.source GROUP BY rid
), s AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(cover.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * removed_words <= n_words AS kept
FROM s
"""
