"""Quality classifier from trusted positives and unlabelled text (non-negative PU learning).

A text is described by measures of its form (lengths, shares of character kinds, repetition of words, lines
and word windows), each cut into bins at quantiles of the unlabelled sample. The model adds a weight for
each bin. Its risk is the unbiased estimate from positives and unlabelled rows: with class prior p and the
logistic loss, p * risk(positives as 1) + max(0, risk(unlabelled as 0) - p * risk(positives as 0)); where
the bracket turns negative, steps go the other way until it is not (so the model cannot win by driving the
negative risk below zero).

The class prior is estimated from the positives and the unlabelled rows alone; labels of 0 are never looked at, so
it does not matter which share of either class was labelled. A model that tells positives from unlabelled
rows is fitted on one half of both and scores the other. Above a threshold stand q_p of the positives and q_u of the
unlabelled rows; positives among these stand there alike, so q_u / q_p is the prior or more at every threshold, and comes close
to it where only positives score so high. The ratio is taken where it is least once the chance errors of both tails
are added; the halves change places and the two estimates are averaged. `PUModel.prior` reports it. It assumes that
positives were labelled whatever their text; without positives it is `default_prior`.

Fitting uses at most about `most_positive` positives and `most_unlabelled` documents (the vectors of
measures go to the driver, not the texts). Scoring is by the logistic function, an estimate of the
probability of label 1.

Defined cases: null text is empty text and is scored like one; a feature without spread has one bin;
where there are no positives at all every score is the default prior; labels of other values than 1 are no
positives; repeated rows have equal scores.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.llm.splits import held_out, may_learn
from cladeflow.session import ship, table, trimmed

KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".", "comma": b",", "loud": b"!?", "bar": b"|", "mark": b"#*$%&<>=~^_\\/", "quote": b"'\"()[]{}-:;", "at": b"@+"}
CLASS = np.full(256, len(KINDS), np.uint8)
for _i, _chars in enumerate(KINDS.values()):
    CLASS[np.frombuffer(_chars, np.uint8)] = _i
FEATURES = [*KINDS, "other", "log_words", "word_length", "distinct_words", "top_word", "distinct_lines", "line_words", "repeated_windows", "one_char_words", "capital_words", "stop_words_end", "longest_word", "entropy"]


def measures(text: str | None) -> list[float]:
    """The numbers that describe a whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(CLASS, count, len(KINDS) + 1) / max(1, n)
    words = raw.split()
    k = len(words)
    if not k:
        return [*shares.tolist(), *[0.0] * (len(FEATURES) - len(shares))]
    often = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    p = count[count > 0] / n
    sizes = list(map(len, words))
    return [
        *shares.tolist(),
        math.log1p(k),
        sum(sizes) / k,
        len(often) / k**0.9,
        max(often.values()) / k,
        len(set(lines)) / len(lines),
        math.log1p(k / len(lines)),
        1 - len(set(windows)) / len(windows) if windows else 0.0,
        sizes.count(1) / k,
        sum(map(bytes.istitle, words)) / k,
        sum(map(_ends, words)) / k,
        math.log1p(max(sizes)),
        float(-(p * np.log2(p)).sum()),
    ]


def _ends(word: bytes) -> bool:
    return word[-1] in b".,;:!?"


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1, **options) -> float:
    """The share of positives among the unlabelled rows, by the least ratio of the tails of their scores (chance of a tail's error: `sure`)."""
    found = []
    for part in (0, 1):
        own, other = (lambda x: x[part::2]), (lambda x: x[1 - part :: 2])
        p, u = other(positives), other(unlabelled)
        if not len(own(positives)) or not len(own(unlabelled)) or not len(p) or not len(u):
            continue
        model = PUModel(own(positives), own(unlabelled), 0.5, against_unlabelled=True, **options)
        p, u = np.sort(model.score(p)), np.sort(model.score(u))
        at = np.unique(p)
        q_p, q_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
        error = math.sqrt(math.log(4 / sure) / 2) * (1 / math.sqrt(len(p)) + 1 / math.sqrt(len(u)))
        best = ((q_u + error) / q_p).argmin()
        found.append(q_u[best] / q_p[best])
    return min(0.99, max(0.01, sum(found) / len(found))) if found else 0.5


class PUModel:
    """Bins, weights and bias; `prior` is the class prior used.

    against_unlabelled: no PU risk but the plain one that tells positives from unlabelled rows, each class counting alike.
    """

    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = 12, steps: int = 300, rate: float = 0.05, decay: float = 1e-4, against_unlabelled: bool = False) -> None:
        self.prior, self.plain = prior, against_unlabelled
        d = len(FEATURES)
        self.edges = [self._edges(unlabelled[:, j], bins) for j in range(d)]
        self.starts = np.cumsum([0, *(len(e) + 1 for e in self.edges)])
        self.weights, self.bias = np.zeros(self.starts[-1]), math.log(prior / (1 - prior))
        if len(positives) and len(unlabelled):
            self._fit(self._slots(positives), self._slots(unlabelled), steps, rate, decay)

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> np.ndarray:
        """Quantiles of a measure, and of its values apart from the commonest one (a rare mark is a bin of its own)."""
        if not len(x):
            return np.zeros(0)
        at = np.linspace(0, 1, bins + 1)[1:-1]
        values, count = np.unique(x, return_counts=True)
        common = values[count.argmax()]
        rest = x[x != common]
        edges = [np.quantile(x, at)]
        if len(rest):
            edges += [np.quantile(rest, at), [common, np.nextafter(common, np.inf)]]
        return np.unique(np.concatenate(edges))

    def _slots(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") + self.starts[j] for j, e in enumerate(self.edges)], axis=1)

    def risk(self, pos: np.ndarray, unl: np.ndarray) -> tuple[float, np.ndarray]:
        """The risk of slots of both kinds, and the step to take against it (weights, then the bias): its gradient, or,
        where the estimated risk on negatives is below zero, what raises that again."""
        size, prior = len(self.weights), self.prior
        fp, fu = (self.weights[s].sum(axis=1) + self.bias for s in (pos, unl))
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))

        def gradient(slots: np.ndarray, of_score: np.ndarray) -> np.ndarray:
            g = np.bincount(slots.ravel(), np.repeat(of_score, slots.shape[1]), size)
            return np.append(g, of_score.sum())

        positive = prior * np.logaddexp(0, -fp).mean()
        of_positive = gradient(pos, -prior * (1 - sp) / len(pos))
        if self.plain:
            return positive + (1 - prior) * np.logaddexp(0, fu).mean(), of_positive + gradient(unl, (1 - prior) * su / len(unl))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        of_negative = gradient(unl, su / len(unl)) - gradient(pos, prior * sp / len(pos))
        return positive + max(0.0, negative), of_positive + of_negative if negative >= 0 else -of_negative

    def _fit(self, pos: np.ndarray, unl: np.ndarray, steps: int, rate: float, decay: float) -> None:
        mean, spread = np.zeros(len(self.weights) + 1), np.zeros(len(self.weights) + 1)
        for step in range(1, steps + 1):
            _, g = self.risk(pos, unl)
            g[:-1] += decay * self.weights
            mean = 0.9 * mean + 0.1 * g
            spread = 0.999 * spread + 0.001 * g * g
            move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
            self.weights -= move[:-1]
            self.bias -= move[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = self.weights[self._slots(x)].sum(axis=1) + self.bias if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def _measured(rows: DataFrame) -> np.ndarray:
    """Measures of the texts in the only column of rows, to the driver (a few dozen numbers a row)."""

    def run(batches):
        for b in batches:
            yield pa.record_batch({"m": pa.array([measures(t.as_py()) for t in b.column(0)], pa.list_(pa.float64()))})

    got = rows.mapInArrow(trimmed(run), "m array<double>").toArrow().column("m").combine_chunks()
    x = got.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return x[np.lexsort(x.T)]  # the order of rows does not count


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_positive: int = 6000, most_unlabelled: int = 12000, default_prior: float = 0.8, **options) -> PUModel:
    """The model from labelled and unlabelled rows that may be learned from."""
    ship(docs.sparkSession)
    known = labels.where(may_learn(id_col) & (F.col(label_col) == 1)).select(F.col(id_col).alias("_i")).distinct()
    good = known.count()
    rows = docs.where(may_learn(id_col)).select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_t"))
    u = F.pmod(F.xxhash64(F.lit("quality"), F.col("_i")), F.lit(1 << 30)) / float(1 << 30)
    trusted = known.where(u < min(1.0, most_positive / max(1, good)))
    all_docs = rows.count()
    unlabelled = rows.where(F.pmod(F.xxhash64(F.lit("unlabelled"), F.col("_i")), F.lit(1 << 30)) / float(1 << 30) < min(1.0, most_unlabelled / max(1, all_docs)))
    pos = _measured(rows.join(trusted, "_i", "left_semi").select("_t")) if good else np.zeros((0, len(FEATURES)))
    unl = _measured(unlabelled.select("_t"))
    return PUModel(pos, unl, estimated_prior(pos, unl, **options) if len(pos) and len(unl) else default_prior, **options)


def classify(docs: DataFrame, model: PUModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, held_out, score and predicted of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        m = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                x = np.array([measures(t.as_py()) for t in part.column(2)]).reshape(-1, len(FEATURES))
                s = m.score(x)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    return rows.mapInArrow(trimmed(run), f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: quality of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
