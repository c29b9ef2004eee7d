"""Language identification by prediction by partial matching over byte contexts.

For each language a tree of byte contexts of up to `order` bytes holds how often each byte followed, from a
sample of at most about `per_language` documents (`in_all` over all languages, of at most `longest` characters each and
about `chars_in_all` together, from the `languages` commonest; whole, and bounded so that the driver can count it). The statistics are then frozen. A byte costs what its longest known context
says; a context that has not seen it costs an escape (method C: distinct followers against all) and passes it
on to the next shorter one, down to an even guess over 256 bytes. A text costs the sum over its bytes, in each
language; the least wins.

Contexts met less than `min_count` times in all languages are left out, so their length varies. The contexts
of all languages make one automaton whose state is the longest known context; its tables give the next
state and the cost of a byte in every language, so a text is scored exactly by walking it. Texts are
walked in pieces side by side: a piece starts `order` bytes early to find its state, which depends on no
more than that.

Defined cases: `und` with score 0 for null texts, texts without letters, and where nothing was learned;
ties go to the language that sorts first; texts are scored whole, rows repeat with their result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.llm.splits import bounded, held_out, may_learn
from cladeflow.session import ship, table, trimmed

PIECE = 128
#: The score saturates with the evidence of so many bytes.
EVIDENCE = 64


def has_letter(text: str) -> bool:
    """Whether a character is a letter; fractions, superscripts, circled and Roman numerals are none."""
    return any(map(str.isalpha, text))


class Model:
    """Tables of the automaton: `after[state, symbol]` and `bits[state * symbols + symbol, language]`."""

    def __init__(self, texts: dict[str, list[str]], order: int = 4, min_count: int = 40) -> None:
        self.order, self.languages = order, sorted(texts)
        if not self.languages:
            return
        raw = {k: ["".join((" ", t.lower())).encode() for t in v] for k, v in texts.items()}
        seen = np.zeros(256, bool)
        for v in raw.values():
            for t in v:
                seen[np.unique(np.frombuffer(t, np.uint8))] = True
        known = np.flatnonzero(seen)
        self.other, self.reset, self.symbols = len(known), len(known) + 1, len(known) + 2
        table = np.full(256, self.other, np.uint8)
        table[known] = np.arange(len(known))
        self.table = table.tobytes()
        grams = {k: self._grams(v) for k, v in raw.items()}
        self._build(grams, min_count)

    def _grams(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length 1 .. order + 1 the byte strings found, as numbers, and how often; none spans two texts."""
        gap = bytes([self.reset]) * (self.order + 1)
        buf = np.frombuffer(gap.join(t.translate(self.table) for t in texts), np.uint8).astype(np.int64)
        out, key, clean = [], buf.copy(), buf != self.reset
        for n in range(1, self.order + 2):
            if n > 1:
                key = key[:-1] * self.symbols + buf[n - 1 :]
                clean = clean[:-1] & (buf[n - 1 :] != self.reset)
            out.append(np.unique(key[clean], return_counts=True))
        return out

    def _build(self, grams: dict, min_count: int) -> None:
        s, n_lang = self.symbols, len(self.languages)
        #: Contexts by length, sorted. Whatever begins or ends a context is as frequent, so it is one too.
        contexts = [np.zeros(1, np.int64)]
        for length in range(1, self.order + 1):
            keys, at = np.unique(np.concatenate([grams[k][length - 1][0] for k in self.languages]), return_inverse=True)
            many = np.concatenate([grams[k][length - 1][1] for k in self.languages])
            contexts.append(keys[np.bincount(at, many, len(keys)) >= min_count])
        base = np.cumsum([0, *(len(c) for c in contexts)])
        after: list[np.ndarray] = []
        bits: list[np.ndarray] = []
        for length, own in enumerate(contexts):
            if length:  # what a context has not seen goes on as from the one without its first byte
                up = np.searchsorted(contexts[length - 1], own % s ** (length - 1))
                then, cost = after[-1][up].copy(), bits[-1][up].copy()
            else:
                then, cost = np.zeros((1, s), np.int32), np.full((1, s, n_lang), 8.0)
            if length < self.order:
                longer = contexts[length + 1]
                then[np.searchsorted(own, longer // s), longer % s] = base[length + 1] + np.arange(len(longer))
            for i, k in enumerate(self.languages):
                gram, count = grams[k][length]
                at = np.searchsorted(own, gram // s)
                fits = own[np.minimum(at, len(own) - 1)] == gram // s if len(own) else np.zeros(len(gram), bool)
                at, sym, count = at[fits], gram[fits] % s, count[fits]
                n, d = np.bincount(at, count, len(own)), np.bincount(at, minlength=len(own))
                escape = np.log2(np.maximum(n + d, 1) / np.maximum(d, 1))
                cost[:, :, i] += escape[:, None]
                cost[at, sym, i] = np.log2((n + d)[at] / count)
            after.append(then)
            bits.append(cost)
        then, cost = np.concatenate(after), np.concatenate(bits)
        then[:, self.reset] = 0
        cost[:, self.reset, :] = 0.0
        self.after = then.reshape(-1)
        self.bits = cost.reshape(-1, n_lang).astype(np.float32)

    def code_lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits for each text and language, bytes of each text)."""
        coded = [t.lower().encode("utf-8", "surrogatepass").translate(self.table) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        pieces = -(-sizes // PIECE)
        out = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), pieces)
        pad = bytes([self.reset])
        warm, step = self.order, PIECE
        buf = np.frombuffer(b"".join(pad * warm + c + pad * int(p * step - n) for c, n, p in zip(coded, sizes, pieces, strict=True) if p), np.uint8)
        first = np.concatenate([np.arange(p) * step for p in pieces.tolist()] or [np.zeros(0, np.int64)]).astype(np.int64)
        begin = np.cumsum(np.where(pieces > 0, pieces * step + warm, 0)) - np.where(pieces > 0, pieces * step + warm, 0)
        first += begin[owner]
        for i in range(0, len(first), 8192):
            own = first[i : i + 8192]
            cols = np.lib.stride_tricks.sliding_window_view(buf, warm + step)[own].T.astype(np.int32)
            state = np.zeros(len(own), np.int32)
            sums = np.zeros((len(own), len(self.languages)))
            for t in range(warm + step):
                at = state * self.symbols + cols[t]
                if t >= warm:
                    sums += self.bits.take(at, axis=0)
                state = self.after.take(at)
            np.add.at(out, owner[i : i + 8192], sums)
        return out, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        if todo:
            bits, sizes = self.code_lengths([texts[i] for i in todo])
            best = bits.argmin(axis=1)
            rate = bits / sizes[:, None] * np.minimum(sizes, EVIDENCE)[:, None]
            odds = np.exp2(rate.min(axis=1, keepdims=True) - rate)
            share = odds.max(axis=1) / odds.sum(axis=1)
            for i, b, p in zip(todo, best.tolist(), share.tolist(), strict=True):
                langs[i], scores[i] = self.languages[b], p
        return langs, scores


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, in_all: int = 8000, longest: int = 1 << 16, chars_in_all: int = 32 << 20, languages: int = 1000, **options) -> Model:
    """Statistics from a bounded sample of the rows that may be learned from: the driver gets about `chars_in_all` characters at most."""
    rows = docs.where(may_learn(id_col)).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.where(F.col("l").isNotNull() & (F.char_length("t") <= longest) & F.col("t").rlike(r"\p{L}"))
    rows = rows.withColumn("n", F.char_length("t"))
    texts: dict[str, list[str]] = {}
    for r in sorted(bounded(rows, "l", "i", per_language, in_all, "n", chars_in_all, languages).select("l", "i", "t").collect()):
        texts.setdefault(r["l"], []).append(r["t"])
    return Model(texts, **options)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        m = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                langs, scores = m.predict(part.column(2).to_pylist())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(trimmed(run), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: language of every whole document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
