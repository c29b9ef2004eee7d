"""BPE encoding and decoding with a tokenization automaton compiled from the merges.

The automaton reads tokens: its paths are exactly the token sequences that BPE can produce. It starts
as one state with an arc for every base symbol and takes one gadget per merge (a, b) -> c, in order of
rank: the a-arcs lead to a new copy of their target that lacks the b-arc, and every state with an a-arc
gets a c-arc to where b led. All arcs of a token so lead to one state, and a state is known by that token.
States are stored as what they differ in: the state that they were copied from, the rank at which, and the arcs
that they lost since, each with its rank (a state that lost the a-arc never gets the c-arc, and has it among the lost
ones too). For 49,000 merges these are 49,000 states and a million lost arcs, in three flat tables.

Encoding a word goes through its positions from left to right. The prefix up to a position has one path, so a
position has one state; from there each arc whose label stands in the text is looked up in the state's table,
and where it exists it settles the state of the position behind the label. No position is entered twice and
nothing is taken back: the cost is linear in the length of the word times the number of labels that stand at a position,
whatever the word. The ids are read off along the states from the end. Decoding emits the labels of the arcs.

Text is prepared as the vocabulary file says: special strings are cut out first, then NFC, blanks to one
space, lower case by code point, and words split by the pattern of the file. Files that ask for anything
else (another model, dropout, merges that make one token twice) are refused, not approximated.

Defined cases: null text is empty text, an empty text has no ids and decodes to the empty text; texts are
never cut. Repeated rows, null ids and extra columns pass through.
"""

from __future__ import annotations

import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.session import ship, table, trimmed

CACHED_WORDS = 250_000
NEVER = 1 << 60
UNKNOWN, START = -2, -1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class Automaton:
    """States, arcs and labels.

    State t stands behind token t. `made[t]` is the rank of the merge that makes t (-1 for base symbols), `right[t]` the
    state that it was copied from at that rank (-1 for base symbols: copied from the first state, which never loses an
    arc). The arcs that it lost are `arc[first[t] : first[t + 1]]`, at the ranks `rank[...]`.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.suffix = suffix
        size = max(vocab.values(), default=-1) + 1
        self.labels: list[str | None] = [None] * size
        for s, i in vocab.items():
            self.labels[i] = s
        self.right, self.made = [START] * size, [-1] * size
        lost: list[dict[int, int]] = [{} for _ in range(size)]
        dead = self._compile(vocab, merges, lost)
        self.first = np.cumsum([0, *map(len, lost)])
        self.arc = np.fromiter((v for s in lost for v in s), np.int32, self.first[-1])
        self.rank = np.fromiter((r for s in lost for r in s.values()), np.int32, self.first[-1])
        #: Token by label, for tokens inside a word; -1: a label only begins like this.
        self.inside: dict[str, int] = {}
        #: Token by label, for tokens that end a word, without the suffix.
        self.ending: dict[str, int] = {}
        for s, i in vocab.items():
            ends = bool(suffix) and s.endswith(suffix) and len(s) > len(suffix)
            label = s.removesuffix(suffix) if ends else s
            if i in dead or self.made[i] < 0 and len(label) != 1:
                continue
            if ends or not suffix:
                self.ending[label] = i
            if not ends:
                self.inside[label] = i
            for n in range(1, len(label) + 1):
                self.inside.setdefault(label[:n], -1)
        self._ready()

    def _compile(self, vocab: dict[str, int], merges: list[tuple[str, str]], lost: list[dict[int, int]]) -> set[int]:
        """Applies the gadgets of all merges in order; the tokens that no merge ever makes."""
        losers: list[list[int]] = [[] for _ in lost]  # by arc: the states that lost it
        dead: set[int] = set()
        for rank, (a, b) in enumerate(merges):
            u, v, c = vocab[a], vocab[b], vocab[(a.removesuffix(self.suffix) if self.suffix else a) + b]
            if self.made[c] >= 0:
                raise ValueError(f"token {c} is made by two merges")
            if u in dead or v in dead or not self._had(u, v, lost):
                dead.add(c)  # nothing ever stands there for this merge to join
            # First the loss, then the new arc: of three equal letters the left two join.
            if v not in lost[u]:
                lost[u][v] = rank
                losers[v].append(u)
            self.right[c], self.made[c] = v, rank
            for s in losers[u]:
                lost[s][c] = lost[s][u]
            losers[c] = losers[u][:]
        return dead

    def _had(self, state: int, arc: int, lost: list[dict[int, int]]) -> bool:
        """Whether a state has an arc after the gadgets so far: neither it nor, before it was copied, one that it comes from has lost it."""
        until = NEVER
        while state >= 0:
            if lost[state].get(arc, NEVER) < until:
                return False
            until, state = self.made[state], self.right[state]
        return True

    def _ready(self) -> None:
        self.tables = Tables(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def follows(self, u: int, v: int) -> bool:
        """Whether the state behind token u has a v-arc (at the start u is START)."""
        return not any(lost.get(v, NEVER) < until for lost, until in self.tables[u])

    def encode_word(self, word: str) -> list[int]:
        """The ids of a word of byte symbols, by one state for each position."""
        n = len(word)
        state, begin = [UNKNOWN] * (n + 1), [0] * (n + 1)
        state[0] = START
        inside, tables = self.inside.get, self.tables
        for j in range(n):
            u = state[j]
            if u == UNKNOWN:
                continue
            table = tables[u]
            for i in range(j + 1, n):
                t = inside(word[j:i])
                if t is None:
                    break
                if t >= 0 and state[i] == UNKNOWN:
                    for lost, until in table:
                        if lost.get(t, NEVER) < until:
                            break
                    else:
                        state[i], begin[i] = t, j
            else:
                t = self.ending.get(word[j:])
                if t is not None and state[n] == UNKNOWN and self.follows(u, t):
                    state[n], begin[n] = t, j
        if state[n] == UNKNOWN:
            raise ValueError(f"no path for {word!r}")
        ids, at = [], n
        while at:
            ids.append(state[at])
            at = begin[at]
        return ids[::-1]


class Tables(dict):
    """By state the arcs that it lacks: (lost arcs with their ranks, the rank below which they count) of the state itself and of
    those that it comes from, as far as they lost any. They are laid out from the flat tables when first met."""

    def __init__(self, of: Automaton) -> None:
        self.of, self.own = of, {}
        self[START] = ()

    def __missing__(self, state: int) -> tuple[tuple[dict[int, int], int], ...]:
        of, until, s, found = self.of, NEVER, state, []
        while s >= 0:
            a, b = of.first[s : s + 2].tolist()
            if a < b:
                if s not in self.own:
                    self.own[s] = dict(zip(of.arc[a:b].tolist(), of.rank[a:b].tolist(), strict=True))
                found.append((self.own[s], until))
            until, s = of.made[s], of.right[s]
        self[state] = tuple(found)
        return self[state]


class Tokenizer:
    """Encoder and decoder of one vocabulary file in the JSON format of the tokenizers library."""

    def __init__(self, spec: dict) -> None:
        m = spec["model"]
        plain = m["type"] == "BPE" and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if any(x.get(k) for x in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("this vocabulary file has added tokens that take what stands beside them")
        if not (plain and steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and spec.get("decoder") is None):
            raise ValueError("this vocabulary file asks for steps that are not implemented")
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ", 1)) for x in m["merges"]]
        self.automaton = Automaton(m["vocab"], merges, m.get("end_of_word_suffix") or "")
        self.pattern = pre[0]["pattern"]["Regex"]
        self.blank = spec["normalizer"]["normalizers"][1]["pattern"]["Regex"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._ready()

    def _ready(self) -> None:
        self.words = regex.compile(self.pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        #: Ids of words met lately, and of those met before them.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        top = max([len(self.automaton.labels) - 1, *self.special.values()])
        self.text_of = [(x or "").encode() for x in self.automaton.labels] + [b""] * (top + 1 - len(self.automaton.labels))
        for s, i in self.special.items():
            self.text_of[i] = s.encode()

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("automaton", "pattern", "blank", "special")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _word(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            # Visible ASCII stands for itself.
            s = word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode()))
            ids = self.automaton.encode_word(s)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.cache) >= CACHED_WORDS:
                self.cache, self.older = {}, self.cache
            self.cache[word] = out
        return out

    def _segment(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case by code point knows no final sigma
                text = text.replace("Σ", "σ")
        word = self._word
        return [self.cache.get(w) or word(w) for w in self.words.findall(text.lower())]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or "<|" not in text and not self.cut.search(text):
            return b"".join(self._segment(text))
        out = []
        for piece in self.cut.split(text):
            out += [np.array([self.special[piece]], "<u4").tobytes()] if piece in self.special else self._segment(piece)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs, set apart by spaces, as a file without a decoder has it."""
        return b" ".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()


def load(path: str) -> Tokenizer:
    with open(path, encoding="utf-8") as f:
        return Tokenizer(json.load(f))


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(df: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "token_ids", count_col: str = "n_tokens", decoded_col: str = "decoded") -> DataFrame:
    """df with the packed ids of its texts, their number and the text decoded from them.

    The driver reads and compiles the file and sends the tables (their size is that of the vocabulary)
    to the executors. Columns of df with the names of new ones are replaced.
    """
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(load(path or default_path()))
    new = {ids_col: T.BinaryType(), count_col: T.LongType(), decoded_col: T.StringType()}
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*kept, *(T.StructField(k, t) for k, t in new.items())])
    at = df.columns.index(text_col)

    def run(batches):
        tok = sent.value
        for b in batches:
            ids, decoded = [], []
            for t in b.column(at):
                ids.append(tok.encode(t.as_py() or ""))
                decoded.append(tok.decode(ids[-1]))
            cols = {f.name: b.column(i) for i, f in enumerate(b.schema) if f.name not in new}
            cols |= {ids_col: pa.array(ids, pa.binary()), count_col: pa.array([len(x) // 4 for x in ids], pa.int64()), decoded_col: pa.array(decoded, pa.string())}
            yield pa.record_batch(cols)

    return df.mapInArrow(trimmed(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every whole document encoded and decoded."""
    done = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
