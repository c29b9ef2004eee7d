"""Personal data, BPE, language, quality and main text."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import tokenizers

from cladeflow.llm import bpe, html_text, language_id, pii, quality_model, splits

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def plain(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        odd = [int(x) for x in d[::-1]]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(odd)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_plain_spans_against_the_patterns():
    r = random.Random(3)
    parts = ["@", ".", "a", "b", "-", "+", "1", "2", "255", "4", "0", " ", "(", ")", "%", "é", "\n", "4111111111111111", "5500 0000-0000 0004", "1.2.3.4", "x@y.z", "+1 (212) 555-0199"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert [s[:3] for s in pii.find_spans(t) if s[3]] == plain(t), t


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("john at example dot com.", "email", "john at example dot com"),
        ("34 AT mail7 DOT example DOT com", "email", "34 AT mail7 DOT example DOT com"),
        ("john&#64;example.com", "email", "john&#64;example.com"),
        ("x ｊohn＠example．com y", "email", "ｊohn＠example．com"),
        ("see jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("john @ example . com yes", "email", "john @ example . com"),
        ("call plus one two one two five five five zero one nine nine", "phone", "plus one two one two five five five zero one nine nine"),
        ("four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
        ("at 192 dot 168 dot 1 dot 12 x", "ip", "192 dot 168 dot 1 dot 12"),
        ("call +1 (one three two) five five five-1352.", "phone", "+1 (one three two) five five five-1352"),
        ("plus one double two one, (five five five) oh one nine nine", "phone", "plus one double two one, (five five five) oh one nine nine"),
        ("card ٤١١١ ١١١١ ١١١١ ١١١١ ok", "card", "٤١١١ ١١١١ ١١١١ ١١١١"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    found = [(pii.KINDS[k], text[a:b], p) for a, k, b, p in pii.find_spans(text)]
    assert found == [(kind, span, False)]


AT_FORMS = (" [at] ", "(at)", " at ", "&#64;", "%40", "_at_", " @ ", "@", " (@) ", " {AT} ")
DOT_FORMS = (" [dot] ", "[dot]", "(dot)", " dot ", "&#46;", "_dot_", ".", " . ", "[.]", " DOT ")


def brute_disguised(text):
    """Every choice of begin, signs and end is tried: the first "at" that makes an address takes the longest one around it."""
    at = "|".join(map(re.escape, sorted(AT_FORMS, key=len, reverse=True)))
    dot = "|".join(map(re.escape, sorted(DOT_FORMS, key=len, reverse=True)))
    local, label = "[A-Za-z0-9_%+-]+", "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    m = re.search(rf"(?<![A-Za-z0-9._%+-])({local}(?:(?:{dot}){local})*)({at})({label}(?:(?:{dot}){label})+)", text, re.I)
    return m and (m.start(), m.end(), m[1], m[2], m[3])


def test_disguised_addresses_against_brute_force():
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcxyz019") for _ in range(r.choice((1, 2, 5, 40, 300))))
    for _ in range(3000):
        local = word() + "".join(r.choice(DOT_FORMS) + word() for _ in range(r.choice((0, 0, 1, 2, 7, 30))))
        domain = word() + "".join(r.choice(DOT_FORMS) + word() for _ in range(r.choice((0, 1, 1, 2, 6)))) + r.choice((".com", " dot com", "[dot]org", "&#46;net", ""))
        sign = r.choice(AT_FORMS)
        address = local + sign + domain
        text = f"<< {address} >>" if r.random() < 0.5 else f"{address}\n{word()}"
        got = [(a, b) for a, k, b, p in pii.find_spans(text) if k == 0 and not p]
        want = brute_disguised(text)
        if want is None:
            assert not got, text
            continue
        a, b, _, own, after = want
        strong = own.strip() == "@" or own.strip(" ").lower() not in ("at",)
        disguised_after = re.search(r"dot|&#46;|\[\.\]| \. ", after, re.I)
        ending = after.rsplit(".", 1)[-1].lower() in pii.ENDINGS and not re.search(r"(dot|\]|;)\W*$", after[: after.rfind(".") + 1], re.I)
        plain_only = re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", text[a:b]) is not None
        if not plain_only and (strong or disguised_after or ending):
            assert got == [(a, b)], (text, text[a:b], [text[x:y] for x, y in got])
        else:
            assert not got, text


def test_long_disguised_addresses():
    local = "x" * 5000
    parts = " [dot] ".join(f"p{i}" for i in range(51))
    for address in (f"{local} [at] example [dot] com", f"{parts} [at] example [dot] com", f"{local} at {' dot '.join(f'd{i}' for i in range(400))}"):
        assert [(a, b) for a, _, b, _ in pii.find_spans(f"write {address}\n.")] == [(6, 6 + len(address))]


@pytest.mark.parametrize("unit", ["a [dot] b [at] example [dot] com, tel plus one two one two five five five zero one nine nine; ", "-at-", "_at_x", "x at ", " . ", "[at] ", "a.b", "one, ", "      [", "&#64;a ", "1 dot "])
def test_long_texts_take_linear_time(unit):
    import time

    took = []
    for size in (250_000, 1_000_000):
        text = unit * (size // len(unit))
        t = time.perf_counter()
        pii.find_spans(text)
        took.append(time.perf_counter() - t)
    assert took[1] < 4 * 2.5 * took[0] + 0.5, took


def test_ten_million_characters_of_disguises():
    line = "name.{} [at] example [dot] com\n"
    text = "".join(line.format(i) for i in range(10_000_000 // len(line)))
    found = pii.find_spans(text)
    assert len(found) == text.count("\n") and text[found[-1][0] : found[-1][2]] == text.rsplit("\n", 2)[1]


def test_half_disguised_address_keeps_its_plain_span():
    text = "jоhn@example.com now"
    assert [(text[a:b], p) for a, _, b, p in pii.find_spans(text)] == [("jоhn@example.com", False), ("hn@example.com", True)]


@pytest.mark.parametrize("text", ["", "Meet at the place. And then dot.", "five, five, five", "He was at home.now", "one two", "un un un un", "@ . @ .", "at dot at dot"])
def test_clean_text_has_no_spans(text):
    assert pii.find_spans(text) == []


def test_pii_frames(spark):
    long = "word " * 200_000 + "a@b.cc"
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "x a@b.cc, +1 (212) 555-0199 y", None, "s", 1), (3, "x a@b.cc, +1 (212) 555-0199 y", None, "s", 1), (None, long, "en", "s", 2)]
    df = spark.createDataFrame([(*r, "old") for r in rows], DOCS + ", pii string")
    got = pii.find_pii(df).collect()
    assert [len(r.pii) for r in sorted(got, key=lambda r: r.doc_id or 9)] == [0, 0, 2, 2, 1]
    texts = [r.text for r in pii.redact(df).collect()]
    assert texts[0] is None and texts[1] == "" and texts[2] == texts[3] == "x <EMAIL>, <PHONE> y" and texts[4].endswith("word <EMAIL>")
    assert pii.redact(df).columns == df.columns
    assert pii.find_pii(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def both():
    return bpe.load(bpe.default_path()), tokenizers.Tokenizer.from_file(bpe.default_path())


def same(both, text):
    own, ref = both
    ids = own.encode(text)
    want = ref.encode(text, add_special_tokens=False).ids
    return np.frombuffer(ids, "<u4").tolist() == want and own.decode(ids) == ref.decode(want, skip_special_tokens=False)


def test_bpe_against_the_library(both):
    r = random.Random(4)
    labels = [x for x, i in both[0].automaton.inside.items() if i >= 0]
    for _ in range(4000):
        assert same(both, "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 40))))
        assert same(both, "".join(r.choice(labels) for _ in range(r.randint(1, 4))))
        assert same(both, "".join(chr(r.choice([r.randint(1, 127), r.randint(128, 0x24F), r.randint(0x370, 0x3FF), r.randint(0x4E00, 0x9FFF), r.randint(0x1F300, 0x1F5FF)])) for _ in range(r.randint(1, 30))))
    for t in ("a<|endoftext|>b <|startoftext|>c", "<|endoftext|", "Σας ΟΔΟΣ İx", "a" * 3000, "", " ", "don't I'LL 's \x1c x\x85y", "é é", "ab" * 5000):
        assert same(both, t), t[:30]


def test_bpe_small_merges():
    vocab = {"a": 0, "b": 1, "aa": 2, "ab": 3, "aaa": 4, "aab": 5}
    merges = [("a", "a"), ("a", "b"), ("aa", "a"), ("aa", "b")]
    auto = bpe.Automaton(vocab, merges)

    def by_rank(word):
        parts = list(word)
        while True:
            ranked = [(merges.index((x, y)), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if (x, y) in merges]
            if not ranked:
                return [vocab[p] for p in parts]
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(1, 13):
        for bits in range(2**n):
            w = "".join("ab"[bits >> i & 1] for i in range(n))
            assert auto.encode_word(w) == by_rank(w), w
    with pytest.raises(ValueError, match="two merges"):
        bpe.Automaton({"a": 0, "b": 1, "ab": 2, "aba": 3, "ba": 4}, [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "ba")])


def gadgets(symbols, merges):
    """The automaton by the book: explicit states and arcs, one gadget after the other; the arcs behind each token."""
    arcs = [{x: 0 for x in symbols}]
    for a, b in merges:
        c = a + b
        places = [p for p, out in enumerate(arcs) if a in out]
        if not places:
            continue
        (target,) = {arcs[p][a] for p in places}  # all arcs of a token lead to one state
        if b not in arcs[target]:
            continue
        then = arcs[target][b]
        arcs.append({t: s for t, s in arcs[target].items() if t != b})
        new = len(arcs) - 1
        for p in [*places, *([new] if a in arcs[new] else [])]:
            arcs[p][a] = new
            arcs[p][c] = then
    behind = {}
    seen, todo = {0}, [0]
    while todo:
        for t, s in arcs[todo.pop()].items():
            behind.setdefault(t, set()).add(s)
            if s not in seen:
                seen.add(s)
                todo.append(s)
    return {t: {x for s in states for x in arcs[s]} for t, states in behind.items()}, {t: len(v) for t, v in behind.items()}


def test_states_and_arcs_against_explicit_gadgets():
    r = random.Random(31)
    for _ in range(150):
        symbols = "abc"[: r.choice((1, 2, 3))]
        tokens, merges = list(symbols), []
        for _ in range(r.randint(1, 12)):
            a, b = r.choice(tokens), r.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        vocab = {t: i for i, t in enumerate(tokens)}
        auto = bpe.Automaton(vocab, merges)
        arcs, states = gadgets(symbols, merges)
        assert set(states.values()) == {1}
        for u in arcs:
            mine = {v for v in arcs if auto.follows(vocab[u], vocab[v])}
            assert mine == arcs[u], (merges, u)
        for _ in range(40):
            w = "".join(r.choice(symbols) for _ in range(r.randint(1, 14)))
            parts = list(w)
            for a, b in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (a, b):
                        parts[i : i + 2] = [a + b]
                    i += 1
            assert auto.encode_word(w) == [vocab[p] for p in parts], (merges, w)


def test_added_tokens_that_take_blanks_are_refused(both):
    import json

    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError, match="added tokens"):
        bpe.Tokenizer(spec)


def test_bpe_frames(spark, both):
    rows = [(1, None), (2, ""), (3, "Hello World"), (3, "Hello World"), (None, "x" * 100_000)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, n_tokens string")
    got = bpe.encode_decode(df).collect()
    assert [r.n_tokens for r in got][:4] == [0, 0, 2, 2] and got[2].decoded == "hello</w> world</w>" and got[0].decoded == ""
    assert hashlib.sha256(got[4].token_ids).digest() == hashlib.sha256(both[0].encode("x" * 100_000)).digest()
    assert bpe.encode_decode(df.limit(0)).count() == 0


def code_length(texts, order, min_count, text):
    """Bits of a text in each language, straight from the definition."""
    follow, total = {}, {}
    for k, v in texts.items():
        for t in v:
            b = (" " + t.lower()).encode()
            for n in range(order + 1):
                for i in range(len(b) - n):
                    f = follow.setdefault((k, b[i : i + n]), {})
                    f[b[i + n]] = f.get(b[i + n], 0) + 1
            for n in range(1, order + 1):
                for i in range(len(b) - n + 1):
                    total[b[i : i + n]] = total.get(b[i : i + n], 0) + 1
    out, b = [], text.lower().encode()
    for k in sorted(texts):
        bits = 0.0
        for i in range(len(b)):
            n = next(n for n in range(min(order, i), -1, -1) if n == 0 or total.get(b[i - n : i], 0) >= min_count)
            while True:
                f = follow.get((k, b[i - n : i]), {})
                c, d = sum(f.values()), len(f)
                if b[i] in f:
                    bits += math.log2((c + d) / f[b[i]])
                    break
                bits += math.log2((c + d) / d) if d else 0
                if n == 0:
                    bits += 8
                    break
                n -= 1
        out.append(bits)
    return out


def test_code_lengths_against_the_definition():
    texts = {"x": ["the cat sat on the mat " * 9, "the hat"], "y": ["le chat est là " * 9], "z": ["ñandú y más"]}
    m = language_id.Model(texts, order=4, min_count=3)
    for t in ("the cat est là", "日本 the ñ", "a", "the mat on the chat " * 30):
        assert m.code_lengths([t])[0][0] == pytest.approx(code_length(texts, 4, 3, t), rel=1e-5)
    many = ["the cat", "x" * 1000, "le chat " * 100]
    whole = m.code_lengths(many)[0]
    assert all(np.allclose(whole[i], m.code_lengths([t])[0][0]) for i, t in enumerate(many))
    assert m.predict(["le chat", None, "", "12 34 !?", "the mat"])[0] == ["y", "und", "und", "und", "x"]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert set(held) == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_sample_beside_many_junk_values(spark):
    rows = [(i, lang) for i, lang in enumerate(["en"] * 900 + ["de"] * 700 + [f"junk{i}" for i in range(300)])]
    docs = spark.createDataFrame(rows, "i long, l string")
    few = {r.l: r["count"] for r in splits.bounded(docs, "l", "i", 400, 1100).groupBy("l").count().collect()}
    assert len(few) == 302 and all(330 < few[x] < 470 for x in ("en", "de"))
    none_left = {r.l: r["count"] for r in splits.bounded(docs, "l", "i", 40, 250).groupBy("l").count().collect()}
    assert none_left["en"] >= 1 and none_left["de"] >= 1 and sum(none_left.values()) < 330
    assert splits.shares({"a": 1000, "b": 7}, 400, 8000) == {"a": 400, "b": 7}


def test_numerals_are_no_letters():
    m = language_id.Model({"en": ["the cat sat on the mat " * 30], "fr": ["le chat est sur le lit " * 30]})
    assert m.predict(["½ ²", "Ⅷ", "①", "12 ٣", "_", "", None, "ª", "é", "漢"])[0][:7] == ["und"] * 7
    assert "und" not in m.predict(["ª", "é", "漢", "the ½"])[0]


def test_sample_is_bounded_in_characters_and_values(spark):
    rows = [(i, f"l{i % 50:02d}", 1000) for i in range(5000)]
    df = spark.createDataFrame(rows, "i long, l string, n long")
    got = splits.bounded(df, "l", "i", 40, 1000, "n", 200_000, values=10).collect()
    assert 150 <= len(got) <= 250 and {r.l for r in got} == {f"l{i:02d}" for i in range(10)}


def test_language_odd_frames(spark):
    rows = [(1, "the cat sat", "en", "s", 0), (None, "the cat", None, None, 0), (3, None, "en", None, 0), (4, "12", None, None, 0), (5, "le chat " * 40_000, "fr", None, 0), (5, "le chat " * 40_000, "fr", None, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", score int")
    got = language_id.identify(df, language_id.train(df)).collect()
    assert [r.lang_pred for r in got][:4] == ["en", "en", "und", "und"] and got[4] == got[5]
    assert language_id.identify(df, language_id.train(df.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_id.identify(df.limit(0), language_id.train(df)).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r for r in quality_model.classify(docs, quality_model.train(docs, labels)).collect()}
    pairs = [(scores[r.doc_id].score, r.quality) for r in labels.collect() if scores[r.doc_id].held_out]
    good, bad = ([s for s, y in pairs if y == k] for k in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scores.values())


def test_quality_odd_frames(spark):
    rows = [(i, f"some text of number {i}. It goes on.", "en", "s", 0) for i in range(40)]
    rows += [(None, "x", None, None, 0), (50, None, None, None, 0), (51, "", None, None, 0), (52, "word " * 100_000, None, None, 0), (1, "some text of number 1. It goes on.", "en", "s", 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", predicted int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(None, 1, 0), (3, None, 0), (51, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(df, quality_model.train(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert got[1].score == got[-1].score and got[41].score == got[42].score
    none = quality_model.classify(df, quality_model.train(df, labels.limit(0))).collect()
    assert {round(r.score, 6) for r in none} == {0.8}
    assert quality_model.classify(df.limit(0), quality_model.train(df.limit(0), labels.limit(0))).count() == 0


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_of_planted_mixtures(prior):
    """Whatever share of either class was labelled, the prior comes from positives and unlabelled rows."""
    r = np.random.default_rng(2)
    d = len(quality_model.FEATURES)
    draw = lambda good, n: r.normal(1 if good else -0.4, 1, (n, d))
    unl = np.concatenate([draw(True, int(4000 * prior)), draw(False, int(4000 * (1 - prior)))])
    r.shuffle(unl)
    for labelled in (300, 3000):
        assert quality_model.estimated_prior(draw(True, labelled), unl) == pytest.approx(prior, abs=0.05)


def test_prior_does_not_look_at_labels_of_0(spark):
    r = random.Random(9)
    good = lambda: " ".join(r.choice(("alpha", "beta", "gamma", "delta")) + str(r.randrange(500)) for _ in range(60)) + "."
    bad = lambda: "BUY $$$ NOW!!! " * r.randint(3, 9)
    truth = [i % 10 < 6 for i in range(1500)]
    docs = spark.createDataFrame([(i, good() if t else bad(), None, None, 0) for i, t in enumerate(truth)], DOCS)
    # Labels of the good are a quarter, those of the bad are many or none: 0.6 holds all the same.
    for every in (1, 10**6):
        rows = [(i, int(t)) for i, t in enumerate(truth) if (t and i % 4 == 0) or (not t and i % every == 0)]
        model = quality_model.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert model.prior == pytest.approx(0.6, abs=0.06)


@pytest.mark.parametrize("plain", [False, True])
def test_risk_and_gradient_against_the_definition(plain):
    r = np.random.default_rng(5)
    d = len(quality_model.FEATURES)
    pos, unl = r.normal(1, 1, (9, d)), r.normal(0, 1, (13, d))
    m = quality_model.PUModel(pos, unl, 0.4, bins=3, steps=3, against_unlabelled=plain)
    sp, su = m._slots(pos), m._slots(unl)

    def brute(weights, bias):
        loss = lambda f, y: math.log1p(math.exp(-f if y else f))
        score = lambda slots: [sum(weights[k] for k in row) + bias for row in slots]
        fp, fu = score(sp), score(su)
        mean = lambda v: sum(v) / len(v)
        if plain:
            return 0.4 * mean([loss(f, 1) for f in fp]) + 0.6 * mean([loss(f, 0) for f in fu]), 1.0
        negative = mean([loss(f, 0) for f in fu]) - 0.4 * mean([loss(f, 0) for f in fp])
        return 0.4 * mean([loss(f, 1) for f in fp]) + max(0.0, negative), negative

    for scale in (0.0, 0.3, 2.0):
        m.weights, m.bias = r.normal(0, scale, len(m.weights)), 0.2
        risk, step = m.risk(sp, su)
        want, negative = brute(m.weights, m.bias)
        assert risk == pytest.approx(want)
        if negative > 0:
            for k in [*range(0, len(m.weights), 7), len(m.weights)]:
                shift = np.zeros(len(m.weights) + 1)
                shift[k] = 1e-5
                slope = (brute(m.weights + shift[:-1], m.bias + shift[-1])[0] - brute(m.weights - shift[:-1], m.bias - shift[-1])[0]) / 2e-5
                assert step[k] == pytest.approx(slope, abs=1e-6)


def test_pu_risk_stays_non_negative():
    r = np.random.default_rng(0)
    d = len(quality_model.FEATURES)
    pos = r.normal(1, 1, (300, d))
    unl = np.concatenate([r.normal(1, 1, (350, d)), r.normal(-1, 1, (150, d))])
    m = quality_model.PUModel(pos, unl, 0.7)
    s = m.score(unl)
    assert s[:350].mean() > 0.8 and s[350:].mean() < 0.2


def article(h):
    a = h[h.index("<article>") + 9 : h.index("</article>")].replace("<b>", "").replace("</b>", "").replace("<br>", " ")
    import html

    return "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", a)) if b)


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert all(got[r.page_id] == article(r.html) for r in pages.collect())


PARTS = {
    "menu": '<div class="navbar"><a href="/a">Home</a> | <a href="/b">About us</a></div>',
    "header": "<header><p>Daily Gazette</p></header>",
    "footer": '<div id="footer">&copy; 2020 The Gazette. All rights reserved.</div>',
    "sidebar": '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Another story here</a></li><li><a href="/d">And one more</a></li></ul></aside>',
    "notice": '<div class="cookie-notice"><p>We use cookies to make this site work. Please accept them.</p><button>OK</button></div>',
    "advert": '<div class="ad-box">Buy two lamps and get the third for nothing.</div>',
    "form": '<form action="/s"><label>Your mail <input name="q"></label><button>Send</button></form>',
    "comments": '<section id="comments"><h2>2 comments</h2><div class="comment"><p>I read this with great pleasure, thank you so much.</p></div><div class="comment"><p>I do not agree with the second part of it.</p></div></section>',
}
MAIN = "<h1>On lamps</h1><p>Lamps have lit the evenings of people for a long time, and they still do.</p><p>A lamp needs oil,\n a   wick &amp; air. <a href='/x'>Some</a> need more.<ul><li>Oil of olives<li>Oil of nuts</ul><p>So it goes."
TEXT = "On lamps\nLamps have lit the evenings of people for a long time, and they still do.\nA lamp needs oil, a wick & air. Some need more.\nOil of olives\nOil of nuts\nSo it goes."


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("box", ["<article>{}</article>", '<div class="content">{}</div>', "<main>{}</main>"])
def test_what_is_no_main_text_goes(part, box):
    page = f"<html><head><title>t</title></head><body>{PARTS['menu']}{box.format(MAIN)}{PARTS[part] if part != 'menu' else ''}<script>x</script></body></html>"
    assert html_text.extract_texts([page], html_text.trained())[0] == TEXT


def test_head_that_is_never_closed():
    text = " ".join(f"Sentence number {i} of this page says something." for i in range(40))
    for head in ("<title>x</title>", "<title>x</title><meta charset=utf-8><noscript><img src=a></noscript><style>p {}</style>"):
        got = html_text.extract_texts([f"<html><head>{head}<p>{text}</p>", f"<html><head>{head}</head><body><p>{text}</p></body></html>"], html_text.trained())
        assert got[0] == got[1] == text


def test_specimens():
    trees = html_text.trained()
    x, y = html_text.examples(html_text.specimens(150, 991))
    assert ((trees.odds(x) > 0) == (y > 0)).mean() > 0.99


def test_decoding_is_consistent():
    r = random.Random(6)
    for _ in range(200):
        p = html_text.Page("<div><p>a</p><div><p>b</p><ul><li>c<li>d</ul></div></div><p>e</p>")
        odds = np.array([r.uniform(-6, 6) for _ in p.tag])
        kept = p.kept(odds)
        assert all(kept[p.parent[i]] or not kept[i] for i in range(1, len(kept)))
        score = lambda k: sum(o if x else -o for o, x in list(zip(odds, k, strict=True))[1:])
        n = len(p.tag)
        best = max(score([True, *((m >> i & 1) == 1 for i in range(n - 1))]) for m in range(2 ** (n - 1)) if all((q := p.parent[i]) == 0 or m >> (q - 1) & 1 or not m >> (i - 1) & 1 for i in range(1, n)))
        assert score(kept) == pytest.approx(best)


def test_html_frames(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<<p>&amp;&#x27;<div" + "<div>" * 3000 + "'\">", None), (4, "u", f"<body><article>{MAIN}</article>", None), (4, "u", f"<body><article>{MAIN}</article>", None), (5, "u", "<body><article>" + "<p>One sentence stands here, and it is a long one.</p>" * 20_000, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    texts = [r.text for r in got]
    assert texts[0] == texts[1] == "" and texts[3] == texts[4] == TEXT and texts[5].count("\n") == 19_999
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
