"""Language, tokens, personal data, quality: against the plain way, and their edges."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import language, pii, quality, tokens
from brindle.llm.common import held_out
from brindle.llm.queries import QUERIES, tokenizer_file

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, _n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 0.5, "clash", 7) for i, t, lang in rows], DOC)


def test_held_out_rule(spark):
    got = spark.createDataFrame([(i,) for i in (0, 1, 12, 345, None)], "i long").select("i", held_out(F.col("i"), 4, 2).alias("h")).collect()
    assert all(r["h"] == (r["i"] is not None and zlib.crc32(str(r["i"]).encode()) % 4 == 2) for r in got)


# language


def brute_ranked(text, most):
    words, counts = re.findall(r"[^\W\d_]+", text.lower()), {}
    for w in words:
        w = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                if g.strip() and not (n == 3 and g[1] == " "):
                    counts[g] = counts.get(g, 0) + 1
    # words share the blank between them: a gram that ends one word and begins the next is one and the same blank
    return sorted(counts.items(), key=lambda x: (-x[1], [ord(c) for c in x[0]] + [0] * (3 - len(x[0]))))[:most]


def decoded(key):
    return "".join(chr(c) for c in ((key >> 42) & 0x1FFFFF, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF) if c)


@pytest.mark.parametrize("text", ["The cat, the hat!", "Élan vital, ça va", "a", "x1y2 z", "ÑÑ ñ", "日本 語"])
def test_ranked_ngrams(text):
    got = [decoded(int(k)) for k in language.ranked(text, 1000)]
    assert got == [g for g, _ in brute_ranked(text, 1000)]


@pytest.mark.parametrize("part", [1, 2, 3, 5, 1000])
def test_ngrams_in_parts(part):
    for text in ("the  house, of 12 the mooñ!", " a", "a ", "  ", "日本 語x", "a" * 40):
        whole, own = language.grams(text), language.grams(text, part)
        assert (whole is None and own is None) or all((x == y).all() for x, y in zip(whole, own, strict=True))


def test_profiles_and_predictions_by_brute_force(spark, sf_dir):
    """Profiles by counting every n-gram of every learnable text, distances by going through them one by one."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    learnable = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"]]
    by = {}
    for r in learnable:
        for g, n in brute_ranked(r["text"], None):
            own = by.setdefault(r["lang"], {})
            own[g] = own.get(g, 0) + n
    order = lambda x: (-x[1], [ord(c) for c in x[0]] + [0] * (3 - len(x[0])))
    profiles = {lang: {g: k for k, (g, _) in enumerate(sorted(found.items(), key=order)[: language.PROFILE])} for lang, found in by.items()}
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, sf_dir).collect()}
    for r in rows:
        own = [g for g, _ in brute_ranked(r["text"] or "", language.RANKED)]
        if not own:
            assert got[r["doc_id"]]["lang_pred"] == "und" and got[r["doc_id"]]["score"] == 0
            continue
        away = {lang: sum(abs(p[g] - k) if g in p else language.PROFILE for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert got[r["doc_id"]]["lang_pred"] == best
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - away[best] / (language.PROFILE * len(own)))


def test_language_prediction_by_hand():
    p = language.Profiles([("aa", k, r) for r, k in enumerate(language.ranked("la casa de la luna", 400).tolist())] + [("bb", k, r) for r, k in enumerate(language.ranked("the moon of the house", 400).tolist())])
    assert p.predict("la luna")[0] == "aa" and p.predict("the house")[0] == "bb"
    assert p.predict("la casa de la luna") == ("aa", 1.0)
    assert p.predict(None) == p.predict("12 !?") == p.predict("") == ("und", 0.0)


def test_language_query_on_held_out(spark, sf_dir):
    got = QUERIES["op1_language_id"](spark, sf_dir)
    rows = got.join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == 200 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows) and got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]


def test_language_edges(spark):
    rows = [(1, "the house of the moon", "en"), (1, "the house of the moon", "en"), (2, None, "en"), (3, "", None), (None, "the", "en"), (4, "word " * 50_000, "en"), (5, "123", "en")]
    d = docs(spark, rows)
    p = language.learn(d, F.lit(True))
    got = {(r["doc_id"], r["score"]): r["lang_pred"] for r in language.identify(d, p, ["doc_id", "score"], lang="lang_pred", score="own").collect()}
    assert got[(2, 0.5)] == got[(3, 0.5)] == got[(5, 0.5)] == "und" and got[(4, 0.5)] == got[(None, 0.5)] == "en"
    empty = d.where("false")
    assert language.learn(empty, F.lit(True)).names == [] and language.identify(empty, p, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in language.identify(d, language.learn(empty, F.lit(True)), ["doc_id"]).collect()} == {"und"}


def test_language_learns_from_allowed_rows_only(spark):
    d = docs(spark, [(i, "alpha beta", "en") for i in range(20)] + [(i, "omega psi", "xx") for i in range(20, 40)])
    assert language.learn(d, F.col("doc_id") < 20).names == ["en"]


# tokens


@pytest.fixture(scope="module")
def vocabularies():
    return {n: tokens.Vocabulary(open(tokenizer_file(n), encoding="utf-8").read()) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n\t'sStTreVE.,!12<|>é語ß"), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_tokens_as_the_library(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        v = tokens.loaded(open(tokenizer_file(name), encoding="utf-8").read())
        want = v.library.encode(text, add_special_tokens=False).ids
        assert v.count(text) == len(want) and v.ids(text) == np.array(want, "<u4").tobytes()


def test_special_strings_and_long_texts(vocabularies):
    for v in vocabularies.values():
        for text in ("a<|endoftext|>b", "<|endoftext|>", "x" * 5000, "word " * 500_000):
            assert v.count(text) == len(v.library.encode(text, add_special_tokens=False).ids)


MANY = ["it’s “so” — a plain text with one quote", "Привет, мир! Это  текст\n\n и ещё.", "日本語の文章。  中文　字", "Σίσυφος ΟΔΟΣ ς", "ก็ไทย", "👩‍👩‍👧 x 🇩🇪", "é é İı ǅ ﬁ", "١٢٣ ⅷ ²", "\u2003 \u2003a \x85 b\x1c c"]


@pytest.mark.parametrize("run", [1, 5, 256])
def test_every_script_without_the_library_whole(vocabularies, monkeypatch, run):
    monkeypatch.setattr(tokens, "RUN", run)
    for v in vocabularies.values():
        handed = 0
        for text in [*MANY, " ".join(MANY), *(f"{a} {b}" * 40 for a in MANY for b in MANY)]:
            want = v.library.encode(text, add_special_tokens=False).ids
            assert v.count(text) == len(want) and v.ids(text) == np.array(want, "<u4").tobytes()
            handed += v.is_special(text)
        assert handed == 0


def test_every_character(vocabularies):
    for v in vocabularies.values():
        for low in range(0, 0x110000, 8192):
            text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(low, low + 8192) if not 0xD800 <= c < 0xE000)
            assert v.count(text) == len(v.library.encode(text, add_special_tokens=False).ids)


def test_whole_strings_are_proved(vocabularies):
    v = vocabularies["byte_bpe_50k.json"]
    assert len(v.whole) > 40_000 and all(v.library.encode(p, add_special_tokens=False).ids == [i] for p, i in list(v.whole.items())[::97] if v.pattern.findall(p) == [p])


def test_memo_is_bounded():
    memo = tokens.Memo({"a": 1}, len)
    memo.most = 4
    assert [memo[x] for x in ("bb", "ccc", "dddd", "eeeee", "a")] == [2, 3, 4, 5, 1] and len(memo) <= 4


def test_token_query(spark, sf_dir):
    v = tokens.Vocabulary(open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8").read())
    for r in QUERIES["op4_token_counts"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect():
        n = len(v.library.encode(r["text"], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(r["text"].encode()), n > 512)
    d = docs(spark, [(1, None, "en"), (1, None, "en"), (None, "é", "en"), (2, "", "en")])
    assert sorted(tuple(r)[1:] for r in tokens.count_tokens(d, tokenizer_file("byte_bpe_50k.json")).collect()) == [(0, 0, False), (0, 0, False), (0, 0, False), (2, 1, False)]
    assert tokens.count_tokens(d.where("false"), tokenizer_file("byte_bpe_50k.json")).count() == 0


# personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_base(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                double = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(double) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.-_@ 0123456789+()\n٣é", max_size=60))
def test_base_spans_as_the_patterns(text):
    assert [x[:3] for x in pii.base_spans(text)] == plain_base(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "x@y@z.com", "@b.cd", "1.2.3.4.5.6.7.8", "300.1.1.1", "1.2.3.0000255", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 123-4567", "++49 30 1234567"])
def test_base_spans_cases(text):
    assert [x[:3] for x in pii.base_spans(text)] == plain_base(text)


def test_added_spans():
    text = "Pay to IBAN DE89 3704 0044 0532 0130 00 now; bad DE88 3704 0044 0532 0130 00. SSN: 123-45-6789, part 123-45-6789x"
    kinds = [(k, text[s:e]) for k, s, e, _ in pii.spans(text) if k in pii.ADDED]
    assert kinds[0] == ("iban", "DE89 3704 0044 0532 0130 00") and ("ssn", "123-45-6789") in kinds and len([k for k in kinds if k[0] == "iban"]) == 1
    assert [k for k, *_ in pii.spans("code 123-45-6789") if k == "ssn"] == []
    assert [text[s:e] for text in ('api token = "a9B8c7D6e5F4g3H2i1J0k"',) for k, s, e, _ in pii.spans(text) if k == "secret"] == ["a9B8c7D6e5F4g3H2i1J0k"]
    assert [x for t in ("a9B8c7D6e5F4g3H2i1J0k", "token = abcdefghijklmnopqrstuvwxyz", "key 12345678901234567890123", "key aaaaaaaaaaaaaaaaaaaaaaaa1a1a1") for x in pii.spans(t) if x[0] == "secret"] == []
    assert pii.spans(None) == pii.spans("") == []
    near, far = pii.spans("my card 4111111111111111")[0][3], pii.spans("4111111111111111")[0][3]
    assert near > far


def test_long_texts_are_linear():
    for text in ("1" * 300_000, "a." * 150_000, "@" * 100_000, "+1 " * 50_000, "A" * 300_000, "1." * 150_000, "a1" * 150_000, "key " + "a1b2" * 20_000 + "=" * 50_000):
        pii.spans(text)


def test_pii_query(spark, sf_dir):
    for r in QUERIES["op3_personal_data"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect():
        want = plain_base(r["text"])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]
    d = docs(spark, [(1, None, "en"), (None, "é a@b.cd", "en"), (None, "é a@b.cd", "en")])
    assert sorted(r["spans"] for r in pii.digest(pii.find(d)).collect()) == ["", "email:2:8", "email:2:8"]
    assert [r["text"] for r in pii.masked(d.where("text IS NOT NULL").limit(1)).collect()] == ["é <email>"]
    assert pii.digest(pii.find(d.where("false"))).count() == 0


# quality


def test_statistics_edges():
    assert len(quality.statistics(None)) == len(quality.STATS) == len(quality.statistics("a b\nc."))
    assert all(np.isfinite(quality.statistics(t)).all() for t in ("", " \n", "!!!", "日本", "x" * 100_000))


def test_rules_compile_to_what_they_hold(spark):
    rng = np.random.default_rng(1)
    rows = rng.random((600, len(quality.STATS)))
    labels = ((rows[:, 5] > 0.5) & (rows[:, 9] <= 0.7)).astype(float)
    rules = quality.fit(rows, labels)
    assert ((rules.score(rows) > 0.5) == labels).mean() > 0.97 and 0 < len(rules.rules) < 200
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows[:50]], list(quality.STATS))
    assert np.allclose([r[0] for r in df.select(rules.column()).collect()], rules.score(rows[:50]))


def test_one_kind_of_label_and_none(spark):
    assert quality.fit(np.zeros((3, len(quality.STATS))), np.ones(3)).rules == []
    d = docs(spark, [(1, "a", "en"), (None, None, "en"), (1, "a", "en")])
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(d, labels, held_out(F.col("doc_id"), 5, 0)).collect()
    assert [r["score"] for r in got] == [0.5] * 3 and [r["predicted"] for r in got] == [1] * 3
    assert quality.score(d.where("false"), labels.where("false"), F.lit(False)).count() == 0


def test_quality_query_on_held_out(spark, sf_dir):
    rows = QUERIES["op10_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.85
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_statistics(text):
    text = text or ""
    kind = Counter(next((k for k, cs in (("mark", quality.MARKS), ("line", "\n")) if c in cs), {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lm": "other", "Lo": "other", "Mn": "other", "Mc": "other", "Nd": "digit", "Nl": "digit", "No": "digit", "Zs": "blank", "Cc": "blank"}.get(unicodedata.category(c), "symbol")) for c in text)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    letters = kind["lower"] + kind["upper"] + kind["other"]
    shown = max(1, letters + kind["digit"] + kind["mark"] + kind["symbol"])
    n = max(1, len(words))
    return [
        len(text), len(words), len(lines), shown / n, len(words) / max(1, len(lines)), kind["upper"] / max(1, letters), letters / shown, kind["digit"] / shown, kind["mark"] / shown, kind["symbol"] / shown,
        text.count("!") / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, max((words.count(w) for w in set(words)), default=0) / n, 1 - len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip()[-1] in ".!?:" for x in lines) / max(1, len(lines)),
    ]


@pytest.mark.parametrize("part", [1, 4, 1 << 20])
def test_statistics_by_hand(monkeypatch, part):
    monkeypatch.setattr(quality, "PART", part)
    for text in ("", None, "One two two. THREE!\nOne two two. THREE!\n\n é 12 ٣ ǅ?", "a  a a\tb", " x", "\x1c y\u2003z z"):
        assert quality.statistics(text) == pytest.approx(plain_statistics(text))


def test_quality_by_brute_force(spark, sf_dir):
    """The same fit on statistics counted by hand, every rule of it held against every document by going through its parts."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["quality"] is not None}
    stats = {r["doc_id"]: plain_statistics(r["text"]) for r in rows}
    taught = sorted(i for i in labels if i in stats)
    rules = quality.fit(np.array([stats[i] for i in taught], dtype=np.float64), np.array([labels[i] for i in taught], dtype=np.float64))
    assert rules.rules
    for r in QUERIES["op10_quality"](spark, sf_dir).collect():
        total, own = rules.bias, dict(zip(quality.STATS, stats[r["doc_id"]], strict=True))
        for rule, weight in zip(rules.rules, rules.weights, strict=True):
            total += weight * all(own[name] > bound if above else own[name] <= bound for name, above, bound in rule)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total))) and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_rows_under_one_id_teach_once(spark):
    d = docs(spark, [(1, "Good words here.", "en")] * 50 + [(1, "other", "en"), (2, "!!!", "en"), (3, "x y", "en")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, None)], "doc_id long, quality int")
    got = quality.score(d, labels, F.lit(False)).collect()
    assert len(got) == 53 and len({r["score"] for r in got if r["doc_id"] == 1}) <= 2


def test_very_long_texts(spark):
    d = docs(spark, [(1, "The house of the moon. " * 200_000, "en"), (2, "la casa de la luna " * 50, "es")])
    assert [r["lang_pred"] for r in language.identify(d, language.learn(d, F.lit(True)), ["doc_id"]).orderBy("doc_id").collect()] == ["en", "es"]
    assert [r["n_tokens"] for r in tokens.count_tokens(d, tokenizer_file("byte_bpe_50k.json")).orderBy("doc_id").collect()][0] > 1_000_000
    assert quality.measured(d).where("doc_id = 1").first()["words"] == 1_000_000
