"""Classifiers: held-out accuracy, what they may learn from, and odd rows."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import boosting, langid, quality, toxicity
from tidemark.llm.common import fold, hash_spans, sample_ids, spans

SF = "/root/testdata/sf0.01"
ODD = [(90001, None), (90002, ""), (90003, " \n\t"), (90004, "x"), (90004, "x"), (90005, "é" * 200_000), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def with_odd(spark, docs):
    odd = spark.createDataFrame([(i, t, "xx", "s", 0, 1) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score_ long")
    return docs.unionByName(odd, allowMissingColumns=True)


@pytest.mark.parametrize("module,label,folds,held,least", [(quality, "quality", 5, 0, 0.95), (toxicity, "toxic", 3, 1, 0.85)])
def test_held_out_accuracy_and_odd_rows(spark, docs, labels, module, label, folds, held, least):
    data = with_odd(spark, docs.select("doc_id", "text"))
    got = module.classify(data, labels)
    rows = got.join(labels, "doc_id").where(fold(F.col("doc_id"), folds) == held).collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    odd = got.where("doc_id > 90000 or doc_id is null").collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert got.count() == docs.count() + len(ODD)


@pytest.mark.parametrize("module,label,folds,held", [(quality, "quality", 5, 0), (toxicity, "toxic", 3, 1)])
def test_held_out_labels_are_not_learned(spark, docs, labels, module, label, folds, held):
    small = docs.where("doc_id < 400").select("doc_id", "text")
    lied = labels.withColumn(label, F.when(fold(F.col("doc_id"), folds) == held, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = ({r.doc_id: r.score for r in module.classify(small, x).collect()} for x in (labels, lied))
    assert a == b


def test_no_labels_no_rows(spark, docs, labels):
    few = docs.limit(5).select("doc_id", "text")
    for module in (quality, toxicity):
        assert {r.score for r in module.classify(few, labels.limit(0)).collect()} == {0.5}
        assert module.classify(few.limit(0), labels).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string")).limit(5)).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_language_accuracy(spark, docs):
    out = langid.identify(with_odd(spark, docs.select("doc_id", "text", "lang")).select("doc_id", "text", "lang"))
    rows = out.collect()
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 90000 and len(r.text or "") > 40]
    assert np.mean([r.lang == r.lang_pred for r in known]) > 0.98
    odd = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id > 90000}
    assert odd[90001].lang_pred == odd[90002].lang_pred == odd[90003].lang_pred == "und" and odd[90001].score == 0
    assert odd[90005].lang_pred != "und" and all(0 <= r.score <= 1 for r in rows)


def plain_phrases(reference, text):
    """Greedy longest matches by substring search, restarting at every window."""
    n = 0
    for lo in range(0, len(text), langid.WINDOW):
        part, i = text[lo:lo + langid.WINDOW], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in reference:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
    return n


@pytest.mark.parametrize("text", ["banana", "nab an ban", "zzz", "b", "ana nab " * 300, "abz abz"])
def test_parse_equals_longest_matches(text):
    reference = "banana bandana an nab"
    model = langid.Model({"aa": reference, "bb": "other words of some kind"})
    rate, _ = model.rates([text])
    norm = langid.normal(text) + (" " if text.endswith(" ") else "")
    assert rate[0, 0] * len(norm) / model.factor[0] == pytest.approx(plain_phrases(reference, norm))


def written(letters, seed, n):
    """Text of words over many letters, each language with its own words."""
    words = np.random.default_rng(7 + seed // 10).choice(letters, size=(400, 3))
    return " ".join("".join(w) for w in words[np.random.default_rng(seed).integers(0, 400, n)])


def test_large_alphabets_are_told_apart():
    han, kana, hangul = ([chr(lo + i) for i in range(n)] for lo, n in ((0x4E00, 900), (0x3041, 80), (0xAC00, 900)))
    scripts = {"en": list("abcdefghijklmnopqrstuvwxyz"), "ja": han[:600] + kana, "ko": hangul, "zh": han, "zh2": han,
               "el": [chr(0x3B1 + i) for i in range(24) if i != 17], "ru": [chr(0x430 + i) for i in range(32)]}  # these and en fill 62 columns
    model = langid.Model({k: written(x, 10 * i, 3000) for i, (k, x) in enumerate(scripts.items())})
    texts = {k: [written(x, 10 * i + j, 30) for j in range(1, 6)] for i, (k, x) in enumerate(scripts.items())}
    assert {k: model.predict(v)[0] for k, v in texts.items()} == {k: [k] * 5 for k in texts}


@pytest.mark.parametrize("text", ["abcab", "zaz", "中文中 abc", "語語", "文中語x", "中文字 " * 300])
def test_parse_with_rare_letters_equals_longest_matches(text):
    reference = "abc cab ab " + "".join(chr(0x4E00 + i) for i in range(90)) + " 中文字 文中 中文 ba"
    model = langid.Model({"aa": reference, "bb": "abc other 語中"})
    rate, _ = model.rates([text])
    norm = langid.normal(text) + (" " if text.endswith(" ") else "")
    assert rate[0, 0] * len(norm) / model.factor[0] == pytest.approx(plain_phrases(reference, norm))


def test_clashing_columns_are_replaced(spark, docs, labels):
    few = docs.limit(20).select("doc_id", "text", "lang", F.lit("own").alias("score"), F.lit("own").alias("predicted"), F.lit("own").alias("lang_pred"),
                                F.lit(1).alias("y"), F.lit(1).alias("id"), F.lit(2).alias("slots"))
    for out in (quality.classify(few, labels), toxicity.classify(few, labels), langid.identify(few)):
        assert all(isinstance(r.score, float) for r in out.collect()) and out.columns.count("score") == 1


def test_boosting_learns_a_rule_and_odd_inputs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert boosting.fit(x[:0], y[:0]).probability(x[:3]).tolist() == [0.5] * 3
    assert (boosting.fit(x[:50], np.ones(50)).probability(x[:3]) > 0.9).all()


def test_span_hashes_depend_on_the_bytes_only():
    data = np.frombuffer(b"abc de abc " + b"q" * 300 + b" " + b"q" * 300 + b" de", dtype=np.uint8)
    s, e = spans(data != 32)
    h = hash_spans(data, s, e)
    assert h[0] == h[2] and h[1] == h[5] and h[3] == h[4] and len(set(h.tolist())) == 3


def test_samples_are_bounded_and_the_smallest_hashes(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("many").alias("g"))
    got = sample_ids(rows, "id", ["g"], 50, 3)
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"rare": 50, "many": 50} and got.columns == ["id", "g"]
    all_ = rows.where("g = 'rare'").orderBy(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)), "id").limit(50)
    assert {r.id for r in got.where("g = 'rare'").collect()} == {r.id for r in all_.collect()}
    assert sample_ids(rows.limit(7), "id", ["g"], 50, 3).count() == 7 and sample_ids(rows.limit(0), "id", ["g"], 50, 3).count() == 0


def test_shared_opening_does_not_stand_for_a_language(spark):
    """Two invented languages; every document begins with the same 2,500 characters, then 400 words of its own."""
    rng = random.Random(3)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(300)] for lang, letters in (("aa", "abcdefghiklmn"), ("bb", "aefghiknoprstu"))}
    opening = " ".join(rng.choice(words["aa"] + words["bb"]) for _ in range(420))[:2500]
    rows = [(i, opening + " " + " ".join(rng.choices(words[lang], k=400)), lang) for i in range(400) for lang in [("aa", "bb")[i % 2]]]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)


def test_shares_and_bounds(monkeypatch):
    assert langid.shares([5, 100, 1, 100], 60) == [5, 27, 1, 27] and langid.shares([3, 4], 100) == [3, 4] and langid.shares([], 9) == []
    monkeypatch.setattr(langid, "MODEL_BYTES", 200_000)
    model = langid.Model({k: "the quick brown fox " * 500 + k for k in ("aa", "bb", "cc")})
    assert model.table.nbytes <= 200_000 and len(model.langs) == 3
    same = langid.Model.of(model.parts())
    assert same.predict(["quick fox"])[0] == model.predict(["quick fox"])[0]


def test_parse_without_restarts():
    reference = "the cat sat on the mat and the dog ran to the cat again"
    text = "the cat and the dog sat on the mat then again ran " * 200
    norm = langid.normal(text) + " "
    model = langid.Model({"aa": reference, "bb": "other words of some kind"}, window=None)
    i, phrases = 0, 0
    while i < len(norm):
        j = i + 1
        while j < len(norm) and norm[i:j + 1] in reference:
            j += 1
        i, phrases = j, phrases + 1
    rate, _ = model.rates([text, "cat"])
    assert rate[0, 0] * len(norm) / model.factor[0] == pytest.approx(phrases)
