import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import pieces, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return queries.public_model("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def odd_texts(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    parts = [" ", "  ", "   ", "\n", "\n\n", "\t", "\r", "\r\n", "▁", "▁▁", "a", "the", "The", "cat", "<s>", "</s>", "<unk>", "<0x0A>", "é", "é", "日本", "語",
             "\U0001F600", "\x00", "\x7f", " ", "　", "�", ";\r", "{", "}", "1234", "...", "\v", "\f", "ß", "​", "𝔘"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_cuts_of_the_model(model):
    cuts = pieces.Cuts.of(model)
    assert cuts.apart and cuts.prefix and "\n" in cuts.alone and "\r" not in cuts.alone
    assert list(cuts.cutter()("a  b\nc ")) == [[" a", "  b", "\n", "c", " "]] and list(cuts.cutter()("")) == []


def test_words_segment_apart(model, library, monkeypatch):
    """Every way to cut: the words' ids in order are the library's ids of the whole text."""
    cuts = pieces.Cuts.of(model)
    words = pieces.load(cuts.words)
    for step in (1, 3, 1 << 20):
        monkeypatch.setattr(pieces, "STEP", step)
        for t in odd_texts(step, 3000):
            assert [i for part in cuts.cutter()(t) for w in part for i in words.encode(w)] == library.encode(t), repr(t)


@pytest.mark.parametrize("table_bytes", [pieces.TABLE_BYTES, 3000, 0])
def test_equals_the_library(spark, model, library, table_bytes):
    texts = odd_texts(7, 400) + ["", None, "the cat " * 40_000, "x" * 5000, "same words here"] + ["same words here"] * 50
    rows = [(i, t, "kept") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    out = pieces.decode(pieces.encode(docs, model, table_bytes=table_bytes), model).collect()
    assert len(out) == len(rows)
    for r in out:
        want = library.encode(texts[r.doc_id] or "", add_eos=True)
        assert list(r.ids) == want and r.decoded == library.decode(want) and r.text == texts[r.doc_id]


def test_table_holds_each_frequent_word_once(spark, model):
    docs = spark.createDataFrame([(1, "aa bb aa\ncc"), (2, "aa bb dd"), (3, None)], "doc_id long, text string")
    cuts = pieces.Cuts.of(model)
    assert {r.word: r.n for r in pieces.count_words(docs, cuts).collect()} == {" aa": 3, " bb": 2, "\n": 1, "cc": 1, " dd": 1}
    assert set(pieces.word_table(docs, cuts)) == {" aa", " bb"}
    assert set(pieces.word_table(docs, cuts, table_bytes=300)) == {" aa"}


def test_model_whose_pieces_cross_markers(spark, model):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    m.pieces.add(piece="f▁", score=1e5, type=1)
    crossing = m.SerializeToString()
    whole = sentencepiece.SentencePieceProcessor(model_proto=crossing)
    assert not pieces.Cuts.of(crossing).apart and "f▁" in whole.encode("one of the two", out_type=str)
    docs = spark.createDataFrame([(0, "one of the two"), (1, ""), (2, None)], "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in pieces.encode(docs, crossing, end=False).collect()}
    assert got == {0: whole.encode("one of the two"), 1: [], 2: []}


def test_null_ids_and_no_rows(spark, model):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in pieces.decode(rows, model).collect()} == {1: None, 2: ""}
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_query(spark, library):
    import hashlib

    def digest(s):
        return hashlib.sha256(s.encode()).hexdigest()

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_sentencepiece(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))
