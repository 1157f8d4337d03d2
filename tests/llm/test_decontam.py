import random
from itertools import combinations

import pytest
from brute import contaminated

from tidemark.llm import decontam

rng = random.Random(3)
VOCAB = [f"w{i}" for i in range(4000)]
ITEMS = [(i, " ".join(rng.choices(VOCAB, k=n))) for i, n in enumerate([40, 25, 16, 15, 13, 8, 3, 1])] + [(90, None), (91, " ,. ")]


def passage(item, wrong=0, lo=0, hi=None):
    w = dict(ITEMS)[item].split()[lo:hi]
    for at in rng.sample(range(len(w)), wrong):
        w[at] = "zzz"
    return " ".join(w)


def noise(n):
    return " ".join(rng.choices(VOCAB, k=n))


DOCS = [(1, f"{noise(50)} {passage(0)} {noise(20)}"), (2, f"{noise(9)} {passage(0).upper()}!"), (3, passage(0, 4)), (4, f"{noise(30)} {passage(0, 0, 10, 30)} {noise(3)}"),
        (5, f"{noise(100)} {passage(0, 0, 3, 12)} {noise(9)}"), (6, passage(1, 2)), (7, passage(2)), (8, passage(3)), (9, passage(4)), (10, passage(5)),
        (11, f"q {passage(6)} q"), (12, noise(3000)), (13, None), (14, ""), (15, passage(0).replace(" ", ", ")), (16, f"{noise(5)} {passage(0)} {noise(4)} {passage(1)} {passage(0)}"),
        (17, passage(1, 0, 0, 12) + " " + noise(13))]


def frames(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in DOCS], "doc_id long, text string, item int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_finds_what_brute_force_finds(spark, limit):
    docs, items = frames(spark)
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, items, broadcast_bytes=limit).collect()}
    usable = [(i, t) for i, t in ITEMS if t and i not in (90, 91)]
    exp = {(d, i) for d, t in DOCS for i in contaminated(t, usable)}
    # items shorter than a mask are looked up whole; every found pair is real, and none is missed here
    short = {i for i, t in usable if len(t.split()) < 12}
    assert {p for p in got if p[1] not in short} == {p for p in exp if p[1] not in short}
    assert {(10, 5), (11, 6)} <= got <= exp


def measures(text, item):
    """Every window of the item on every diagonal."""
    d, w = (text or "").replace(",", " ").replace("!", "").lower().split(), item.split()
    width = min(16, len(w))
    need = len(w) if len(w) < 11 else -(-width * 4 // 5)
    found = {}
    for shift in range(-len(w), len(d)):
        same = [0 <= shift + i < len(d) and d[shift + i] == w[i] for i in range(len(w))]
        good = [(sum(same[f:f + width]), f + shift) for f in range(len(w) - width + 1) if sum(same[f:f + width]) >= need]
        if good:
            found[shift] = (max(g[0] for g in good), min(g[1] for g in good))
    return (max(e for e, _ in found.values()), width, len(found), max(0, min(p for _, p in found.values()))) if found else None


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_measures_are_those_of_all_windows(spark, limit):
    docs, items = frames(spark)
    more = [(100 + k, f"{noise(k)} {passage(k % 4, k % 4)} {noise(3)} {passage(0, 2, 0, 20 + k % 9)}") for k in range(40)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, 0) for i, t in more], docs.schema))
    got = {(r.doc_id, r.item_id): (r.equal_words, r.window, r.n_places, r.doc_word) for r in decontam.overlaps(docs, items, broadcast_bytes=limit).collect()}
    exp = {(d, i): measures(t, w) for d, t in [*DOCS, *more] for i, w in ITEMS if w and w.strip(" ,.")}
    assert got == {k: v for k, v in exp.items() if v} and len(got) > 60


def test_substitutions_anywhere(spark):
    words = [f"t{i}" for i in range(50)]
    texts = []
    for k in range(200):
        w = list(words)
        for at in rng.sample(range(50), 5):
            w[at] = f"sub{k}"
        texts.append((k, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = decontam.overlaps(docs, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).count()
    assert got == 200


def test_clean_drops_only_holders(spark):
    docs, items = frames(spark)
    left = {r.doc_id for r in decontam.clean(docs, items.where("item_id < 5")).collect()}
    assert left == {5, 10, 11, 12, 13, 14, 17}
    assert decontam.clean(docs, items.limit(0)).count() == len(DOCS)
    assert decontam.overlaps(docs.limit(0), items).count() == 0


def test_nulls_and_repeats(spark):
    w = " ".join(f"u{i}" for i in range(20))
    docs = spark.createDataFrame([(None, w), (1, w), (1, w)], "doc_id long, text string")
    items = spark.createDataFrame([(None, w), (3, w), (3, w)], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontam.overlaps(docs, items).collect())
    assert got == [("1", "3"), ("1", "None"), ("None", "3"), ("None", "None")]


@pytest.mark.parametrize("n,wrong,limit", [(11, 2, 1), (12, 2, 1), (13, 2, 1), (14, 2, 1), (15, 3, 1), (16, 3, 1), (20, 4, 1), (12, 2, 0), (16, 3, 0)])
def test_every_accepted_substitution_pattern(spark, n, wrong, limit):
    item = [f"t{i}" for i in range(n)]
    texts = [(k, " ".join("zzz" if i in at else w for i, w in enumerate(item))) for k, at in enumerate(combinations(range(n), wrong))]
    exp = {k for k, t in texts if contaminated(t, [(7, " ".join(item))])}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = decontam.overlaps(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), broadcast_bytes=limit * decontam.BROADCAST_BYTES)
    rows = out.collect()
    assert {r.doc_id for r in rows} == exp and len(rows) == len(exp)
    assert all(r.window == min(n, 16) and r.equal_words >= 0.8 * r.window and r.n_places >= 1 for r in rows)


def test_short_items_are_reported_but_drop_nothing(spark):
    eight = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, "oh yes indeed"), (2, f"so {eight} nine"), (3, "neither")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Yes"), (2, eight)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, items).collect()} == {(1, 1), (2, 2)}
    assert {r.doc_id for r in decontam.clean(docs, items).collect()} == {1, 3}
    assert {r.doc_id for r in decontam.clean(docs, items, drop_words=1).collect()} == {3}


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_pieces_do_not_change_what_is_found(spark, monkeypatch, limit):
    docs, items = frames(spark)
    exp = sorted(map(tuple, decontam.overlaps(docs, items, broadcast_bytes=limit).collect()))
    monkeypatch.setattr(decontam, "PIECE", 5)
    assert sorted(map(tuple, decontam.overlaps(docs, items, broadcast_bytes=limit).collect())) == exp


def test_a_hit_does_not_carry_its_document(spark):
    """60,000 words of passages: 400,000 hits, which with 480 KB of words each were 200 GB in one task."""
    items = [(i, noise(40)) for i in range(20)]
    text = " ".join(items[i % 20][1] for i in range(1500))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.item_id: (r.equal_words, r.n_places) for r in decontam.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: (16, 75) for i in range(20)}
