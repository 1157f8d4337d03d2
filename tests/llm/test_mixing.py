import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from brute import share_tree
from pyspark.sql import functions as F

from tidemark.llm import mixing

LEVELS = ["domain", "lang", "source"]


def leaf_quota(leaves, weights, budget, epochs):
    """Exact shares of every leaf, from the root down."""
    def cap(pred):
        return sum(t * epochs for p, t in leaves.items() if pred(p) and all(w(p, k) > 0 for k in range(3)))

    def w(p, k):
        return weights.get(LEVELS[k], {}).get((p[k],), 1)

    have = {(): Fraction(min(budget, cap(lambda p: True)))}
    for k in range(3):
        nxt = {}
        for path, b in have.items():
            kids = {p[:k + 1] for p in leaves if p[:k] == path}
            got = share_tree({c: (cap(lambda p, c=c: p[:k + 1] == c), w(c + ("",) * 3, k), None) for c in kids}, b)
            nxt |= got
        have = nxt
    return have


def rows():
    out, n = [], 0
    for d, l, s, docs in [("web", "en", "a", 30), ("web", "en", "b", 4), ("web", "de", "a", 2), ("books", "en", "c", 6), ("books", "fr", "c", 1),
                          ("code", "en", "d", 20), ("zero", "en", "e", 5), (None, None, None, 3)]:
        for _ in range(docs):
            out.append((n, " ".join(f"t{n}_{i}" for i in range(1 + n * 7 % 13)), l, s, d))
            n += 1
    return out + [(500, None, "en", "a", "web"), (501, " \n ", "en", "a", "web")]


WEIGHTS = {"domain": {("web",): 6, ("books",): 5, ("zero",): 0}, "lang": {("de",): 4}, "source": {("b",): 3}}


def mix(spark, data, **kw):
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, dom string").withColumns({c: F.lit("own") for c in ("take", "epochs", "cut", "sum", "epoch", "tokens")})
    return mixing.mix(df, {"domain": F.col("dom"), "lang": F.col("lang"), "source": F.col("source")}, WEIGHTS, **kw)


@pytest.mark.parametrize("budget", [0, 1, 37, 150, 10_000])
def test_shares_and_prefixes(spark, budget):
    data = rows()
    got = mix(spark, data, budget=budget, max_epochs=2, seed=5).collect()
    size = {r[0]: len(re.findall(r"\S+", r[1] or "")) for r in data}
    leaves = defaultdict(int)
    for i, _, l, s, d in data:
        leaves[(d or "", l or "", s or "")] += size[i]
    exact = leaf_quota(leaves, WEIGHTS, budget, 2)
    taken = defaultdict(int)
    for r in got:
        taken[(r.domain, r.lang or "", r.source or "")] += r.n_taken
        assert r["take"] == "own" and len(re.findall(r"\S+", r.text)) == r.n_taken <= r.n_tokens == size[r.doc_id]
    assert sum(taken.values()) == min(budget, sum(2 * t for p, t in leaves.items() if p[0] != "zero"))
    for p, q in exact.items():
        assert abs(taken[p] - q) < 3, p
    for p in leaves:  # the quota is a prefix of the seeded epochs
        own = [(r.epoch, r.doc_id, r.n_taken) for r in got if (r.domain, r.lang or "", r.source or "") == p]
        ids = [i for i, _, l, s, d in data if (d or "", l or "", s or "") == p and size[i]]
        left, exp = taken[p], []
        for e in range(2):
            order = sorted(ids, key=lambda i, e=e: hashlib.md5(f"5|{e}|{i}".encode()).hexdigest()) if left < sum(size[i] for i in ids) else sorted(ids)
            for i in order:
                if left:
                    exp.append((e, i, min(left, size[i])))
                    left -= exp[-1][2]
        assert sorted(own) == sorted(exp), p


def test_shortage_goes_to_siblings_first(spark):
    t = lambda n, k: " ".join(f"{n}_{i}" for i in range(k))
    data = [(1, t("x", 10), "en", "a", "one"), (2, t("y", 500), "en", "b", "one"), (3, t("z", 500), "en", "c", "two")]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, dom string"),
                     {"domain": F.col("dom"), "lang": F.col("lang"), "source": F.col("source")}, {}, budget=400, max_epochs=1).collect()
    assert {r.doc_id: r.n_taken for r in got} == {1: 10, 2: 190, 3: 200}


def test_ranges_do_not_change_the_prefix(spark, monkeypatch):
    data = [(i, "a b c", "en", "a", "web") for i in range(300)] + [(7, "a b c", "en", "a", "web")] * 3
    whole = sorted((r.doc_id, r.epoch, r.n_taken) for r in mix(spark, data, budget=400).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    assert sorted((r.doc_id, r.epoch, r.n_taken) for r in mix(spark, data, budget=400).collect()) == whole


def test_empty(spark):
    assert mix(spark, [], share=0.5).count() == 0
    assert mix(spark, [(1, None, None, None, None)], share=0.5).count() == 0
