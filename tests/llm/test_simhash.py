import random

import pytest
from brute import fingerprint, groups
from pyspark.sql import functions as F

from tidemark.llm import simhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", "one", "one two", "A b C d É", "x " * 400, "a\tb\nc\x0bd\x0ce\rf", "é ü ñ ö"])
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def test_long_texts_in_blocks():
    text = " ".join(str(i % 977) for i in range(5000))
    assert simhash.fingerprint(text.encode(), 3, block=64) == simhash.fingerprint(text.encode()) == fingerprint(text)


def test_every_pair_within_two_bits_is_linked(spark):
    rng = random.Random(1)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    exp = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert got == exp and len(exp) > 100


@pytest.mark.parametrize("bits", [0, 1])
def test_smaller_thresholds(spark, bits):
    fps = [5 ^ (1 << i) for i in range(20)] + [5]
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits).count()
    assert got == sum((a ^ b).bit_count() <= bits for a in fps for b in fps if a < b)


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(900 + i, t) for i, t in enumerate([None, "", " \n", "Hi", "hi", "hi there"])]
    rows += [(901, "a second text of one id"), (None, "hi"), (None, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    fps = [fingerprint(t) for _, t in rows]
    least = {}
    of = groups(fps)
    for (i, _), g in zip(rows, of):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    exp = sorted((str(i), f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, of))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == exp


def test_empty_and_one_per_group(spark):
    schema = "doc_id long, text string, source string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    same = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (None, "a b c d", "z"), (7, None, None), (8, "", "q"),
            (9, "other words stand here now", "x")]
    kept = simhash.one_per_group(spark.createDataFrame(same, schema))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 9]


def test_replicas_are_not_broadcast(spark):
    """Spark sizes them as the fingerprints they are made of, and 60 to 70 times that went through the driver."""
    fps = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    assert "Broadcast" not in simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
