from brute import line_dedup

from tidemark.llm import linededup


def check(spark, rows, min_docs, min_chars=1):
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in rows], "doc_id long, text string, pos string")
    out = linededup.drop_frequent_lines(df, min_docs=min_docs, min_chars=min_chars)
    assert out.columns == ["doc_id", "text", "pos", "n_lines", "n_dropped"]
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in out.collect())
    kept = line_dedup(rows, min_docs, min_chars)
    exp = sorted((str(i), k, len((t or "").split("\n")),
                  len((t or "").split("\n")) - _kept(t, rows, min_docs, min_chars)) for (i, t), k in zip(rows, kept))
    assert got == exp


def _kept(t, rows, min_docs, min_chars):
    from collections import defaultdict

    from brute import SPACE, lower
    seen = defaultdict(set)
    for i, x in rows:
        for line in (x or "").split("\n"):
            seen[lower(line.strip(SPACE))].add(i)
    return sum(not (len(seen[lower(x.strip(SPACE))]) >= min_docs and len(lower(x.strip(SPACE))) >= min_chars) for x in (t or "").split("\n"))


ROWS = [(1, "Menu\nalpha\n  menu\t\n"), (2, "MENU\nbeta\n\n"), (3, "menu"), (4, None), (5, ""), (6, "É menu\nÉ MENU"), (7, "alpha\r\nbeta"),
        (8, "x" * 50_000 + "\nmenu"), (9, "\n".join(["menu"] * 500 + ["tail"])), (9, "second row\nmenu"), (3, "menu")]


def test_brute_force(spark):
    check(spark, ROWS, 3)
    check(spark, ROWS, 2)


def test_short_keys_stay(spark):
    check(spark, [(i, "ab\nabc") for i in range(5)], 3, min_chars=3)


def test_shuffle_join_gives_the_same(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        check(spark, ROWS, 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_nulls_and_empty_table(spark):
    assert linededup.drop_frequent_lines(spark.createDataFrame([], "doc_id long, text string, n_lines string")).count() == 0
    rows = spark.createDataFrame([(None, "a\nb", None), (None, "a\nb", None), (None, "a", "z"), (2, "a", None)], "doc_id long, text string, lang string")
    out = linededup.drop_frequent_lines(rows, min_docs=2).collect()
    assert sorted((str(r.doc_id), r.text, str(r.lang), r.n_dropped) for r in out) == [
        ("2", "", "None", 1), ("None", "", "z", 1), ("None", "b", "None", 1), ("None", "b", "None", 1)]
