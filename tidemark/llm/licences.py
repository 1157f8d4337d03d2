"""License scans by sentence rules.

Texts are cut into sentences; a normalised sentence found in the sentence table becomes a
sentence id; the ids of a document, in order, are matched with rules, each an ordered list
of sentence ids. The longest rule at a place wins, and a match inside a longer one goes.

Sentences end at . ! ? ; or : before white space, and at blank lines. Licence text is often
wrapped, and licence lines often stand alone or follow a copyright line, so every run of
consecutive lines of such a piece is looked up: a run can begin at any line with which a
known sentence begins. Comment signs fall away with the punctuation; those that hold an end
of a sentence, or a word, go before the cut. What lies inside a longer find is left out. The table's sentences are cut by the same rule: one
whose pieces are all in the table stands for these in the rules, another one that splits
('..., v. 2.0.') is looked up in as many consecutive pieces. Between two sentences of one rule at most
``MAX_GAP`` unknown sentences may stand. A list number ('1.', '(b)') is no sentence there,
although it has a number of its own, and a sentence is found with or without one before it.

Only sentences in the table leave the map stage; the table is a fixed list, in the plan.

A name inside a sentence ("Neither the name of Example Inc. nor ...") is first replaced by
the words that the table has for it (SLOTS).

Defined cases: a find gives one row. Null or empty texts, and texts without a known sentence,
give no row. A text of any length is cut whole. Repeated documents are found once for each id and text. Null ids are kept. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import P

MAX_GAP = 3

#: Well-known licence sentences, as published, by id.
SENTENCES = {
    "mit-ref": "Released under the MIT License.",
    "mit-ref-2": "This project is licensed under the MIT License.",
    "mit-ref-3": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-head": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-ref-2": "Licensed under the GNU General Public License v3.0.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-free-1": "This program is free software:",
    "gpl-free-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-fitness": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-ref": "Licensed under the BSD 3-Clause License.",
    "gpl2-modify": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl-free": "This library is free software;",
    "lgpl-modify": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl-version": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-modify": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-modify": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-zero": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "rights": "All rights reserved.",
}

#: Rules by id, each with its licence and its sentences in order.
RULES = {
    "mit-text": ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    "mit-short": ("MIT", ["mit-grant", "mit-notice"]),
    "mit-named": ("MIT", ["mit-ref"]),
    "mit-project": ("MIT", ["mit-ref-2"]),
    "mit-licensed": ("MIT", ["mit-ref-3"]),
    "apache-notice": ("Apache-2.0", ["apache-head", "apache-use", "apache-copy", "apache-warranty", "apache-see"]),
    "apache-notice-short": ("Apache-2.0", ["apache-head", "apache-use"]),
    "apache-named": ("Apache-2.0", ["apache-ref"]),
    "gpl3-notice": ("GPL-3.0-or-later", ["gpl-free-1", "gpl-free-2", "gpl-hope", "gpl-fitness"]),
    "gpl3-notice-joined": ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    "gpl3-free": ("GPL-3.0-or-later", ["gpl-free-1", "gpl-free-2"]),
    "gpl3-named": ("GPL-3.0", ["gpl3-ref"]),
    "gpl3-short": ("GPL-3.0", ["gpl3-ref-2"]),
    "bsd-3": ("BSD-3-Clause", ["bsd-redistribute", "bsd-endorse"]),
    "bsd-2": ("BSD-2-Clause", ["bsd-redistribute"]),
    "bsd-4": ("BSD-4-Clause", ["bsd-redistribute", "bsd-advertise", "bsd-endorse"]),
    "bsd-4-short": ("BSD-4-Clause", ["bsd-redistribute", "bsd-advertise"]),
    "bsd-named": ("BSD-3-Clause", ["bsd-ref"]),
    "gpl2-notice": ("GPL-2.0-or-later", ["gpl-free-1", "gpl2-modify", "gpl2-version", "gpl-hope", "gpl-fitness"]),
    "gpl2-free": ("GPL-2.0-or-later", ["gpl-free-1", "gpl2-modify", "gpl2-version"]),
    "gpl2-only": ("GPL-2.0-only", ["gpl-free-1", "gpl2-only"]),
    "lgpl21-free": ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-modify", "lgpl-version"]),
    "lgpl3-free": ("LGPL-3.0-or-later", ["lgpl-free", "lgpl3-modify"]),
    "lgpl3-program": ("LGPL-3.0-or-later", ["gpl-free-1", "lgpl3-modify"]),
    "agpl3-free": ("AGPL-3.0-or-later", ["gpl-free-1", "agpl3-modify"]),
    "isc": ("ISC", ["isc-grant"]),
    "unlicense": ("Unlicense", ["unlicense"]),
    "epl": ("EPL-2.0", ["epl-2"]),
    "cc-by": ("CC-BY-4.0", ["cc-by"]),
    "cc-by-nc": ("CC-BY-NC-4.0", ["cc-by-nc"]),
    "cc-by-sa": ("CC-BY-SA-4.0", ["cc-by-sa"]),
    "cc0": ("CC0-1.0", ["cc-zero"]),
    "mpl": ("MPL-2.0", ["mpl-2"]),
    "mit-or-apache": ("MIT OR Apache-2.0", ["mit-ref", "apache-ref"]),
}

#: A sentence with a name in it, and the words that the table has for the name.
SLOTS = [(r"(?is)\bneither\W+the\W+name\W+of\W.{1,200}?\Wnor\W+the\W+names\W+of\W+its\W+contributors\b",
          "Neither the name of the copyright holder nor the names of its contributors")]

END = r"(?<=[.!?;:])\s+|\n\s*\n"
NUMBER = r"[^\p{L}\p{N}]*(?:\p{N}{1,3}|\p{L}|[ivxIVX]{1,5})"
#: A piece that is a list number or has no word, and a list number before a sentence.
NO_SENTENCE = rf"^(?:{NUMBER})?[^\p{{L}}\p{{N}}]*$"
NUMBERED = rf"^{NUMBER}[.)]+\s+"
NUMBERED_ASCII = r"^\W*(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})[.)]+\s+"
#: Comment signs that the cut would take for the end of a sentence, or the lookup for a word.
COMMENT = r"(?m)^[ \t]*(?:;+|!+|::+|(?i:@?rem|dnl)\b)[ \t]*"


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def pieces(text: Column) -> Column:
    text = F.regexp_replace(text, COMMENT, "")
    for pattern, words in SLOTS:
        text = F.regexp_replace(text, pattern, words)
    return F.split(text, END)


def lines(cut: Column) -> Column:
    """Lines with a word as (sentence, line, text)."""
    return F.flatten(F.transform(cut, lambda s, i: F.filter(F.transform(F.split(s, "\n"), lambda x, j: F.struct(
        i.alias("sentence"), j.alias("line"), x.alias("text"))), lambda x: x["text"].rlike(r"[\p{L}\p{N}]"))))


def first_words(sentence: str) -> set[str]:
    """What a line that begins a sentence has as its first two words: they, or its one word."""
    words = re.sub(r"[\W_]+", " ", sentence.lower()).split()
    return {" ".join(words[:2]), words[0]} if words else set()


def opens(line: Column, known: set[str]) -> Column:
    """Whether a line may begin a known sentence, from its first characters with a word: most
    lines are settled by this lookup, whatever the size of the table."""
    head = F.substring(F.regexp_replace(line, r"^[^\p{L}\p{N}]+", ""), 1, 100)
    key = F.substring_index(normal(unnumbered(head)), " ", 2)
    return key.isin(*sorted(known))


def unnumbered(sentence: Column) -> Column:
    return F.regexp_replace(sentence, NUMBERED, "")


def skipped(cut: Column) -> Column:
    """Numbers of the pieces that don't count as sentences between two others."""
    at = F.transform(cut, lambda s, i: F.when((F.length(s) < 32) & s.rlike(NO_SENTENCE), i))
    return F.filter(at, lambda i: i.isNotNull())


def parts(sentence: str) -> list[str]:
    return [x for x in re.split(END, sentence) if x.strip()]


def in_pieces(sentences: dict[str, str]) -> dict[str, list[str]]:
    """Sentences whose pieces are all sentences of the table, with the ids of these."""
    plain = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    ids = {plain(v): k for k, v in sorted(sentences.items(), reverse=True) if len(parts(v)) == 1}
    cut = {k: [ids.get(plain(x)) for x in parts(v)] for k, v in sentences.items()}
    return {k: v for k, v in cut.items() if len(v) > 1 and None not in v}


def sentence_table(sentences: dict[str, str]) -> Column:
    """Known sentences as an array of (norm, sid, more): more is the number of pieces after the first."""
    return F.array(*[F.struct(normal(unnumbered(F.lit(v))).alias("norm"), F.lit(k).alias("sid"), F.lit(max(0, len(parts(v)) - 1)).alias("more"))
                     for k, v in sorted(sentences.items())])


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: as a generator's output it is not
    written out again in every later expression and filter that uses it."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def sentences_found(docs: DataFrame, id_col: str, text_col: str, sentences: dict[str, str]) -> DataFrame:
    """(id, key, sentence, line, sid, nth, end, nth_end): key tells texts with one id apart; nth numbers the sentences that count."""
    sentences = {k: v for k, v in sentences.items() if k not in in_pieces(sentences)}
    more = max(len(parts(v)) for v in sentences.values()) - 1
    bound = max(len(v.split()) + 2 * sum(not c.isalnum() for c in v) for v in sentences.values())  # words, and so lines, at most
    keys, known = [F.col(id_col), F.col(P + "key")], F.col(P + "known")
    norms = F.transform(sentence_table(sentences), lambda k: k["norm"])
    known_words = set().union(*[first_words(re.sub(NUMBERED_ASCII, "", v)) for v in sentences.values()])
    text = docs.select(F.col(id_col), F.xxhash64(text_col).alias(P + "key"), pieces(F.col(text_col)).alias("cut"))
    read = text.select(*keys, skipped(F.col("cut")).alias("skip"), lines(F.col("cut")).alias("u"))
    # a run is the lines from a place on where a known sentence can begin; only these lines are normalised
    begins = F.transform("u", lambda x, i: F.when(opens(x["text"], known_words), i))
    # an inner explode would infer a filter, pushed down to the texts, that cuts all of them once more
    run = read.withColumn("i", F.explode_outer(F.filter(begins, lambda i: i.isNotNull()))).where(F.col("i").isNotNull())
    first = F.get("u", F.col("i"))
    after = F.filter(F.slice("u", F.col("i") + 2, F.lit(bound)), lambda x: x["sentence"] <= first["sentence"] + more)
    run = run.select(*keys, "skip", first.alias("first"), after.alias("after")).withColumn("bare", normal(unnumbered(F.col("first.text"))))
    run = run.where((F.col("bare") != "") & F.exists(norms, lambda k: F.startswith(k, F.col("bare"))))
    run = once(run, "rest", F.array_join(F.concat(F.array("bare"), F.transform("after", lambda x: normal(x["text"]))), "\n"))
    flat = once(run, "flat", F.translate("rest", "\n", " ")).withColumn(P + "known", sentence_table(sentences))
    begun = lambda n: F.substring(F.col("rest"), F.lit(1), n)
    last = lambda n: F.coalesce(F.get("after", F.length(begun(n)) - F.length(F.translate(begun(n), "\n", "")) - 1), F.col("first"))
    whole = lambda n: (F.length("flat") == n) | (F.substring(F.col("rest"), n + 1, F.lit(1)) == "\n")
    fits = F.filter(known, lambda k: F.startswith(F.col("flat"), k["norm"]) & whole(F.length(k["norm"])) & (
        last(F.length(k["norm"]))["sentence"] - F.col("first.sentence") == k["more"]))
    longest = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k["norm"]).alias("n"), k["norm"].alias("norm"))))
    best = (once(flat, "m", longest).where(F.col("m").isNotNull())
            .withColumn("sid", F.array_min(F.transform(F.filter(known, lambda k: k["norm"] == F.col("m.norm")), lambda k: k["sid"]))))
    end = F.struct(last(F.col("m.n"))["sentence"].alias("sentence"), last(F.col("m.n"))["line"].alias("line"))
    nth = lambda at: at - F.size(F.filter("skip", lambda i: i < at))
    found = (best.withColumn("end", end).select(*keys, "first.sentence", "first.line", "sid", "end", nth(F.col("first.sentence")).alias("nth"),
                                                nth(F.col("end.sentence")).alias("nth_end")).distinct())
    before = W.partitionBy(id_col, P + "key").orderBy("sentence", "line").rowsBetween(W.unboundedPreceding, -1)
    inside = F.max("end").over(before) >= F.col("end")
    return found.withColumn("inside", F.coalesce(inside, F.lit(False))).where(~F.col("inside")).drop("inside")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None,
         rules: dict[str, tuple[str, list[str]]] | None = None, max_gap: int = MAX_GAP) -> DataFrame:
    """One row per match: id, rule_id, licence, first_sentence, last_sentence, n_sentences."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    split = in_pieces(sentences)
    rules = {r: (name, [x for k in sids for x in split.get(k, [k])]) for r, (name, sids) in rules.items()}
    found = sentences_found(docs, id_col, text_col, sentences)
    # the ids that follow are seen through a look-ahead as long as the longest rule
    depth = max(len(s) for _, s in rules.values())
    doc = W.partitionBy(id_col, P + "key").orderBy("sentence", "line", "sid")
    ahead = found.withColumns({f"s{k}": F.lead("sid", k).over(doc) for k in range(1, depth)} |
                              {f"p{k}": F.lead("end.sentence", k).over(doc) for k in range(1, depth)} |
                              {f"g{k}": F.lead("nth", k).over(doc) for k in range(1, depth)} |
                              {f"e{k}": F.lead("nth_end", k).over(doc) for k in range(1, depth)} |
                              {"s0": F.col("sid"), "p0": F.col("end.sentence"), "e0": F.col("nth_end"), "n": F.row_number().over(doc)})
    best = F.lit(None).cast("struct<rule_id:string,licence:string,n_sentences:int,last_sentence:int>")
    for rule, (name, ids) in sorted(rules.items(), key=lambda r: (len(r[1][1]), r[0])):
        hit = F.lit(True)
        for k, sid in enumerate(ids):
            hit = hit & (F.col(f"s{k}") == sid)
            if k:
                hit = hit & (F.col(f"g{k}") - F.col(f"e{k - 1}") <= max_gap + 1)
        best = F.when(hit, F.struct(F.lit(rule).alias("rule_id"), F.lit(name).alias("licence"), F.lit(len(ids)).alias("n_sentences"),
                                    F.col(f"p{len(ids) - 1}").alias("last_sentence"))).otherwise(best)
    matched = ahead.withColumn("m", best).where(F.col("m").isNotNull()).withColumn("end", F.col("n") + F.col("m.n_sentences"))
    earlier = W.partitionBy(id_col, P + "key").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    free = matched.withColumn("covered", F.max("end").over(earlier)).where(F.col("covered").isNull() | (F.col("end") > F.col("covered")))
    return free.select(F.col(id_col), "m.rule_id", "m.licence", F.col("sentence").cast("long").alias("first_sentence"),
                       F.col("m.last_sentence").cast("long").alias("last_sentence"), F.col("m.n_sentences").cast("long").alias("n_sentences"))
