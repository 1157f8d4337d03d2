"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-case words (runs of letters and digits). A mask such as 1101100101011
hashes the words at its ones and ignores those at its zeros, so a copied passage still
meets its seed when an ignored word was substituted. Seeds of all document positions are
joined with the benchmark's, and each hit is verified: every run of ``WINDOW`` words of the
item that contains the hit (the whole item, if shorter) against the document's words on the
same diagonal, of which at least ``SHARE`` must be equal.

With ``MASKS`` and ``MORE_MASKS`` together, some seed of an accepted window survives
whichever words were substituted: enumerated for every window of 11 to 16 words and every
pattern that ``SHARE`` accepts. ``MASKS`` alone miss 49 of 55 patterns of 2 words in 11, 31
of 66 in 12, 14 of 78 in 13, 5 of 91 in 14, and of 3 words 79 of 455 in 15, 45 of 560 in 16.
Another ``window`` or ``share`` has no such proof.

So what is found, and its measures, do not depend on the masks: an accepted window is one
of ``WINDOW`` words of the item (all of a shorter one), on any diagonal, of which at least
``SHARE`` are equal, and every one of them is looked at.

Everything is one map over the documents: words, seeds, the join with the benchmark's
seeds, and the check; only verified hits are shuffled. A document is cut into pieces of
``PIECE`` positions (with the words around them) before its seeds are made, and a hit carries
the few words that its windows look at, so memory follows neither a document's length nor the
number of its hits times that length. The benchmark's seeds are counted
first and broadcast when that count is below ``broadcast_bytes``; otherwise the seeds are
joined by shuffle and hits fetch their document's words by a second join.

Defined cases: null, empty or word-less texts on either side match nothing. Items shorter
than every mask of ``MASKS`` are looked up by all their words (whole item, no substitution). Repeated
documents with one id give one row per item; repeated items count as one item per id.
A null doc_id or item_id is kept as null. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import P
from tidemark.session import materialize

#: Weight 6 to 7 of a span of 11 or 12 words.
MASKS = ("110110010101", "101001101011", "11100101011")
#: Weight 6: with them no accepted substitution pattern is left without a seed.
MORE_MASKS = ("1110111", "1101001011", "111111", "1111101")
#: Items of fewer words are reported but drop no documents: 'Yes' is no leak.
DROP_WORDS = 8
WINDOW = 16
SHARE = 0.8
BROADCAST_BYTES = 64 << 20
SEED_BYTES = 96
#: Positions whose hits a task may hold at once.
PIECE = 128


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seed(h: Column, at: Column, mask: str, number: int) -> Column:
    """Hash of the words at the mask's ones from position ``at``; null past the end."""
    picked = [F.get(h, at + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(h), F.xxhash64(F.lit(number), *picked))


def _seeds(rows: DataFrame, masks: list[str], keep: list[str]) -> DataFrame:
    """(kept columns, at, mask, seed): every seed of every position; ``rows`` has the word hashes h."""
    at = rows.where(F.size("h") > 0).select(*keep, "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("at"))
    return _every_seed(at, masks, keep, "at")


def _every_seed(at: DataFrame, masks: list[str], keep: list[str], place: str) -> DataFrame:
    every = F.array(*[_seed(F.col("h"), F.col(place), m, i) for i, m in enumerate(masks)])
    return at.select(*keep, "h", place, F.posexplode(every).alias("mask", "seed")).where(F.col("seed").isNotNull())


def _piece_seeds(rows: DataFrame, masks: list[str], keep: list[str], reach: int) -> DataFrame:
    """``_seeds`` of documents, made piece by piece: h is a piece with ``reach`` words around it,
    ``local`` the position in it, ``at`` that in the document."""
    # the lambda keeps Spark from compiling both explodes into one loop, which would hold all rows of a document
    cut = F.transform(F.sequence(F.lit(0), F.size("h") - 1, F.lit(PIECE)), lambda a: F.struct(
        a.alias("first"), F.greatest(a - reach, F.lit(0)).alias("start"),
        F.slice("h", F.greatest(a - reach, F.lit(0)) + 1, F.least(a, F.lit(reach)) + PIECE + reach).alias("h")))
    pieces = rows.where(F.size("h") > 0).select(*keep, F.explode(cut).alias("p")).select(*keep, "p.first", "p.start", "p.h")
    local = F.sequence(F.col("first") - F.col("start"), F.least(F.col("first") - F.col("start") + PIECE, F.size("h")) - 1)
    made = _every_seed(pieces.select(*keep, "start", "h", F.explode(local).alias("local")), masks, [*keep, "start"], "local")
    return made.withColumn("at", F.col("start") + F.col("local"))


def _near(h: Column, at: Column, reach: int) -> list[Column]:
    """The words around a hit, and where in them it is."""
    lo = F.greatest(at - reach, F.lit(0))
    return [F.slice(h, lo + 1, F.lit(2 * reach)).alias("near"), (at - lo).alias("near_at")]


def _windows(h: Column, item: Column, lo: Column, hi: Column, width: Column, shift: Column) -> Column:
    """Equal words of each of the item's windows that begin at ``lo`` to ``hi``, the document's words ``h`` ``shift`` further on."""
    same = F.transform(F.sequence(lo, hi + width - 1), lambda i: F.when(F.get(h, i + shift) == F.get(item, i), 1).otherwise(0))
    return F.transform(F.sequence(F.lit(0), hi - lo), lambda f: F.aggregate(F.slice(same, f + 1, width), F.lit(0), lambda a, x: a + x))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS,
             window: int = WINDOW, share: float = SHARE, keep: list | None = None,
             broadcast_bytes: int = BROADCAST_BYTES, more_masks: tuple[str, ...] = MORE_MASKS) -> DataFrame:
    """Verified overlaps: id, kept columns, item id, equal_words (most of an accepted window) of
    window words, n_places (diagonals with an accepted window), doc_word (where the first accepted
    window begins in the document)."""
    span, least = max(map(len, masks)), min(map(len, masks))
    masks = [*masks, *more_masks]
    items = benchmark.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text_col)).alias("ih"))
    items = materialize(items.withColumn("item_key", F.xxhash64("item", "ih")).dropDuplicates(["item_key"]), "items")
    short = [r["n"] for r in items.select(F.size("ih").alias("n")).where((F.col("n") > 0) & (F.col("n") < span)).distinct().collect()]
    seeds = _seeds(items.where(F.size("ih") >= least).withColumnRenamed("ih", "h"), masks, ["item_key"])
    number = F.col("mask")
    if short:  # at most span - 1 different lengths
        whole = ["1" * n for n in sorted(short)]
        little = _seeds(items.where(F.size("ih").isin(short)).withColumnRenamed("ih", "h"), masks + whole, ["item_key"])
        seeds = seeds.unionByName(little.where(number >= len(masks)))
        masks = masks + whole
    seeds = materialize(seeds.select("seed", "item_key", F.col("at").alias("item_at"),
                                     F.get(F.array(*[F.lit(len(m)) for m in masks]), number).alias("span")), "item_seeds")
    small = seeds.count() * SEED_BYTES <= broadcast_bytes

    kept = [F.col(id_col).alias(P + "id"), *[c.alias(f"{P}k{i}") for i, c in enumerate(keep or [])]]
    names = [P + "id", *[f"{P}k{i}" for i in range(len(keep or []))]]
    rows = docs.select(*kept, word_hashes(F.col(text_col)).alias("h"))
    reach = max(window, *map(len, masks))
    found = ["item_key", "at", "item_at", "span"]
    if small:
        hits = _piece_seeds(rows, masks, names, reach).join(F.broadcast(seeds), "seed")
        hits = hits.select(*names, *found, *_near(F.col("h"), F.col("local"), reach)).join(F.broadcast(items), "item_key")
    else:
        keyed = rows.withColumn(P + "key", F.xxhash64("h"))
        met = _piece_seeds(keyed, masks, [*names, P + "key"], reach).drop("h", "local", "start", "mask").join(seeds, "seed")
        met = met.select(*names, P + "key", *found).distinct()
        same = reduce(lambda a, b: a & b, [F.col("a." + c).eqNullSafe(F.col("b." + c)) for c in [*names, P + "key"]])
        hits = (met.alias("a").join(keyed.dropDuplicates([*names, P + "key"]).alias("b"), same)
                .select("a.*", *_near(F.col("b.h"), F.col("a.at"), reach)))
        hits = hits.join(items, "item_key")
    n, shift = F.size("ih"), F.col("at") - F.col("item_at")
    width = F.least(F.lit(window), n)
    need = F.ceil(width * F.lit(share))
    last = F.least(F.col("item_at"), n - width)
    begin = F.greatest(F.lit(0), F.least(last, F.col("item_at") + F.col("span") - width))
    seen = hits.withColumn("equal", _windows(F.col("near"), F.col("ih"), begin, last, width, F.col("near_at") - F.col("item_at")))
    good = seen.where(F.array_max("equal") >= need)
    first = begin + F.array_position(F.transform("equal", lambda x: x >= need), True) - 1
    places = good.groupBy(*names, "item", shift.alias("shift")).agg(
        F.max(F.array_max("equal")).alias("equal"), F.max(width).alias("width"), F.min(first + shift).alias("place"))
    out = places.groupBy(*names, "item").agg(
        F.max("equal").cast("long").alias("equal_words"), F.max("width").cast("long").alias("window"),
        F.count("*").alias("n_places"), F.greatest(F.lit(0), F.min("place")).cast("long").alias("doc_word"))
    return (out.withColumnRenamed(P + "id", id_col).withColumnRenamed("item", item_col))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          drop_words: int = DROP_WORDS) -> DataFrame:
    """``docs`` without the documents that hold a passage of a benchmark item of ``drop_words`` words or more."""
    benchmark = benchmark.where(F.size(words(F.col("text"))) >= drop_words)
    key = F.xxhash64(F.col(text_col))
    bad = overlaps(docs, benchmark, id_col, text_col, keep=[key]).select(
        F.col(id_col).alias(P + "id"), F.col(f"{P}k0").alias(P + "key")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(P + "id")) & (key == F.col(P + "key")), "left_anti")
