"""Language ID by cross-parsing entropy.

For each language a suffix automaton of a bounded labelled reference text knows every
substring of it. A text is parsed greedily into phrases, each the longest match in the
reference; a text in the reference's language needs few. The count is normalised to an
entropy rate, phrases x log2(reference length) / letters, and the lowest rate wins.

A greedy parse only moves forward, so the automaton with its restarts at the root is a
plain transition table, and thousands of stretches of text walk all languages' tables in
step. Whole texts are parsed; the parse restarts at the root every ``window`` symbols (an
addition of less than one phrase a window, alike for all languages), which keeps a very
long text from being one serial walk; ``window=None`` parses each text without restarts.

The reference of a language is made of stretches of at most REF_DOCS labelled documents, at
seeded places anywhere in their texts; all of them share its REF_SYMBOLS symbols, the long
ones what the short ones leave. The model is counted: at most MAX_LANGS languages, those of
most documents, and beyond MODEL_BYTES of tables all references shrink alike. It travels to
the tasks as arrays, without this package.

Normalisation: lower case; letters stay, every run of anything else is one blank. All
letters of the references are symbols of their own: the ``ALPHABET`` most frequent have
columns in the table, the others' transitions are sorted keys, so a language of thousands
of letters costs its transitions only. Letters that no reference has are one shared symbol.

Defined cases: null text, empty text or text without a letter gives `und` with score 0.
Ties go to the language first in alphabetical order. Rows with null lang, and those held
out, are not learned from. No labelled rows: every text is `und`. Repeated rows are
predicted one by one; extra columns pass through, but one named lang_pred or score is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import P, by_value, fold, sample_ids, small_batches

by_value(__name__)

#: The reference of a language: REF_SYMBOLS symbols of at most REF_DOCS documents, PIECE of each at most.
REF_DOCS, REF_SYMBOLS, PIECE = 200, 1 << 15, 1 << 11
MAX_LANGS, MODEL_BYTES = 256, 256 << 20
ALPHABET = 62
WINDOW = 1024
FOLDS, HELD = 4, 2
SEED = 6
#: Symbols walked together.
LANES = 1 << 21
BLANK, OTHER = 0, 1


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.array([len(t) for t in low], dtype=np.int64)


def normal(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols:
        now = len(go)
        go.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p != -1:
            q = go[p][c]
            if longest[p] + 1 == longest[q]:
                link[now] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return go


def parse_table(go: list[dict[int, int]], width: int, base: int) -> np.ndarray:
    """table[(state - base) * width + symbol]: next state x width, its bits inverted where
    the symbol begins a phrase: at the root, and where no longer match goes on. A symbol
    that the reference lacks is a phrase of its own, after which the parse is at the root."""
    from_root = np.full(width, base * width, dtype=np.int32)
    for c, s in go[0].items():
        if c < width:
            from_root[c] = (base + s) * width
    table = np.tile(~from_root, (len(go), 1))
    for s, out in enumerate(go[1:], 1):
        for c, t in out.items():
            if c < width:
                table[s, c] = (base + t) * width
    return table.ravel()


def rare_steps(go: list[dict[int, int]], width: int, base: int, n: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The same for the ``n`` symbols from ``width`` on: (state x n + symbol, next) where a match goes on, and what begins a phrase."""
    from_root = np.full(n, base * width, dtype=np.int32)
    for c, s in go[0].items():
        if c >= width:
            from_root[c - width] = (base + s) * width
    on = [((base + s) * n + c - width, (base + t) * width) for s, out in enumerate(go[1:], 1) for c, t in out.items() if c >= width]
    return on, ~from_root


class Model:
    """Languages, the letters' symbols, one table for all languages, roots and entropy factors."""

    def __init__(self, references: dict[str, str], window: int | None = WINDOW):
        self.langs = sorted(references)
        self.window = window
        counts = Counter("".join(references.values()))
        counts.pop(" ", None)
        letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        # an automaton has at most two states a symbol, each with a row of 32-bit columns
        most = MODEL_BYTES // (8 * (min(len(letters), ALPHABET) + 2) * max(1, len(references)))
        references = {k: v[:most] for k, v in references.items()}
        self.symbol = {c: i + 2 for i, c in enumerate(letters)} | {" ": BLANK}
        self.width = min(len(letters), ALPHABET) + 2
        self.rare = len(letters) + 2 - self.width
        tables, roots, base, steps, begin = [], [], 0, [], []
        for lang in self.langs:
            go = suffix_automaton([self.symbol[c] for c in references[lang]])
            tables.append(parse_table(go, self.width, base))
            on, new = rare_steps(go, self.width, base, self.rare)
            steps += on
            begin.append(new)
            roots.append(base * self.width)
            base += len(go)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, dtype=np.int32)
        steps.sort()
        self.keys = np.array([k for k, _ in steps] + [np.iinfo(np.int64).max], dtype=np.int64)  # the last is no key
        self.goes = np.array([t for _, t in steps] + [0], dtype=np.int32)
        self.begin = np.stack(begin) if begin else np.zeros((0, self.rare), np.int32)
        self.factor = np.array([np.log2(max(2, len(references[x]))) for x in self.langs])

    def parts(self) -> dict:
        """Arrays, lists and dicts of plain values: what a task needs to have the model again."""
        return self.__dict__

    @staticmethod
    def of(parts: dict) -> Model:
        model = Model.__new__(Model)
        model.__dict__.update(parts)
        return model

    def next_states(self, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Table values of one symbol per lane for all languages' states."""
        if not self.rare:
            return self.table[state + sym]
        at = np.flatnonzero(sym >= self.width)
        value = self.table[state + np.where(sym < self.width, sym, BLANK)]
        if len(at):
            letter = sym[at] - self.width
            key = state[:, at].astype(np.int64) // self.width * self.rare + letter
            place = np.searchsorted(self.keys, key)
            value[:, at] = np.where(self.keys[place] == key, self.goes[place], self.begin[:, letter])
        return value

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised symbols of all texts in a row, and the text each belongs to."""
        codes, lengths = code_points(texts)
        kinds, at = np.unique(codes, return_inverse=True)
        kind = np.int32 if self.rare else np.uint8
        sym = np.array([self.symbol.get(c, OTHER if c.isalpha() else BLANK) for c in map(chr, kinds.tolist())],
                       dtype=kind)[at] if len(kinds) else np.zeros(0, kind)
        doc = np.repeat(np.arange(len(texts)), lengths)
        keep = sym != BLANK
        if len(sym):
            keep[1:] |= (sym[:-1] != BLANK) & (doc[1:] == doc[:-1])  # one blank after a letter
        return sym[keep], doc[keep]

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Entropy rate per text and language, and each text's number of letters."""
        sym, doc = self.symbols(texts)
        n, k = len(texts), len(self.langs)
        letters = np.bincount(doc[sym != BLANK], minlength=n)
        total = np.bincount(doc, minlength=n)
        first = np.concatenate(([0], np.cumsum(total)))[:-1]
        window = self.window or max(1, int(total.max(initial=1)))
        windows = -(-total // window)
        owner = np.repeat(np.arange(n), windows)
        nth = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(windows)))[:-1], windows)
        start = first[owner] + nth * window
        length = np.minimum(window, total[owner] - nth * window)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        phrases = np.zeros((k, len(owner)), dtype=np.int32)
        falling = -length
        for step in range(int(length[0]) if len(length) else 0):
            alive = int(np.searchsorted(falling, -step, side="left"))
            value = self.next_states(state[:, :alive], sym[start[:alive] + step])
            begins = value >> 31  # -1 or 0
            phrases[:, :alive] -= begins
            state[:, :alive] = value ^ begins
        per_text = np.stack([np.bincount(owner, row, n) for row in phrases], axis=1) if k else np.zeros((n, 0))
        return per_text * self.factor / np.maximum(total, 1)[:, None], letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        rate, letters = self.rates(texts)
        best = rate.argmin(axis=1)
        least = rate[np.arange(len(texts)), best]
        weight = np.exp(-8.0 * (rate - least[:, None]))
        score = np.where(letters > 0, 1.0 / weight.sum(axis=1), 0.0)
        return [self.langs[b] if m else "und" for b, m in zip(best.tolist(), letters.tolist())], score


def shares(lengths: list[int], total: int) -> list[int]:
    """``total`` dealt out evenly, what a short one cannot take to the longer ones."""
    out, left = [0] * len(lengths), total
    for k, i in enumerate(sorted(range(len(lengths)), key=lambda i: (lengths[i], i))):
        out[i] = min(lengths[i], left // (len(lengths) - k))
        left -= out[i]
    return out


def train(docs: DataFrame, seen, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          seed: int = SEED, window: int | None = WINDOW, max_langs: int = MAX_LANGS) -> Model:
    """References come from a bounded, seeded sample; only they reach the driver."""
    known = (docs.select(F.col(id_col).alias(P + "id"), F.col(lang_col).alias(P + "lang"))
             .where(F.col(P + "lang").isNotNull() & F.col(P + "id").isNotNull() & seen(F.col(P + "id"))))
    kept = known.groupBy(P + "lang").count().orderBy(F.desc("count"), P + "lang").limit(max_langs).select(P + "lang")
    picked = sample_ids(known.distinct().join(F.broadcast(kept), P + "lang", "left_semi"), P + "id", [P + "lang"], REF_DOCS, seed)
    letters = F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}]+", " "))
    place = F.pmod(F.xxhash64(P + "id", F.lit(seed + 1)), F.greatest(F.length("text") - PIECE + 1, F.lit(1))).cast("int") + 1
    got = (docs.select(F.col(id_col).alias(P + "id"), F.col(lang_col).alias(P + "lang"), letters.alias("text"))
           .join(F.broadcast(picked), [P + "id", P + "lang"])
           .select(P + "lang", F.xxhash64(P + "id", F.lit(seed)).alias("h"), F.substr("text", place, F.lit(PIECE)).alias("text")).collect())
    stretches: dict[str, list[str]] = {}
    for lang, _, text in sorted(got, key=lambda r: (r[0], r[1], r[2] or "")):
        if text and (text := normal(text)):
            stretches.setdefault(lang, []).append(text)
    return Model({lang: " ".join(t[:n] for t, n in zip(texts, shares([len(t) for t in texts], REF_SYMBOLS)) if n)[:REF_SYMBOLS]
                  for lang, texts in stretches.items()}, window)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1)."""
    docs = docs.drop("lang_pred", "score")
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model.parts())  # at most about MODEL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            langs, scores, lo, size = [], [], 0, 0
            for hi in range(1, len(texts) + 1):
                size += len(texts[hi - 1])
                if size >= LANES or hi == len(texts):
                    x, s = model.predict(texts[lo:hi])
                    langs += x
                    scores.append(s)
                    lo, size = hi, 0
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                                              T.StructField("score", T.DoubleType())]))


def not_held():
    return lambda doc_id: fold(doc_id, FOLDS) != HELD


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", window: int | None = WINDOW) -> DataFrame:
    return predict(docs, train(docs, not_held(), id_col, text_col, lang_col, window=window), text_col)
