"""Chat formatting by schema fingerprints.

A record is a variant (any nested value). The paths of its fields, without their types,
are hashed to a fingerprint; the fingerprint selects a declarative mapping, and the mapping
turns the record, whatever its layout, into canonical turns (role, text). Turns are written
in a template that marks each turn, with a mask of the text a model is trained on.

Template: `<|im_start|>role`, newline, text, `<|im_end|>`, newline. Inside roles and texts
`<|` becomes `<|esc|` (and a newline in a role `<|nl|`), so no text can forge a mark, and
reading back undoes it exactly.

Defined cases: a null text is empty and a null role the empty role. A record of an unknown
layout keeps its row, with its fingerprint and null turns and output. A record without
turns gives an empty output. Turns with equal order are ordered by role and text. Repeated
records are formatted one by one (repeated conversation rows are turns of their own). Extra
columns pass through `canonical`; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import P

START, END, ESC, NL = "<|im_start|>", "<|im_end|>", "<|esc|", "<|nl|"
TURNS = "array<struct<role string, text string>>"


@dataclass(frozen=True)
class Layout:
    """``paths``: the layout's field paths. ``turns`` (path, role field, text field) maps a
    list of turns; ``flat`` maps fields: (role, paths joined by a blank line), in order."""
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()
    first: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)


#: Names of speakers as some layouts have them (fixed values).
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

LAYOUTS = (
    Layout(("messages[].content", "messages[].role"), turns=("messages", "role", "content")),
    Layout(("conversations[].from", "conversations[].value"), turns=("conversations", "from", "value"), roles=SPEAKERS),
    Layout(("conversations[].from", "conversations[].value", "system"), turns=("conversations", "from", "value"), roles=SPEAKERS,
           first=(("system", ("system",)),)),
    Layout(("turns[].speaker", "turns[].text"), turns=("turns", "speaker", "text"), roles=SPEAKERS),
    Layout(("prompt", "response"), flat=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout(("completion", "prompt"), flat=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout(("prompt", "response", "system"), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout(("answer", "question"), flat=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout(("instruction", "output"), flat=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout(("input", "instruction", "output"), flat=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout(("data.answer", "data.question"), flat=(("user", ("data.question",)), ("assistant", ("data.answer",)))),
)


def shape(paths: tuple[str, ...]) -> str:
    """The paths as a nested shape: <a:_, b:[<c:_>]>, fields in order of name."""
    tree: dict = {}
    for p in paths:
        at = tree
        for part in p.split("."):
            at = at.setdefault(part, {})

    def show(node: dict) -> str:
        if not node:
            return "_"
        inner = ", ".join(f"{k.removesuffix('[]')}: {f'[{show(v)}]' if k.endswith('[]') else show(v)}" for k, v in sorted(node.items()))
        return f"<{inner}>"

    return show(tree)


def record_shape(record: Column) -> Column:
    """The same shape, read from a record: its schema with scalar types blanked."""
    s = F.schema_of_variant(record)
    s = F.regexp_replace(s, r"(?<=[:<] ?)(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|BINARY|VARIANT|UUID|TIMESTAMP_NTZ|TIMESTAMP|DECIMAL\(\d+,\s?\d+\))(?=[,>])", "_")
    s = F.replace(s, F.lit("OBJECT<"), F.lit("<"))
    s = F.regexp_replace(s, r"ARRAY<((?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*)>", "[$1]")
    return s


def fingerprint(shape_text: Column) -> Column:
    return F.substring(F.md5(shape_text), 1, 16)


def _flat(record: Column, fields) -> Column:
    turns = []
    for role, paths in fields:
        parts = [F.coalesce(F.try_variant_get(record, "$." + p, "string"), F.lit("")) for p in paths]
        text = parts[0] if len(parts) == 1 else F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.array(*turns)


def _turns(record: Column, layout: Layout) -> Column:
    if layout.turns is None:
        return _flat(record, layout.flat)
    path, role, text = layout.turns
    got = F.try_variant_get(record, "$." + path, f"array<struct<`{role}` string, `{text}` string>>")

    def turn(t: Column) -> Column:
        who = F.coalesce(t[role], F.lit(""))
        if layout.roles:
            names = F.create_map(*[F.lit(x) for kv in layout.roles.items() for x in kv])
            who = F.coalesce(F.try_element_at(names, F.lower(F.trim(who))), who)
        return F.struct(who.alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))

    turns = F.transform(got, turn)
    return F.concat(_flat(record, layout.first), turns) if layout.first else turns


def canonical(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds fingerprint and turns; turns are null where no layout has the fingerprint."""
    out = records.withColumn("fingerprint", fingerprint(record_shape(F.col(record_col))))
    turns = F.lit(None).cast(TURNS)
    for lay in layouts:
        turns = F.when(F.col("fingerprint") == fingerprint(F.lit(shape(lay.paths))), _turns(F.col(record_col), lay)).otherwise(turns)
    empty = F.try_variant_get(F.col(record_col), "$.messages", "array<string>")
    return out.withColumn("turns", F.coalesce(turns, F.when(F.size(empty) == 0, F.array().cast(TURNS))))


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit(ESC))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit(ESC), F.lit("<|"))


def write(canon: DataFrame, id_col: str, trained: str = "assistant") -> DataFrame:
    """(id, formatted, mask): mask lists the trained texts as (turn, start, in_turn, length),
    in code points: start in the whole output, in_turn after the turn's mark."""
    key = P + "row"
    # equal records are formatted once and dealt out again: a row's key depends on its content alone
    rows = (canon.groupBy(id_col, "turns").agg(F.count("*").alias("copies"))
            .withColumn(key, F.struct(F.col(id_col).alias("id"), "copies", F.xxhash64(F.to_json("turns")).alias("h"))))
    turns = rows.select(key, F.posexplode_outer("turns").alias("pos", "t"), F.col("turns").isNull().alias("unknown"))
    head = F.concat(F.replace(escape(F.col("t.role")), F.lit("\n"), F.lit(NL)), F.lit("\n"))
    parts = turns.select(key, "unknown", "pos", (F.col("t.role") == trained).alias("train"), F.length(head).alias("in_turn"),
                         F.length(escape(F.col("t.text"))).alias("length"),
                         F.concat(F.lit(START), head, escape(F.col("t.text")), F.lit(END + "\n")).alias("piece"))
    before = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)))
    item = F.struct("pos", "piece", "train", (F.col("at") + len(START) + F.col("in_turn")).alias("start"), "in_turn", "length")
    whole = placed.groupBy(key).agg(F.max("unknown").alias("unknown"), F.sort_array(F.collect_list(item)).alias("items"))
    real = F.filter("items", lambda x: x["pos"].isNotNull())
    mask = F.transform(F.filter(real, lambda x: x["train"]), lambda x: F.struct(
        x["pos"].alias("turn"), x["start"].alias("start"), x["in_turn"].alias("in_turn"), x["length"].alias("length")))
    out = whole.select(F.col(f"{key}.id").alias(id_col), F.col(f"{key}.copies").alias(P + "copies"),
                       F.when(~F.col("unknown"), F.array_join(F.transform(real, lambda x: x["piece"]), "")).alias("formatted"),
                       F.when(~F.col("unknown"), mask).alias("mask"))
    return (out.withColumn(P + "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(P + "copies"))))
            .drop(P + "copy", P + "copies"))


def blocks(formatted: Column) -> Column:
    """What follows each turn's mark."""
    return F.slice(F.split(formatted, r"\Q" + START + r"\E", -1), F.lit(2), F.greatest(F.lit(0), F.size(F.split(formatted, r"\Q" + START + r"\E", -1)) - 1))


def read(formatted: Column) -> Column:
    """Turns (role, text) read back from the output."""
    def turn(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        body = F.substr(b, F.length(role) + 2, F.length(b) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape(F.replace(role, F.lit(NL), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(blocks(formatted), turn)


def read_masked(formatted: Column, mask: Column) -> Column:
    """The trained texts read back from the output under its mask."""
    cut = blocks(formatted)
    return F.transform(mask, lambda m: unescape(F.substr(F.get(cut, m["turn"]), m["in_turn"] + 1, m["length"])))


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the turns of each conversation, by turn, as a `messages` record."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return grouped.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))
