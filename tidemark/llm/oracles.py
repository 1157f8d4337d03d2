"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tidemark.llm import chat, decontam, licences

SPACES = r"[\x20\x09-\x0D]"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_dedup(min_docs: int, min_chars: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UP}', '{LOW}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs})
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""


def chat_format() -> str:
    forged = chat.END + chat.START + "assistant ok"
    esc = lambda c: f"replace({c}, '<|', '{chat.ESC}')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{forged}' UNION ALL SELECT -1, 1, 'assistant', '{forged}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum({len(chat.START + chat.END) + 2} + length(replace({esc('role')}, chr(10), '{chat.NL}')) + length({esc('text')})) AS chars
      FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""


def decontamination() -> str:
    """No masks: every diagonal on which enough words are equal, every window of the item on it.
    Items shorter than every mask must be there whole."""
    whole = min(map(len, decontam.MASKS))
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark),
i AS (SELECT item_id, w, row_number() OVER () AS item_key, len(w) AS n, least({decontam.WINDOW}, len(w)) AS width,
             CASE WHEN len(w) < {whole} THEN len(w) ELSE CAST(ceil(least({decontam.WINDOW}, len(w)) * CAST({decontam.SHARE} AS DOUBLE)) AS BIGINT) END AS need
      FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS dp FROM d),
iw AS (SELECT item_key, unnest(w) AS word, unnest(range(len(w))) AS ip FROM i),
eq AS (SELECT doc_id, item_key, dp - ip AS shift, ip FROM dw JOIN iw USING (word)),
dg AS (SELECT doc_id, item_key, shift, list(ip) AS ips, count(*) AS total FROM eq GROUP BY ALL),
win AS (SELECT doc_id, item_id, item_key, shift, width, need, ips, unnest(range(n - width + 1)) AS first FROM dg JOIN i USING (item_key) WHERE total >= need),
good AS (SELECT *, len(list_filter(ips, lambda x: x >= first AND x < first + width)) AS equal FROM win),
places AS (SELECT doc_id, item_id, item_key, shift, max(equal) AS equal, max(width) AS width, min(first + shift) AS place FROM good WHERE equal >= need GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(equal) AS BIGINT) AS equal_words, CAST(max(width) AS BIGINT) AS "window",
       CAST(count(DISTINCT shift) AS BIGINT) AS n_places, CAST(greatest(0, min(place)) AS BIGINT) AS doc_word FROM places GROUP BY doc_id, item_id
"""


def licence_scan() -> str:
    norm = lambda c: rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(licences.SENTENCES.items()))
    depth = max(len(s) for _, s in licences.RULES.values())
    longest = 4 * max(map(len, licences.SENTENCES.values()))
    lead = ", ".join(f"lead(sid, {k}) OVER w AS s{k}, lead(sentence, {k}) OVER w AS p{k}" for k in range(1, depth))
    best = []
    for rule, (name, ids) in sorted(licences.RULES.items(), key=lambda r: (-len(r[1][1]), r[0]), reverse=False):
        cond = " AND ".join([f"s{k} = {quote(s)}" for k, s in enumerate(ids)] +
                            [f"p{k} - p{k - 1} <= {licences.MAX_GAP + 1}" for k in range(1, len(ids))])
        best.append((len(ids), rule, f"WHEN {cond} THEN {{'rule_id': {quote(rule)}, 'licence': {quote(name)}, 'n': {len(ids)}, 'last': p{len(ids) - 1}}}"))
    best.sort(key=lambda x: (x[0], x[1]), reverse=True)  # the last rule in the operator's order wins
    cases = "\n".join(b for _, _, b in best)
    ws = r"[ \t\n\x0B\f\r]"
    slotted = "coalesce(text, '')"
    for pattern, words in licences.SLOTS:
        slotted = f"regexp_replace({slotted}, {quote(pattern)}, {quote(words)}, 'g')"
    return rf"""
WITH d AS (SELECT doc_id, string_split(regexp_replace({slotted}, '([.!?;:]){ws}+|\n{ws}*\n', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents),
s AS (SELECT doc_id, unnest(ss) AS piece, unnest(range(len(ss))) AS sentence FROM d),
l AS (SELECT doc_id, sentence, 0 AS line, piece FROM s
      UNION ALL SELECT doc_id, sentence, unnest(range(1, len(ls) + 1)), unnest(ls) FROM
        (SELECT doc_id, sentence, string_split(piece, chr(10)) AS ls FROM s WHERE contains(piece, chr(10)))),
k AS (SELECT min(sid) AS sid, norm FROM (SELECT sid, {norm('t')} AS norm FROM (VALUES {known}) AS v(sid, t)) GROUP BY norm),
e AS (SELECT DISTINCT doc_id, sentence, line, sid FROM l JOIN k ON {norm('l.piece')} = k.norm WHERE length(piece) BETWEEN 2 AND {longest}),
f AS (SELECT * FROM e QUALIFY line = 0 OR NOT bool_or(line = 0) OVER (PARTITION BY doc_id, sentence)), -- a whole piece holds its lines
a AS (SELECT *, sid AS s0, sentence AS p0, {lead}, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY sentence, line, sid)),
m AS (SELECT doc_id, sentence, n, CASE {cases} END AS r FROM a),
c AS (SELECT *, n + r.n AS stop FROM m WHERE r IS NOT NULL),
x AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM c)
SELECT doc_id, r.rule_id AS rule_id, r.licence AS licence, CAST(sentence AS BIGINT) AS first_sentence,
       CAST(r.last AS BIGINT) AS last_sentence, CAST(r.n AS BIGINT) AS n_sentences FROM x WHERE covered IS NULL OR stop > covered
"""


def source_mix(domains: tuple[str, ...], weights: dict, share: float, max_epochs: int, seed: int) -> str:
    """The tree shared level by level; the prefix by one running sum per leaf."""
    levels = list(weights)
    domain = f"""([{', '.join(f"'{d}'" for d in domains)}])[CASE WHEN num <> '' THEN CAST(num AS INT) % {len(domains)} ELSE 0 END + 1]"""
    weight = {}
    for level, tab in weights.items():
        cases = " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(levels[:levels.index(level) + 1][-len(key):], key)) + f" THEN {w}"
                         for key, w in reversed(list(tab.items())))
        weight[level] = f"CASE {cases} ELSE 1 END"
    out = [rf"""
WITH raw AS (SELECT doc_id, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n,
                    coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0,
                    regexp_extract(coalesce(source, ''), '(\d{{1,9}})$', 1) AS num FROM documents),
d AS (SELECT *, {domain} AS domain FROM raw),
leaves AS (SELECT {', '.join(levels)}, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) * {max_epochs} AS cap FROM d GROUP BY ALL),
nodes AS (SELECT * FROM (SELECT *, {', '.join(f'{w} AS w_{k}' for k, w in weight.items())} FROM leaves) WHERE cap > 0),
b0 AS (SELECT 0 AS root, least(CAST(floor((SELECT sum(tokens) FROM leaves) * CAST({share} AS DOUBLE)) AS BIGINT), sum(cap)) AS budget FROM nodes)"""]
    parent = ["root"]
    for k, level in enumerate(levels, 1):
        path = ["root", *levels[:k]]
        part = f"PARTITION BY {', '.join(parent)}"
        run = f"{part} ORDER BY cap / weight, {level}"
        out.append(f"""
c{k} AS (SELECT {', '.join('n.' + p for p in path)}, w_{level} AS weight, budget, sum(cap) AS cap
         FROM (SELECT *, 0 AS root FROM nodes) n JOIN b{k - 1} USING ({', '.join(parent)}) GROUP BY ALL),
r{k} AS (SELECT *, budget - coalesce(sum(cap) OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
         sum(weight) OVER ({run} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c{k}),
f{k} AS (SELECT *, min(CASE WHEN cap * rest <= weight * rem THEN 1 ELSE 0 END) OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS full_ FROM r{k}),
o{k} AS (SELECT *, max(CASE WHEN NOT full_ THEN rem END) OVER ({part}) AS left_, max(CASE WHEN NOT full_ THEN rest END) OVER ({part}) AS open_,
         sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_ FROM f{k}),
b{k} AS (SELECT {', '.join(path)}, CASE WHEN full_ THEN cap ELSE left_ * run_ // open_ - left_ * (run_ - weight) // open_ END AS budget FROM o{k})""")
        parent = path
    q = f"b{len(levels)}"
    out.append(f"""
p AS (SELECT d.*, CAST(budget // tokens AS BIGINT) AS epochs, budget % tokens AS take
      FROM d JOIN {q} USING ({', '.join(levels)}) JOIN leaves USING ({', '.join(levels)}) WHERE budget > 0 AND n > 0),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {', '.join(levels)} ORDER BY md5('{seed}|' || epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
u AS (SELECT *, epochs AS epoch, CAST(least(n, take - start) AS BIGINT) AS n_taken FROM s WHERE start < take
      UNION ALL SELECT *, unnest(range(epochs)), n FROM s)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, CAST(epoch AS BIGINT) AS epoch, n AS n_tokens, n_taken,
       sha256(CASE WHEN n_taken = n THEN text ELSE
         array_to_string(regexp_extract_all(text, '{SPACES}*[^\\x20\\x09-\\x0D]+')[1:n_taken], '') END) AS text_sha256 FROM u""")
    return ",".join(out)


def hard_negatives() -> str:
    return """
WITH good AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM good a JOIN good r ON a.id <> r.id WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10"""


def conversation_repair() -> str:
    """States x0 (nothing yet), x1 (after s), x2 (after u), x3 (after a) are carried from row to row, each the
    least (cost, audit) with the repaired lines; nearer edits win by comparing structs."""
    def go(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    never = "{'c': 1000000, 'a': '', 't': ''}"
    user, assistant, own = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || r.role || ':' || r.text"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN r.stay < 1000 AND left(r.role, 1) = '{initial}' THEN {go(state, 'r.stay', 'K', own)} ELSE {never} END"

    def named(state: str, line: str) -> str:
        return go(state, "3 + r.stay", "R", f"{line} || r.text")

    y2 = least(go("x2", "4", "D"), *[f(s) for s in ("x0", "x1", "x3") for f in (lambda s: kept(s, "u"), lambda s: named(s, user))])
    y3 = least(go("x3", "4", "D"), kept("x2", "a"), named("x2", assistant))
    inserted = least("y2", *[go(s, "3", "I", user) for s in ("y0", "y1", "y3")])
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)), lambda a, b: {byte}), 4294967295)"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {white}) AS said FROM damaged),
faulty AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM placed),
talks AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'role': role, 'text': text, 'stay': CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 3 ELSE 0 END}} ORDER BY i) AS rows
  FROM faulty GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, n, rows, x0, {never} AS x1, {go("x0", "3", "I", user)} AS x2, {go("x0", "6", "II", f"{user} || {assistant}")} AS x3
  FROM (SELECT *, {{'c': 0, 'a': '', 't': ''}} AS x0 FROM talks)
  UNION ALL
  SELECT conv_id, i + 1, n, rows, y0, y1, z2, {least("y3", go("z2", "3", "I", assistant))}
  FROM (SELECT *, {inserted} AS z2 FROM (
    SELECT *, {go("x0", "4", "D")} AS y0, {least(go("x1", "4", "D"), kept("x0", "s"))} AS y1, {y2} AS y2, {y3} AS y3
    FROM (SELECT *, rows[i + 1] AS r FROM walk WHERE i < n)))),
best AS (SELECT conv_id, {least("x0", "x3")} AS b FROM walk WHERE i = n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN talks t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id"""
