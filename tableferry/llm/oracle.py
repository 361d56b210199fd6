"""The same results in DuckDB's SQL, for the operations that SQL can express."""

from __future__ import annotations

from tableferry.llm import benchmark as b
from tableferry.llm import chat
from tableferry.llm import production as p


def _case(column: str, weights: dict[str, int], other: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {other} END"


def _level(k: int, weight: str) -> str:
    path = ("domain", "lang", "source")[: k + 1]
    family = ", ".join(path[:-1])
    by, names = f"PARTITION BY {family}" if family else "", ", ".join(path)
    sharing = "PARTITION BY " + ", ".join([*path[:-1], "is_full"])
    ordered = f"{by} ORDER BY cap::DOUBLE / w::DOUBLE, {path[-1]}"
    parent = f"JOIN s{k - 1} USING ({family})" if family else f"CROSS JOIN (SELECT sum(tokens) * {p.MIX_SHARE_PERCENT} // 100 AS share FROM leaves)"
    return f"""
n{k} AS (SELECT {names}, cap, ({weight})::HUGEINT AS w, share::HUGEINT AS budget
  FROM (SELECT {names}, sum(tokens * {p.MIX_EPOCHS})::HUGEINT AS cap FROM leaves GROUP BY {names}) {parent}),
l{k} AS (SELECT *, budget - coalesce(sum(cap) OVER ({ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
  sum(w) OVER ({ordered} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heirs FROM n{k}),
f{k} AS (SELECT *, min((cap * heirs <= w * left_over)::INT) OVER ({ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS is_full FROM l{k}),
r{k} AS (SELECT *, max(left_over) OVER ({sharing}) AS pot, max(heirs) OVER ({sharing}) AS sharers FROM f{k}),
g{k} AS (SELECT *, (w * pot) // sharers AS part, (w * pot) % sharers AS remainder FROM r{k}),
s{k} AS (SELECT {names}, CASE WHEN is_full THEN cap ELSE part
  + (row_number() OVER ({sharing} ORDER BY remainder DESC, {path[-1]}) <= pot - sum(part) OVER ({sharing}))::INT END AS share FROM g{k}),"""


def mixture(columns: str = "doc_id, domain, lang, source, mix_epoch, mix_tokens, mix_taken", documents: str = "documents") -> str:
    leaf = "domain, lang, source"
    number = "nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '')::INT"
    weights = [_case("domain", p.DOMAIN_WEIGHTS, 1), _case("lang", p.LANGUAGE_WEIGHTS, 5), "1"]
    return f"""
WITH docs AS (SELECT doc_id, CASE WHEN {number} <= 1 THEN 'core' WHEN {number} <= 12 THEN 'wide' ELSE 'rare' END AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang_given, source AS source_given,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n FROM {documents}),
leaves AS (SELECT {leaf}, sum(n) AS tokens FROM docs GROUP BY {leaf}),{"".join(_level(k, w) for k, w in enumerate(weights))}
ends AS (SELECT {leaf}, CASE WHEN tokens > 0 THEN (share // tokens)::BIGINT ELSE 0 END AS epochs,
  share - CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END * tokens AS rest FROM leaves JOIN s2 USING ({leaf})),
placed AS (SELECT *, sum(n) OVER (PARTITION BY {leaf} ORDER BY md5('{p.MIX_SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, ''))) AS upto
  FROM docs JOIN ends USING ({leaf})),
entries AS (SELECT *, unnest(range(epochs)) AS mix_epoch, n AS mix_taken FROM placed
  UNION ALL SELECT *, epochs AS mix_epoch, least(n, rest - (upto - n))::BIGINT AS mix_taken FROM placed WHERE upto - n < rest)
SELECT {columns} FROM (SELECT doc_id, domain, lang_given AS lang, source_given AS source, mix_epoch, n AS mix_tokens, mix_taken FROM entries)"""


def line_dedup() -> str:
    return """
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
starts AS (SELECT doc_id, lines, [len(trim(x)) for x in lines] AS sizes, unnest(range(1, len(lines) + 1)) AS pos FROM docs),
runs AS (SELECT doc_id, pos, 1 << k AS n, list_sum(sizes[pos:pos + (1 << k) - 1]) >= 40 AS counts,
  md5(array_to_string(lines[pos:pos + (1 << k) - 1], chr(10))) AS run
  FROM starts CROSS JOIN (SELECT unnest(range(0, 14)) AS k) WHERE pos + (1 << k) - 1 <= len(lines)),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, pos) AS copy FROM runs) WHERE copy > 1 AND counts),
removed AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM later),
kept AS (SELECT doc_id, pos, lines[pos] AS line, removed.pos IS NOT NULL AS gone FROM starts LEFT JOIN removed USING (doc_id, pos)),
marked AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM kept),
sums AS (SELECT doc_id, count(*)::INT AS n_lines, sum(gone::INT)::INT AS n_removed, sum(begins::INT)::INT AS n_spans,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, n_spans, coalesce(longest, 0)::INT AS longest_run, sha256(text) AS kept_sha256
FROM sums LEFT JOIN (SELECT doc_id, max(n) AS longest FROM later GROUP BY doc_id) USING (doc_id)"""


def _template(text: str, values: bool) -> str:
    keep = r"\2" if values else ""
    for _ in range(2):
        text = f"regexp_replace({text}, '{b.NAME_PATTERN}', '\\1{b.NAME}{keep}{b.CLOSE}', 'g')"
    text = f"regexp_replace({text}, '{b.NUMBER_PATTERN}', '{b.NUMBER}{chr(92) + '1' if values else ''}{b.CLOSE}', 'g')"
    text = f"regexp_replace({text}, '{b.UNIT_PATTERN}', '\\1{b.UNIT}{keep}{b.CLOSE}\\3', 'g')"
    return f"regexp_extract_all(lower({text}), '{b.WORD_PATTERN}', 1)"


def leaks() -> str:
    w, slot = b.WINDOW, f"regexp_matches(x, '^[{b.NAME}{b.NUMBER}{b.UNIT}]')"
    starts = f"unnest(range(1, greatest(len(words) - {w - 1}, 1) + 1))"
    return f"""
WITH items AS (SELECT item_id, {_template('text', False)} AS words, {_template('text', True)} AS valued FROM benchmark),
docs AS (SELECT doc_id, {_template('text', False)} AS words, {_template('text', True)} AS valued FROM documents),
iw AS (SELECT item_id, off, words[off:off + {w - 1}] AS win FROM (SELECT item_id, words, {starts} AS off FROM items WHERE len(words) > 0)),
it AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_windows FROM iw WHERE len([x FOR x IN win IF NOT {slot}]) >= least({b.LEAST_WORDS}, len(win))),
dw AS (SELECT doc_id, pos, words[pos:pos + {w - 1}] AS win FROM (SELECT doc_id, words, {starts} AS pos FROM docs WHERE len(words) > 0)),
hits AS (SELECT doc_id, item_id, off, pos, n_windows FROM dw JOIN it USING (win)),
found AS (SELECT doc_id, item_id, n_windows, count(DISTINCT off) AS n_found FROM hits GROUP BY ALL HAVING count(DISTINCT off) >= {b.SIMILARITY} * n_windows),
places AS (SELECT DISTINCT doc_id, item_id, off + step AS i, pos + step AS j FROM hits JOIN found USING (doc_id, item_id) CROSS JOIN (SELECT unnest(range(0, {w})) AS step)),
vals AS (SELECT doc_id, item_id, items.valued[i] AS x, docs.valued[j] AS y FROM places JOIN items USING (item_id) JOIN docs USING (doc_id)
  WHERE i <= len(items.valued) AND j <= len(docs.valued)),
byval AS (SELECT doc_id, item_id, x, min(y) AS lo, max(y) AS hi FROM vals WHERE {slot} AND {slot.replace('(x', '(y')} GROUP BY ALL),
verdict AS (SELECT doc_id, item_id, bool_and(lo = hi) AS consistent, bool_and(lo = x AND hi = x) AS equal, count(*) AS n_slots FROM byval GROUP BY ALL)
SELECT doc_id, item_id, n_windows, n_found, coalesce(n_slots, 0) AS n_slots, CASE WHEN coalesce(equal, true) THEN 'copy' ELSE 'variant' END AS kind
FROM found LEFT JOIN verdict USING (doc_id, item_id) WHERE coalesce(consistent, true)"""


def perspectives() -> str:
    end = chat.END.replace("\n", "' || chr(10) || '")
    name = "trim(regexp_replace(coalesce(role, ''), '[\\n\\r]+', ' ', 'g'), ' ')"
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(nullif(replace(replace({name}, '<|', '< |'), '|>', '| >'), ''), '{chat.UNKNOWN}') AS speaker,
  replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, body) - 1 AS place FROM turns),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> '{chat.SYSTEM}'),
blocks AS (SELECT conv_id, perspective, place // {chat.PART_TURNS} AS part, place, speaker = perspective AS mine, body,
  CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = '{chat.SYSTEM}' THEN '<|system|>' ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head
  FROM placed JOIN people USING (conv_id)),
sized AS (SELECT *, head || body || '{end}' AS block,
  sum(len(head) + len(body) + {len(chat.END)}) OVER (PARTITION BY conv_id, perspective, part ORDER BY place) - len(body) - {len(chat.END)} AS start FROM blocks)
SELECT conv_id, perspective, part::BIGINT AS part, count(*)::INT AS n_turns, sha256(string_agg(block, '' ORDER BY place)) AS text_sha256,
  coalesce(string_agg(start || '-' || (start + len(body) + {chat.MASKED_END}), ',' ORDER BY place) FILTER (mine), '') AS mask
FROM sized GROUP BY conv_id, perspective, part"""


def merkle(documents: str = "documents") -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def digest(text: str) -> str:
        values = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    # CRC-32, bit by bit: every byte is mixed in before the first of its eight shifts.
    shifts = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    mixed = "xor(c, s)"
    crc = f"xor(list_reduce({shifts}, lambda c, s: xor({mixed} >> 1, 3988292384 * ({mixed} & 1)), 4294967295::UBIGINT), 4294967295)"
    return f"""
WITH RECURSIVE leaves AS (SELECT doc_id, source, {digest("text")} AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN {digest(lower)} END AS claim FROM {documents}),
ranked AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM leaves),
tree AS (SELECT 0 AS lvl, grp, pos, n, leaf AS digest FROM ranked
  UNION ALL SELECT lvl + 1, grp, pos // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lvl, grp, pos // 16),
subroots AS (SELECT grp, digest AS subroot FROM tree WHERE n = 1),
crown AS (SELECT 0 AS lvl, grp AS pos, count(*) OVER () AS n, subroot AS digest FROM subroots
  UNION ALL SELECT lvl + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY lvl, pos // 16),
root AS (SELECT digest AS root FROM crown WHERE n = 1),
beside AS (SELECT rid, lvl, r.pos // (16 ** lvl)::BIGINT AS own, t.pos, t.digest FROM ranked r JOIN tree t
    ON t.grp = r.grp AND t.n > 1 AND t.pos // 16 = r.pos // (16 ** (lvl + 1))::BIGINT
  UNION ALL SELECT rid, 100 + lvl, grp // (16 ** lvl)::BIGINT, c.pos, c.digest FROM ranked r JOIN crown c
    ON c.n > 1 AND c.pos // 16 = grp // (16 ** (lvl + 1))::BIGINT),
segments AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS step,
  coalesce(string_agg(digest, '' ORDER BY pos) FILTER (WHERE pos < own), '') AS l,
  coalesce(string_agg(digest, '' ORDER BY pos) FILTER (WHERE pos > own), '') AS r FROM beside GROUP BY rid, lvl),
fold AS (SELECT rid, 0::BIGINT AS step, coalesce(claim, leaf) AS digest FROM ranked
  UNION ALL SELECT rid, s.step, sha256(l || digest || r) FROM fold JOIN segments s USING (rid) WHERE s.step = fold.step + 1),
paths AS (SELECT rid, sha256(coalesce(string_agg(l || r, '' ORDER BY step), '')) AS proof_sha256 FROM ranked LEFT JOIN segments USING (rid) GROUP BY rid)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM ranked JOIN subroots USING (grp) CROSS JOIN root JOIN paths USING (rid)
JOIN (SELECT rid, arg_max(digest, step) AS folded_root FROM fold GROUP BY rid) USING (rid)"""


def near_copies(documents: str = "documents") -> str:
    return f"""
WITH RECURSIVE split AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM {documents}),
sets AS (SELECT rid, doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM split),
entries AS (SELECT rid, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (SELECT a.rid AS x, b.rid AS y FROM entries a JOIN entries b USING (shingle) WHERE a.rid <> b.rid
  GROUP BY a.rid, b.rid HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT rid, rid AS other FROM sets UNION SELECT r.rid, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT any_value(s.doc_id) AS doc_id, any_value(len(s.shingles)) AS n_shingles, min(o.doc_id) AS component_id,
  coalesce(any_value(s.doc_id) = min(o.doc_id), false) AS kept
FROM reach r JOIN sets s ON s.rid = r.rid JOIN sets o ON o.rid = r.other GROUP BY r.rid"""
