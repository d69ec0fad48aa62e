"""Independent SQL (DuckDB) for the queries of operators that SQL can express in full."""

from __future__ import annotations

#: CRC-32 of a text's UTF-8 bytes, bit by bit: each byte is mixed in, then shifted out eight times. For characters up to
#: U+00FF, which have the bytes of ASCII, or 195 and 64 less than their number (from U+00C0 on).
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({text}, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
    ELSE [195, -1, -1, -1, -1, -1, -1, -1, -1, unicode(c) - 64, -1, -1, -1, -1, -1, -1, -1, -1] END))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


def crc32(text: str) -> str:
    return _CRC32.format(text=text)


def _field(column: str) -> str:
    return f"coalesce(strlen(({column})::VARCHAR) || ':' || ({column})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, levels: int) -> str:
    """Levels {name}1.. and siblings {name}s0.. over {name}0 (g, idx, d, n); groups of one node stay as they are."""
    parts = []
    for k in range(levels):
        run = "PARTITION BY g, idx // 16 ORDER BY idx ROWS BETWEEN"
        parts.append(f"""
{name}s{k} AS (SELECT g, idx, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k} WHERE n > 1),
{name}{k + 1} AS (SELECT g, idx // 16 AS idx, sha256(string_agg(d, '' ORDER BY idx)) AS d, (n + 15) // 16 AS n
  FROM {name}{k} WHERE n > 1 GROUP BY g, idx // 16, n UNION ALL SELECT g, idx, d, n FROM {name}{k} WHERE n = 1)""")
    return ",".join(parts)


def _climb(rows: str, name: str, levels: int, group: str, place: str) -> str:
    """`rows` with proof and folded digest carried through all levels of a tree."""
    for k in range(levels):
        rows = (f"(SELECT r.* REPLACE (CASE WHEN s.g IS NULL THEN folded ELSE sha256(s.b || folded || s.a) END AS folded, "
                f"proof || coalesce(s.b || s.a, '') AS proof) FROM {rows} r LEFT JOIN {name}s{k} s "
                f"ON s.g = r.{group} AND s.idx = r.{place} // {16 ** k})")
    return rows


def _merkle(levels: int = 6, upper: int = 4) -> str:
    """Enough levels for 16 ** levels rows of a source and 16 ** upper sources."""
    lowered = f"CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN translate(text, " \
              "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    climbed = _climb(_climb("(SELECT *, changed AS folded, '' AS proof FROM placed)", "t", levels, "g", "idx"),
                     "u", upper, "whole", "place")
    return f"""
WITH leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf('text')} AS d, {_leaf(lowered)} AS changed
  FROM documents),
t0 AS (SELECT g, doc_id, d, changed, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS idx,
  count(*) OVER (PARTITION BY g) AS n FROM leaves), {_tree("t", levels)},
u0 AS (SELECT 0 AS g, g AS source, d, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM t{levels}),
{_tree("u", upper)},
placed AS (SELECT t0.*, u0.d AS subroot, u0.idx AS place, 0 AS whole FROM t0 JOIN u0 ON u0.source = t0.g)
SELECT doc_id, d AS leaf, subroot, (SELECT d FROM u{upper}) AS root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = (SELECT d FROM u{upper}) AS verified FROM {climbed} climbed"""


_SPELLING = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents),
low AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id,
  translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs),
counted AS (SELECT id, run, count(*) AS n FROM low GROUP BY ALL),
drawn AS (SELECT run, n, {crc32("id || run")} AS h FROM counted),
damaged AS (SELECT n, CASE WHEN h % 31 = 0
  THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM drawn),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
dropped AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT d.word AS a, w.word AS b FROM dropped d JOIN words w ON w.word = d.rest),
pairs AS (SELECT a, b FROM shorter UNION SELECT b, a FROM shorter UNION
  SELECT x.word, y.word FROM dropped x JOIN dropped y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
ranked AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near,
  row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS nth FROM pairs JOIN words ON word = b),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN b END AS form,
  CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n FROM words w LEFT JOIN ranked r ON r.a = w.word AND nth = 1),
chain AS (SELECT word, form, coalesce(form, word) AS root FROM known UNION ALL
  SELECT c.word, k.form, k.form FROM chain c JOIN known k ON k.word = c.form WHERE k.form IS NOT NULL)
SELECT k.word, k.form, ends.root, k.n, k.n_near, k.form_n FROM known k JOIN
  (SELECT c.word, c.root FROM chain c JOIN known e ON e.word = c.root WHERE e.form IS NULL) ends ON ends.word = k.word"""


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: What escaping adds is counted on the escaped text itself; the form is the one of the operator's docstring.
_CHAT = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) added(k, role)),
escaped AS (SELECT *, length(replace(replace(replace(replace(role || chr(0) || text, '\', '\\'), '<turn>', '<\turn>'),
  '<says>', '<\says>'), '</turn>', '<\/turn>')) - 1 AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role || ' ' || sha256(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + length('<turn><says></turn>'))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""


def judged_urls(rules: list, words: tuple) -> str:
    """Hosts with a label among `words` are the block list."""
    listed = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in rules)
    return f"""
WITH found AS (SELECT page_id, row_number() OVER () AS n,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, n, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM found),
asked AS (SELECT page_id, n, {_LOWER.format("host")} AS host,
  regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM cut),
fitting AS (SELECT a.n, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
  max_by(r.action, length(r.host || r.path)) AS action FROM asked a JOIN (VALUES {listed}) r(action, host, path)
  ON (a.host = r.host OR ends_with(a.host, '.' || r.host)) AND starts_with(a.path, r.path) GROUP BY a.n)
SELECT page_id, host, path, rule, coalesce(action,
  CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(words)})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM asked LEFT JOIN fitting USING (n)"""


#: Equal sets meet once: links are sought between the least documents of distinct sets, over an inverted list.
_NEAR_DEDUP = f"""
WITH RECURSIVE texts AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")},
  '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
runs AS (SELECT doc_id, i, n, concat_ws(' ', word, lead(word, 1) OVER run, lead(word, 2) OVER run) AS item
  FROM words WINDOW run AS (PARTITION BY doc_id ORDER BY i)),
sets AS (SELECT doc_id, coalesce(s, []) AS s FROM documents LEFT JOIN (SELECT doc_id, list_sort(list(DISTINCT item)) AS s
  FROM runs WHERE i <= greatest(n - 2, 1) GROUP BY doc_id) USING (doc_id)),
nodes AS (SELECT min(doc_id) AS node, s, len(s) AS size FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT node, size, unnest(s) AS item FROM nodes),
links AS (SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.item = b.item AND a.node <> b.node
  GROUP BY a.node, b.node, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))),
reached AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
classes AS (SELECT a, min(b) AS component FROM reached GROUP BY a)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
  coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN nodes n ON n.s = d.s LEFT JOIN classes c ON c.a = n.node"""


def statements() -> dict[str, str]:
    return {"op1_chat": _CHAT, "op8_near_dedup": _NEAR_DEDUP, "op12_spelling": _SPELLING, "op13_merkle": _merkle()}
