"""SQL of the Merkle manifest and the conversation repair."""

from __future__ import annotations

from pixelmill.plans.lenses import crc32_sql


def _enc(value: str) -> str:
    return f"COALESCE(strlen({value})::VARCHAR || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_enc(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


MERKLE = f"""
WITH RECURSIVE l AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, COALESCE({crc32_sql("doc_id::VARCHAR")} % 3 = 0, false) AS bad,
  {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, COUNT(*) OVER (PARTITION BY lang) AS n FROM l),
up(lang, lv, i, n, h) AS (SELECT lang, 0, i, n, leaf FROM d
  UNION ALL SELECT lang, lv + 1, i // 8, ANY_VALUE((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, lv, i // 8),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, COUNT(*) OVER () AS n FROM up WHERE n = 1),
top(lv, i, n, h) AS (SELECT 0, i, n, h FROM sub
  UNION ALL SELECT lv + 1, i // 8, ANY_VALUE((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lv, i // 8),
way AS (SELECT d.lang, d.i AS leaf_i, up.lv, COALESCE(string_agg(up.h, '' ORDER BY up.i) FILTER (up.i < d.i >> (3 * up.lv)), '') AS a,
  COALESCE(string_agg(up.h, '' ORDER BY up.i) FILTER (up.i > d.i >> (3 * up.lv)), '') AS b
  FROM d JOIN up ON up.lang IS NOT DISTINCT FROM d.lang AND up.i // 8 = d.i >> (3 * up.lv + 3) AND up.n > 1 GROUP BY d.lang, d.i, up.lv
  UNION ALL SELECT d.lang, d.i, 100 + top.lv, COALESCE(string_agg(top.h, '' ORDER BY top.i) FILTER (top.i < sub.i >> (3 * top.lv)), ''),
  COALESCE(string_agg(top.h, '' ORDER BY top.i) FILTER (top.i > sub.i >> (3 * top.lv)), '')
  FROM d JOIN sub ON sub.lang IS NOT DISTINCT FROM d.lang JOIN top ON top.i // 8 = sub.i >> (3 * top.lv + 3) AND top.n > 1 GROUP BY d.lang, d.i, top.lv),
w AS (SELECT lang, leaf_i, list([a, b] ORDER BY lv) AS sides FROM way GROUP BY lang, leaf_i)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root,
  sha256(COALESCE(list_aggregate(list_transform(sides, lambda s: s[1] || s[2]), 'string_agg', ''), '')) AS proof_sha256,
  COALESCE(list_reduce(list_prepend([CASE WHEN bad THEN low ELSE leaf END, ''], sides), lambda h, s: [sha256(s[1] || h[1] || s[2]), ''])[1],
           CASE WHEN bad THEN low ELSE leaf END) AS folded_root,
  folded_root = top.h AS verified
FROM d JOIN sub ON sub.lang IS NOT DISTINCT FROM d.lang JOIN top ON top.n = 1 LEFT JOIN w ON w.lang IS NOT DISTINCT FROM d.lang AND w.leaf_i = d.i"""


def _repair() -> str:
    """Turn by turn: per state the least (cost, audit, output) so far, a struct of fields that compare in this order."""

    def add(state: str, cost: str, letter: str, out: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o || {out}}} END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def put(role: str) -> str:
        return f"chr(10) || '{role}:'"

    same, more = "chr(10) || r.role || ':' || r.text", "r.cut_off::INT"
    user = [add(s, f"2 + {more}", "R", put("user") + " || r.text") for s in ("i0", "i1", "i3")]
    keep = {c: [add(s, more, "K", same) for s in states] for c, states in (("s", ["i0"]), ("u", ["i0", "i1", "i3"]), ("a", ["i2"]))}
    stay = {c: [f"CASE WHEN NOT r.gone AND r.c = '{c}' THEN {w} END" for w in ways] for c, ways in keep.items()}
    live = [f"CASE WHEN NOT r.gone THEN {w} END" for w in user]
    answer = f"CASE WHEN NOT r.gone THEN {add('i2', f'2 + {more}', 'R', put('assistant') + ' || r.text')} END"
    gone = [add(f"i{k}", "3", "D", "''") for k in range(4)]
    step = [gone[0], least(gone[1], *stay["s"]), least(gone[2], *stay["u"], *live), least(gone[3], *stay["a"], answer)]
    # insertions between turns: to state 2 from all others, from there to state 3
    in2 = least("s2", *(add(s, "2", "I", put("user")) for s in ("s0", "s1", "s3")))
    in3 = least("s3", add("i2", "2", "I", put("assistant")))
    return f"""
WITH RECURSIVE x AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
  {crc32_sql("(COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' '))")} % 20 AS draw FROM conversations),
y AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
  CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, UNNEST(CASE WHEN draw = 3 THEN [1, 2] ELSE [1] END) FROM x WHERE draw <> 0),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, left(role, 1) AS c,
  right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS e FROM y),
t AS (SELECT conv_id, turn, role, text, k, c, e = '' AS blank, e <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
  e NOT IN ('.', '!', '?') AS cut_off, lag(c) OVER (PARTITION BY conv_id ORDER BY k) || c AS pair FROM z),
f AS (SELECT conv_id, COUNT(*) AS n, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (blank) AS blank,
  COUNT(*) FILTER (again) AS duplicate, COUNT(*) FILTER (cut_off AND NOT blank AND NOT again) AS truncated,
  COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id),
r AS (SELECT *, blank OR again AS gone FROM t),
p(conv_id, k, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 'o': ''}}, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR),
    NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) FROM f
  UNION ALL SELECT r.conv_id, r.k, {", ".join(step)}
  FROM (SELECT conv_id, k, s0 AS i0, s1 AS i1, i2, {in3} AS i3 FROM (SELECT *, {in2} AS i2 FROM p)) q
  JOIN r ON r.conv_id IS NOT DISTINCT FROM q.conv_id AND r.k = q.k + 1),
e AS (SELECT conv_id, k, {least("s0", in3)} AS b FROM (SELECT *, {in2} AS i2 FROM p)),
w AS (SELECT f.*, b FROM f JOIN e ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.k = f.n),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
  COALESCE(illegal, 0) AS illegal, COALESCE(b.c, 0) AS cost, COALESCE(b.a, '') AS audit, sha256(COALESCE(b.o[2:], '')) AS repaired_sha256
FROM ids LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM ids.conv_id"""


REPAIR = _repair()
