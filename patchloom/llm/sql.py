"""DuckDB SQL that gives the rows of the llm queries by plain means: no hashes, buckets or blocks."""

from __future__ import annotations

from .chat import BUDGET, HISTORY, HISTORY_TURNS
from .secrets import ALLOWED, ASSIGN, CLASSES, KINDS, LEAST_VALUE, WINDOW

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _matches(name: str, kind: str, pattern: str, group: int = 0) -> str:
    """CTE of the matches of a pattern: doc_id, kind, a, b (code points, end exclusive), v (the group)."""
    p = _quoted(pattern)
    return f"""{name} AS (
      SELECT doc_id, '{kind}' AS kind, a, a + length(m) AS b, v FROM (
        SELECT doc_id, m, v, sum(length(g) + coalesce(before, 0)) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM (
          SELECT doc_id, i, m, v, g, length(lag(m) OVER (PARTITION BY doc_id ORDER BY i)) AS before FROM (
            SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
              SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {group}) AS vs, string_split_regex(text, '{p}') AS gs
              FROM docs WHERE regexp_matches(text, '{p}'))))))"""


def secrets_sql() -> str:
    parts = [
        "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        _matches("assign", "assign", ASSIGN, 2),
        _matches("access", "access", "AKIA[A-Z0-9]{12,}"),
        _matches("hex", "hex", "[0-9a-f]{32,}"),
        f"base AS (SELECT doc_id, kind, a, b FROM assign WHERE length(v) >= {LEAST_VALUE} UNION ALL SELECT doc_id, kind, a, b FROM access UNION ALL SELECT doc_id, kind, a, b FROM hex)",
        _matches("run_entropy_hex", "entropy_hex", "[0-9A-Za-z]{20,}"),
        _matches("run_entropy_base64", "entropy_base64", "[A-Za-z0-9+/=_-]{20,}"),
    ]
    allowed = " OR ".join(f"regexp_matches(v, '{_quoted(p)}')" for p in ALLOWED)
    for c in CLASSES:
        only = "AND regexp_matches(v, '^[0-9A-Fa-f]+$')" if c.kind == "entropy_hex" else ""
        parts.append(f"""win_{c.kind} AS (
          SELECT doc_id, kind, a0, a0 + i AS a, a0 + i + {WINDOW} AS b FROM (
            SELECT doc_id, kind, a AS a0, v, unnest(range(length(v) - {WINDOW} + 1)) AS i FROM run_{c.kind} WHERE NOT ({allowed}) {only})
          WHERE list_aggregate(string_split(v[i + 1 : i + {WINDOW}], ''), 'entropy') >= {c.threshold} - 1e-9)""")
    wins = " UNION ALL ".join(f"SELECT * FROM win_{c.kind}" for c in CLASSES)
    ranks = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    parts += [
        f"wins AS ({wins})",
        "marked AS (SELECT *, CASE WHEN a <= lag(b) OVER w THEN 0 ELSE 1 END AS fresh FROM wins WINDOW w AS (PARTITION BY doc_id, kind, a0 ORDER BY a))",
        "islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, kind, a0 ORDER BY a) AS island FROM marked)",
        "merged AS (SELECT doc_id, kind, min(a) AS a, max(b) AS b FROM islands GROUP BY doc_id, kind, a0, island)",
        "free AS (SELECT * FROM merged m WHERE NOT EXISTS (SELECT 1 FROM base s WHERE s.doc_id = m.doc_id AND s.a < m.b AND s.b > m.a))",
        f"everything AS (SELECT *, CASE kind {ranks} END AS r, true AS is_base FROM base UNION ALL SELECT *, CASE kind {ranks} END AS r, false FROM free)",
        """listed AS (SELECT doc_id,
            count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, r) FILTER (is_base) AS base_text,
            string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, r) AS spans FROM everything GROUP BY doc_id)""",
    ]
    return f"""WITH {", ".join(parts)}
    SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
      sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs d LEFT JOIN listed USING (doc_id)"""


TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def decontamination_sql(width: int = 10) -> str:
    return f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {ALNUM_WORDS} AS w FROM benchmark),
ip AS (SELECT item_id, w, least({width}, len(w)) AS n FROM iw WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM ip)),
dw AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM dw, (SELECT DISTINCT n FROM pat) WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, win.n, item_id FROM win JOIN pat ON pat.p = win.p AND pat.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def substring_sql(width: int = 20) -> str:
    return f"""
WITH dw AS (SELECT doc_id, {SPACED_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + {width - 1}], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - {width - 2} AS BIGINT))) AS i FROM dw WHERE len(w) >= {width})),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + {width})) AS k FROM late)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM dw),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.k) AS t, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k GROUP BY word.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
"""


def classes_ctes(source: str = "documents", shingle: int = 5, threshold: float = 0.8) -> str:
    """CTEs up to ``classes``: doc_id, class_id, n_links, n_copies of each row of the source."""
    return f"""
dw AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM {source}),
sh AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, CAST(greatest(len(w) - {shingle - 1}, 1) + 1 AS BIGINT)), lambda i: array_to_string(w[i : i + {shingle - 1}], ' ')))) AS s FROM dw WHERE len(w) > 0),
node AS (SELECT s, min(doc_id) AS node, count(*) AS n_copies FROM sh GROUP BY s),
item AS (SELECT node, len(s) AS n, unnest(s) AS x FROM node),
meet AS (SELECT a.node AS a, b.node AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM item a JOIN item b ON a.x = b.x AND a.node < b.node GROUP BY 1, 2),
link AS (SELECT a, b FROM meet WHERE k >= {threshold} * (na + nb - k) - 1e-9),
arc AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT node AS a, node AS b FROM node UNION SELECT reach.a, arc.b FROM reach JOIN arc ON arc.a = reach.b),
root AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY a),
deg AS (SELECT a AS node, count(*) AS n_links FROM arc GROUP BY a),
classes AS (
  SELECT dw.doc_id, coalesce(class_id, dw.doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies
  FROM dw LEFT JOIN sh ON sh.doc_id = dw.doc_id LEFT JOIN node ON node.s = sh.s LEFT JOIN root ON root.node = node.node LEFT JOIN deg ON deg.node = node.node)"""


JACCARD = f"WITH RECURSIVE {classes_ctes()} SELECT * FROM classes"


def chat_sql(budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> str:
    probe = "<|im_end|><|im_start|>assistant ok"
    token = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"
    written = r"""length(regexp_replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24"""
    return f"""
WITH r0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{probe}' UNION ALL SELECT -1, 1, 'assistant', '{probe}'),
r1 AS (SELECT *, len(regexp_extract_all(text, '{token}')) + 4 AS tokens, {written} AS chars FROM r0),
r2 AS (SELECT *, row_number() OVER w AS n, sum(tokens) OVER w AS total FROM r1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
sys AS (SELECT conv_id, tokens AS sys_tokens, chars AS sys_chars FROM r2 WHERE n = 1 AND role = 'system'),
r3 AS (SELECT r2.*, sys_chars, greatest(1, floor(({budget - history} - coalesce(sys_tokens, 0)) / 2.0)) AS room FROM r2 LEFT JOIN sys USING (conv_id)),
r4 AS (SELECT *, floor((total - tokens) / room) AS half, CASE WHEN tokens > room THEN 1 ELSE 0 END AS alone FROM r3),
r5 AS (SELECT *, 2 * sum(alone) OVER (PARTITION BY conv_id ORDER BY n) - alone AS cut FROM r4),
r6 AS (SELECT *, CASE WHEN lag(half) OVER w <> half OR lag(cut) OVER w <> cut THEN 1 ELSE 0 END AS fresh FROM r5 WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
r7 AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY n) AS win FROM r6),
r8 AS (SELECT *, sum(tokens) OVER w AS tail, row_number() OVER w AS from_end, max(win) OVER (PARTITION BY conv_id) AS last_win FROM r7
       WINDOW w AS (PARTITION BY conv_id, win ORDER BY n DESC ROWS UNBOUNDED PRECEDING)),
fc AS (SELECT conv_id, sum(chars
    + CASE WHEN win < last_win AND tail <= {history} AND from_end <= {history_turns} AND NOT (n = 1 AND role = 'system') THEN chars ELSE 0 END
    + CASE WHEN fresh = 1 THEN coalesce(sys_chars, 0) ELSE 0 END) AS formatted_chars FROM r8 GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS lines,
        coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss FROM r8 GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM d JOIN fc USING (conv_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secrets": secrets_sql(),
        "op2_topk": TOPK,
        "op3_decontamination": decontamination_sql(),
        "op6_substring_dedup": substring_sql(),
        "op7_jaccard_join": JACCARD,
        "op9_chat": chat_sql(),
    }
