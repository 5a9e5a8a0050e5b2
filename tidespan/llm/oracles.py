"""DuckDB SQL for the operators whose results SQL can express (whole tables, exact)."""

from __future__ import annotations

from .quality import POLICIES, RULES, mask

_GAP = r"[\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, rx: str = r"[^\x20\x09-\x0D]+") -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{rx}')"


def _grams(name: str, source: str, key: str, k: int) -> str:
    """(key, g): each distinct shingle of k words; all words as one where there are fewer."""
    return f"""{name} AS (SELECT DISTINCT {key}, CASE WHEN len(w) >= {k} THEN array_to_string(w[i:i + {k - 1}], ' ') ELSE array_to_string(w, ' ') END AS g
      FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM {source} WHERE len(w) > 0))"""


OP2 = f"""WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
  first_seen AS (SELECT g, min(doc_id) AS doc_id, arg_min(i, (doc_id, i)) AS i FROM win GROUP BY g HAVING count(*) > 1),
  gone AS (SELECT win.doc_id, win.i FROM win JOIN first_seen f USING (g) WHERE win.doc_id <> f.doc_id OR win.i <> f.i),
  covered AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM gone)),
  pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
  kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) FILTER (WHERE c.p IS NULL) AS text, count(c.p) AS n_removed FROM pos LEFT JOIN covered c ON c.doc_id = pos.doc_id AND c.p = pos.p GROUP BY pos.doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

OP6 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {_words("text")} AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
  twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
  rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (doc_id, g)) GROUP BY doc_id),
  m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_GAP}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
      list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{_GAP}', '', 'g')) > 0) AS ls, coalesce(rep.n, 0) AS n_repeat_words,
      length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclamations FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id),
  n AS (SELECT *, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM m),
  b AS (SELECT *, CAST({" + ".join(f"CASE WHEN {cond} THEN {1 << i} ELSE 0 END" for i, (_, cond) in enumerate(RULES))} AS BIGINT) AS fail_bits FROM n)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask("base")} <> 0 AS base_failed, fail_bits & {mask("v1")} = 0 AS kept, fail_bits FROM b"""
assert set(POLICIES["base"]) <= set(POLICIES["v1"])

OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER.format("text"))} AS w FROM documents),
  {_grams("s", "d", "doc_id", 5)},
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
  both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
  c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

_NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9 = f"""WITH d AS (SELECT doc_id, {_words(_LOWER.format("text"), _NORMAL)} AS w FROM documents), i AS (SELECT item_id, {_words(_LOWER.format("text"), _NORMAL)} AS w FROM benchmark),
  {_grams("ds", "d", "doc_id", 5)}, {_grams("its", "i", "item_id", 5)},
  q AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id),
  hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (g) GROUP BY ALL)
  SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM hit JOIN q USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9"""

_ASSIGN = """(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_BREAK = r"(?:[\x09-\x0D\x20]|\\[rn])"
_PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]{0,20}PRIVATE KEY-----"
    rf"|(?:{_BREAK}+[A-Za-z0-9+/]{{32,}}={{0,2}})+(?:{_BREAK}+[A-Za-z0-9+/]{{16,31}}={{0,2}}|{_BREAK}+[A-Za-z0-9+/]{{1,15}}={{1,2}})?)?"
)
_CLASSES = " + ".join(f"CAST(regexp_matches(value, '{c}') AS INT)" for c in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]"))
_CREDIBLE = f"""CASE WHEN kind = 'pem' THEN length(value) >= 100 WHEN regexp_matches(value, '(?i)example|sample|placeholder|changeme|change_me|your_|dummy|redacted|xxxx') THEN false
      WHEN kind <> 'assign' THEN len(list_distinct(string_split(value, ''))) >= 8 ELSE len(list_distinct(string_split(value, ''))) >= 6 AND ({_CLASSES} >= 2 OR length(value) >= 20) END"""
#: kind, pattern, group, least length
_KINDS = [
    ("assign", _ASSIGN, 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", _PEM, 0, 20),
    ("forge", "gh[oprsu]_[A-Za-z0-9]{30,}", 0, 34),
]


def _spans(order: int, kind: str, rx: str, group: int, least: int) -> str:
    return f"""SELECT r, '{kind}' AS kind, {order} AS ord, start, start + length(whole) AS stop, value FROM (
      SELECT r, whole, value, sum(length(gap)) OVER x + coalesce(sum(length(whole)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
        SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS whole, unnest(v) AS value, unnest(gaps[1:len(m)]) AS gap
        FROM (SELECT r, regexp_extract_all(t, '{rx}', 0) AS m, regexp_extract_all(t, '{rx}', {group}) AS v, regexp_split_to_array(t, '{rx}') AS gaps FROM d) WHERE len(m) > 0)
      WINDOW x AS (PARTITION BY r ORDER BY i)) WHERE length(value) >= {least}"""


OP4 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
  s AS ({" UNION ALL ".join(_spans(i, *k) for i, k in enumerate(_KINDS))}),
  own AS (SELECT value, count(DISTINCT split_part(coalesce(source, ''), '/', 1)) AS n_owners FROM s JOIN d USING (r) GROUP BY value),
  a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans,
      count(*) FILTER (n_owners < 3 AND {_CREDIBLE}) AS n_live, count(*) FILTER (n_owners >= 3) AS n_shared FROM s JOIN own USING (value) GROUP BY r)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared FROM d LEFT JOIN a USING (r)"""
