"""DuckDB SQL for the contract queries that SQL can express."""

from __future__ import annotations

import string

from . import license, secrets

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _folded(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), {_WORDS})"


OP10 = f"""
WITH d AS (SELECT doc_id, {_folded('text')} AS w FROM documents),
b AS (SELECT item_id, {_folded('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS x
    FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) t(i)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.x = win.x AND dw.n = win.n),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), unnest(generate_series(0, n - 1)) t(k) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(name: str, kind: int, pattern: str, keep: str) -> str:
    p = _quoted(pattern)
    return f"""{name} AS (SELECT doc_id, {kind} AS kind, s, s + length(c) AS e, c FROM (
    SELECT doc_id, m[k] AS c, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS p FROM t), unnest(generate_series(1, len(m))) g(k)) WHERE {keep})"""


def _op1() -> str:
    base = []
    for k, (name, pattern, group, least) in enumerate(secrets.BASE):
        keep = f"length(regexp_extract(c, {_quoted(pattern)}, {group})) >= {least}"
        base.append(_spans(f"b_{name}", k, pattern, keep))
    whens = " ".join(f"WHEN regexp_matches(c, {_quoted(p)}) THEN {bits}" for p, bits in secrets.CLASSES[:-1])
    entropy = f"list_max(list_transform(generate_series(1, length(c) - {secrets.WIDTH - 1}), lambda i: list_aggregate(string_split(substr(c, i, {secrets.WIDTH}), ''), 'entropy')))"
    keep = f"regexp_matches(c, '[0-9]') AND NOT regexp_matches(c, {_quoted(secrets.ALLOWED)}) AND round({entropy}, 6) >= CASE {whens} ELSE {secrets.CLASSES[-1][1]} END"
    odd = _spans("odd", len(secrets.BASE), f"[A-Za-z0-9+/_=-]{{{secrets.WIDTH},}}", keep)
    names = "[" + ", ".join(map(_quoted, secrets.KINDS)) + "]"
    text = f"string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    union = " UNION ALL ".join(f"SELECT * FROM b_{name}" for name, *_ in secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, (name, *_) in enumerate(secrets.BASE))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(base)}, {odd},
base AS ({union}), free AS (SELECT * FROM odd WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = odd.doc_id AND base.s < odd.e AND odd.s < base.e)),
a AS (SELECT doc_id, {counts}, sha256({text}) AS base_sha256 FROM base GROUP BY 1),
z AS (SELECT doc_id, {text} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM free) GROUP BY 1)
SELECT doc_id, {', '.join(f'coalesce(n_{name}, 0) AS n_{name}' for name, *_ in secrets.BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id) LEFT JOIN z USING (doc_id)
"""


def _op8() -> str:
    """Every phrase is searched at every word; a template's score is the best of its key phrase's starts."""
    base = " UNION ALL ".join(f"SELECT {_quoted(p)} AS phrase, {_quoted(label)} AS label" for p, label in license.BASE.items())
    rows = []
    for n, (label, wording, key) in enumerate(license.TEMPLATES):
        words, phrase = license.compared(wording, key)
        lists = [[w for w, _ in words], [i for _, i in words], [w for w, _ in phrase], [i for _, i in phrase]]
        rows.append(f"SELECT {n} AS n, {_quoted(label)} AS label, {lists[0]!r} AS words, {lists[1]!r} AS places, {lists[2]!r} AS kwords, {lists[3]!r} AS kplaces")
    same = "list_sum(list_transform(list_zip({words}, {places}), lambda z: CASE WHEN s + z[2] >= 1 AND w[s + z[2]] = z[1] THEN 1 ELSE 0 END))"
    return f"""
WITH d AS (SELECT doc_id, {_folded('text')} AS w FROM documents), base AS ({base}), tmpl AS ({' UNION ALL '.join(rows)}),
pos AS (SELECT doc_id, w, i, w[i] AS x FROM d, unnest(generate_series(1, len(w))) g(i)),
places AS (SELECT doc_id, i - 1 AS start, label FROM pos JOIN (SELECT *, string_split(phrase, ' ') AS ps FROM base) ON x = ps[1] WHERE list_slice(w, i, i + len(ps) - 1) = ps),
met AS (SELECT doc_id, w, tmpl.*, i - kplaces[1] AS s FROM pos JOIN tmpl ON x = kwords[1]),
full_ AS (SELECT * FROM met WHERE {same.format(words='kwords', places='kplaces')} = len(kwords)),
ok AS (SELECT doc_id, n, label, max(CAST({same.format(words='words', places='places')} AS DOUBLE) / len(words)) AS score FROM full_ GROUP BY 1, 2, 3),
b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM ok) GROUP BY 1),
s AS (SELECT doc_id, max(score) AS score FROM ok GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP7 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, b[i:i + 99] AS s FROM d, unnest(generate_series(1, octet_length(b) - 99)) g(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
runs AS (SELECT doc_id, i, sum(CASE WHEN i - prior <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prior FROM rep)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS z FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS begin_ FROM spans
    UNION ALL SELECT d.doc_id, octet_length(b) + 1, coalesce(max(z), 0) + 1 FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY 1, 2),
kept AS (SELECT doc_id, string_agg(hex(b[begin_:a - 1]), '' ORDER BY a) AS h FROM cuts JOIN d USING (doc_id) WHERE a > begin_ GROUP BY 1),
lost AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(CAST(n_removed AS BIGINT), 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


ORACLE_SQL = {"op1_secrets": _op1(), "op8_license": _op8(), "op7_repeats": OP7, "op10_decontamination": OP10}
