"""DuckDB SQL for the queries that SQL can express on whole tables."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_WINDOWS = """
d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w) - {n} + 1)) AS st FROM d WHERE len(w) >= {n}),
g AS (SELECT doc_id, st, array_to_string(w[st + 1:st + {n}], ' ') AS gram FROM s),
r AS (SELECT doc_id, st, row_number() OVER (PARTITION BY gram ORDER BY doc_id, st) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(st, st + {n})) AS pos FROM r WHERE k > 1)"""

_BENCH = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_TURN = "'<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)"
_REST = "{x}[k + 1:len({x})]"


def _side(x: str, known: str) -> str:
    rest = _REST.format(x=x)
    text = f"list_reduce(list_prepend('', list_transform({rest}, lambda t: {_TURN})), lambda a, b: a || b)"
    sizes = f"list_transform({rest}, lambda t: length(t.role) + length(t.text) + 24)"
    before = f"list_transform(range(1, len({rest}) + 1), lambda i: coalesce(list_sum(({sizes})[1:i - 1]), 0)::BIGINT)"
    spans = f"list_transform(list_filter(list_zip({rest}, {before}), lambda z: z[1].role = 'assistant'), lambda z: (z[2] + length(z[1].role) + 13)::VARCHAR || '-' || (z[2] + length(z[1].role) + length(z[1].text) + 23)::VARCHAR)"
    return f"CASE WHEN {known} IS NULL THEN NULL ELSE {text} END AS {{0}}, CASE WHEN {known} IS NULL THEN NULL ELSE array_to_string({spans}, ',') END AS {{0}}_spans"


SQL = {
    "op3_suffix_dedup": f"""WITH {_WINDOWS.format(words=_WORDS, n=50)},
i AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c),
p AS (SELECT doc_id, min(pos) AS a, max(pos) + 1 AS b FROM i GROUP BY doc_id, island),
f AS (SELECT doc_id, sum(b - a)::BIGINT AS n, string_agg(a::VARCHAR || '-' || b::VARCHAR, ',' ORDER BY a) AS spans FROM p GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(f.n, 0)::BIGINT AS n_repeated, coalesce(f.spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)""",
    "op4_preference": f"""WITH t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
a AS (SELECT conv_id, turns FROM t WHERE conv_id % 2 = 0), b AS (SELECT conv_id, turns FROM t WHERE conv_id % 2 <> 0),
p AS (SELECT coalesce(a.conv_id // 2, b.conv_id // 2) AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, coalesce(a.turns, []) AS c, coalesce(b.turns, []) AS r FROM a FULL JOIN b ON a.conv_id // 2 = b.conv_id // 2),
e AS (SELECT *, list_transform(range(1, least(len(c), len(r)) + 1), lambda i: c[i] = r[i]) AS same FROM p),
n AS (SELECT *, coalesce(nullif(list_position(same, false), 0) - 1, len(same)) AS k FROM e)
SELECT pair_id::BIGINT AS pair_id, chosen_id, rejected_id, k::BIGINT AS n_prompt_turns, list_reduce(list_prepend('', list_transform(c[1:k], lambda t: {_TURN})), lambda a, b: a || b) AS prompt, {_side('c', 'chosen_id').format('chosen')}, {_side('r', 'rejected_id').format('rejected')} FROM n""",
    "op7_substring_dedup": f"""WITH {_WINDOWS.format(words=_WORDS, n=20)},
h AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(d.w) AS n, coalesce(len(h.gone), 0) AS m, unnest(CASE WHEN len(d.w) = 0 THEN [NULL] ELSE range(0, len(d.w)) END) AS pos, d.w FROM d LEFT JOIN h USING (doc_id)),
o AS (SELECT k.doc_id, k.n, k.m, string_agg(CASE WHEN c.pos IS NULL THEN k.w[k.pos + 1] END, ' ' ORDER BY k.pos) AS kept FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.pos = k.pos GROUP BY ALL)
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM o""",
    "op8_decontaminate": f"""WITH i AS (SELECT item_id, {_BENCH} AS w FROM benchmark),
j AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id::VARCHAR AS item, n, array_to_string(w[st + 1:st + n], ' ') AS gram FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS st FROM j)),
d AS (SELECT doc_id, {_BENCH} AS w FROM documents),
s AS (SELECT d.doc_id, d.w, z.n, unnest(range(0, len(d.w) - z.n + 1)) AS st FROM d, (SELECT DISTINCT n FROM g) z WHERE len(d.w) >= z.n),
h AS (SELECT s.doc_id, s.st, s.n, g.item FROM s JOIN g ON g.n = s.n AND g.gram = array_to_string(s.w[s.st + 1:s.st + s.n], ' ')),
c AS (SELECT doc_id, count(DISTINCT pos) AS hit FROM (SELECT doc_id, unnest(range(st, st + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.hit, 0)::BIGINT AS n_hit, coalesce(t.items, 0)::BIGINT AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, coalesce(c.hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
