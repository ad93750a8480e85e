"""DuckDB SQL that states what the queries return; none for op6 (an external tokenizer) and op10 (a tree walk)."""

from __future__ import annotations

from . import licenses, quality, sharding

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
  ELSE list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda z: z[1] || ' ' || z[2]) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT s.doc_id, n.n, s.g FROM s JOIN n USING (doc_id)),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reached = u.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def op3(rules: quality.Rules = quality.Rules()) -> str:
    lists = strings(quality.VOCABULARY)
    k = len(quality.VOCABULARY) + 1
    classes = ["[a-z]", "[A-Z]", "[0-9]", r"[ \t\n\x0B\f\r]", r"""[.,;:!?''"()\-]"""]
    counted = [f"length(regexp_replace(t, '[^{c[1:-1]}]', '', 'g'))" for c in classes]
    other = r"length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))"
    chars = f"[{', '.join(counted)}, length(t) - {other} - {' - '.join(counted)}, {other}]"
    js = "sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END) / 2))))"
    languages = ", ".join(f"'{x}'" for x in rules.languages)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({languages}) THEN lang ELSE 'other' END AS grp, {WORDS} AS w FROM documents),
o AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER s || ' ' || lead(x, 2) OVER s AS g FROM o WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL),
v AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM m WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
b AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM l WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY ALL) GROUP BY doc_id),
pw AS (SELECT doc_id, list_filter(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS pw FROM d),
wc0 AS (SELECT doc_id, unnest(pw) AS x FROM pw),
wc1 AS (SELECT doc_id, coalesce(list_position({lists}, x), {k}) AS pos, count(*) AS c FROM wc0 GROUP BY ALL),
wc AS (SELECT doc_id, list_transform(range(1, {k + 1}), lambda i: coalesce(map_from_entries(list((pos, c)))[i::INT], 0)) AS words FROM wc1 GROUP BY doc_id),
q AS (SELECT d.doc_id, grp, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(b.n, 0) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words, {chars} AS chars, wc.words AS words FROM d LEFT JOIN v USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN wc USING (doc_id)),
f AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM q),
rc AS (SELECT grp, list(s ORDER BY pos) AS r FROM (SELECT grp, pos, sum(c) AS s FROM (SELECT grp, unnest(chars) AS c, generate_subscripts(chars, 1) AS pos FROM f WHERE NOT base_failed) GROUP BY ALL) GROUP BY grp),
rw AS (SELECT grp, list(s ORDER BY pos) AS r FROM (SELECT grp, pos, sum(c) AS s FROM (SELECT grp, unnest(words) AS c, generate_subscripts(words, 1) AS pos FROM f WHERE NOT base_failed) GROUP BY ALL) GROUP BY grp),
cd AS (SELECT doc_id, min({js.format(p="list_transform(chars, lambda c: c / list_sum(chars))", q="list_transform(r, lambda c: c / list_sum(r))")}) AS x FROM f, rc WHERE NOT base_failed AND list_sum(chars) >= {rules.min_chars} GROUP BY doc_id),
wd AS (SELECT doc_id, min({js.format(p="list_transform(words, lambda c: c / list_sum(words))", q="list_transform(r, lambda c: c / list_sum(r))")}) AS x FROM f, rw WHERE NOT base_failed AND list_sum(words) >= {rules.min_plain_words} GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd.x, 0) <= {rules.max_char_distance} AND coalesce(wd.x, 0) <= {rules.word_limit} + {rules.word_slack} / sqrt(coalesce(list_sum(words), 1)) AS kept
FROM f LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id)
"""


def op4(shards: int, slots: int) -> str:
    number = "('0x' || substr(md5({0} || name), 1, 15))::BIGINT"
    names = strings(sharding.shard_names(shards))
    return f"""
WITH RECURSIVE n AS (SELECT i, ({names})[i + 1] AS name FROM range(0, {shards}) t(i)),
p AS (SELECT list(({number.format("'offset:'")}) % {slots} ORDER BY i) AS place, list(({number.format("'skip:'")}) % {slots - 1} + 1 ORDER BY i) AS skip FROM n),
f(turn, held) AS (
  SELECT 0, list_transform(range(0, {slots}), lambda x: -1::BIGINT) FROM p
  UNION ALL
  SELECT turn + 1, held[1:slot] || [(turn % {shards})::BIGINT] || held[slot + 2:] FROM (
    SELECT turn, held, list_filter(list_transform(range(0, {slots}), lambda k: (place[turn % {shards} + 1] + k * skip[turn % {shards} + 1]) % {slots}), lambda s: held[s + 1] < 0)[1] AS slot
    FROM f, p WHERE turn < {slots})),
t AS (SELECT ({names})[h + 1] AS shard, slot FROM (SELECT unnest(held) AS h, generate_subscripts(held, 1) - 1 AS slot FROM f WHERE turn = {slots})),
d AS (SELECT doc_id, source, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 15))::BIGINT % {slots})::INT AS slot FROM documents)
SELECT doc_id, source, d.slot, t.shard FROM d JOIN t ON d.slot = t.slot
"""


OP5 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h,
  unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
o AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT o.doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM o ANTI JOIN g ON o.doc_id = g.doc_id AND o.p = g.p GROUP BY o.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP7 = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, no, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))) AS s FROM l),
c AS (SELECT s, min(struct_pack(d := doc_id, n := no)) AS first, row_number() OVER (ORDER BY min(struct_pack(d := doc_id, n := no))) AS id FROM t WHERE len(s) > 0 GROUP BY s),
k AS (SELECT id, len(s) AS n, unnest(s) AS x FROM c),
g AS (SELECT DISTINCT b FROM (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*)))),
gone AS (SELECT t.doc_id, t.no FROM t JOIN c USING (s) WHERE c.first <> struct_pack(d := t.doc_id, n := t.no) OR c.id IN (SELECT b FROM g)),
r AS (SELECT l.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY l.no) AS kept FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.no = gone.no GROUP BY l.doc_id),
a AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_lines, (coalesce(a.n, 0) - coalesce(r.n, 0))::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN r ON d.doc_id = r.doc_id
"""


def op8(threshold: float = licenses.THRESHOLD) -> str:
    rows = ", ".join(f"('{name}', {strings(grams)}, {length})" for name, grams, length in licenses.templates())
    return f"""
WITH t0(name, grams, length) AS (VALUES {rows}),
t AS (SELECT *, row_number() OVER () AS tid FROM t0),
u AS (SELECT doc_id, list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)), lambda x: list_filter(string_split(x, ' '), lambda w: w <> '')) AS units FROM documents),
w AS (SELECT doc_id, flatten(units) AS w, len(units) AS n FROM u),
p AS (SELECT doc_id, n, CASE WHEN len(w) > 1 THEN list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda z: z[1] || ' ' || z[2]) ELSE [] END AS g FROM w),
e AS (SELECT doc_id, unnest(units) AS w, generate_subscripts(units, 1) AS no FROM u),
s AS (SELECT doc_id, no, list_distinct(list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda z: z[1] || ' ' || z[2])) AS s FROM e WHERE len(w) > 1
  UNION ALL SELECT doc_id, 0, list_distinct(g) FROM p WHERE n > 1 AND len(g) > 0),
m AS (SELECT doc_id, no, name, 2.0::DOUBLE * len(list_intersect(s, grams)) / (len(s) + len(grams)) AS dice FROM s JOIN t ON len(list_intersect(s, grams)) > 0),
x AS (SELECT doc_id, g, tid, name, grams, length, unnest(range(1, len(g) + 1)) AS i FROM p JOIN t ON len(list_intersect(list_distinct(g), grams)) >= {threshold} / (2 - {threshold}) * len(grams) - 1e-9),
y AS (SELECT doc_id, tid, name, grams, list_distinct(g[i:i + length - 1]) AS s FROM x WHERE list_contains(grams, g[i])),
z AS (SELECT doc_id, tid, name, max(2.0::DOUBLE * len(list_intersect(s, grams)) / (len(s) + len(grams))) AS dice FROM y GROUP BY ALL),
h AS (SELECT doc_id, no AS unit, name, dice FROM m WHERE dice >= {threshold} UNION ALL SELECT doc_id, -tid, name, dice FROM z WHERE dice >= {threshold}),
a AS (SELECT doc_id, count(DISTINCT unit) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM h GROUP BY doc_id),
b AS (SELECT doc_id, name, dice FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) = 1)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_matches, coalesce(a.names, '') AS licenses, b.name AS best_license, round(b.dice, 6) AS best_dice
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN b ON d.doc_id = b.doc_id
"""


OP9 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
n AS (SELECT item_id, w[s:s + 12] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
o AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
c AS (SELECT DISTINCT o.doc_id, o.p, n.win FROM o JOIN (SELECT DISTINCT win FROM n) n ON o.x = n.win[1]),
h AS (SELECT c.doc_id, c.p, c.win FROM c JOIN d ON c.doc_id = d.doc_id WHERE d.w[c.p:c.p + len(c.win) - 1] = c.win),
v AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + len(win))) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT h.doc_id, n.item_id::VARCHAR AS item FROM h JOIN n ON h.win = n.win) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN v ON d.doc_id = v.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


def all_sql() -> dict[str, str]:
    return {
        "op1_capture_index": OP1,
        "op2_hyperminhash": OP2,
        "op3_distribution_rules": op3(),
        "op4_lookup_table": op4(16, 2003),
        "op5_fingerprint_index": OP5,
        "op7_line_set_join": OP7,
        "op8_license_dice": op8(),
        "op9_prefix_join": OP9,
    }
