"""Queries over text, with the SQL that says the same: detectors, language, clean-up, correction, barcodes, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import barcode as B
from ..functions import settings
from ..functions import text as X
from ..functions.patterns import DETECTORS, LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN
from ..operators import corrections as C
from ..operators import layout as L
from ..operators import pii, ranking
from .registry import query, table

LUHN = "(list_sum(list_transform(range(0, len({d})), lambda i: CASE WHEN i % 2 = 0 THEN ({d}[len({d}) - i])::INT ELSE ({d}[len({d}) - i])::INT * 2 - CASE WHEN ({d}[len({d}) - i])::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"


def sql_matches(category: str, source: str, key: str, text: str) -> str:
    """(key, match) rows of one detector."""
    pattern = DETECTORS[category].replace("'", "''")
    rows = f"SELECT {key}, unnest(regexp_extract_all({text}, '{pattern}')) AS match FROM {source}"
    if category != "credit_card":
        return rows
    digits = "regexp_replace(match, '[\\s-]', '', 'g')"
    return f"SELECT * FROM ({rows}) WHERE regexp_matches({digits}, '^[0-9]{{13,19}}$') AND {LUHN.format(d=digits)}"


def sql_all(source: str, key: str, text: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{c}' AS category, match FROM ({sql_matches(c, source, key, text)})" for c in DETECTORS)


@query(f"SELECT category, count(*) AS n_matches, count(DISTINCT doc_id) AS n_docs FROM ({sql_all('documents', 'doc_id', 'text')}) GROUP BY category")
def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.detect(table(spark, sf, "documents").select("doc_id", "text"))
    return found.groupBy("category").agg(F.count("*").alias("n_matches"), F.countDistinct("doc_id").alias("n_docs"))


def _category(name: str, category: str, source: str, key: str, make=None, make_sql: str = "text") -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, source)
        return pii.detect(rows.select(key, (make() if make else F.col("text")).alias("text")), categories=(category,)).select(key, "match")

    query(sql_matches(category, source, key, make_sql), name)(run)


_category("pii_card_luhn", "credit_card", "documents", "doc_id")
_category("pii_passport", "passport_rf", "documents", "doc_id")
_category("pii_email", "email", "documents", "doc_id")
_category("pii_phone", "phone_rf", "customer", "c_custkey", lambda: F.expr("concat('tel +7 (9', lpad(cast(c_custkey % 100 as string), 2, '0'), ') ', lpad(cast(c_custkey % 1000 as string), 3, '1'), '-12-', lpad(cast(c_custkey % 100 as string), 2, '3'), '; 8', lpad(cast(c_custkey as string), 10, '9'), ', 7', lpad(cast(c_custkey as string), 10, '5'))"),
          "'tel +7 (9' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || ') ' || lpad((c_custkey % 1000)::VARCHAR, 3, '1') || '-12-' || lpad((c_custkey % 100)::VARCHAR, 2, '3') || '; 8' || lpad(c_custkey::VARCHAR, 10, '9') || ', 7' || lpad(c_custkey::VARCHAR, 10, '5')")
_category("pii_date", "date", "documents", "doc_id")
_category("pii_inn", "inn", "customer", "c_custkey", lambda: F.expr("concat('INN ', lpad(cast(c_custkey as string), 10, '7'), '; 12 ', lpad(cast(c_custkey as string), 12, '5'), ' no ', lpad(cast(c_custkey as string), 9, '1'))"),
          "'INN ' || lpad(c_custkey::VARCHAR, 10, '7') || '; 12 ' || lpad(c_custkey::VARCHAR, 12, '5') || ' no ' || lpad(c_custkey::VARCHAR, 9, '1')")
_category("pii_snils", "snils", "customer", "c_custkey", lambda: F.expr("concat('S ', lpad(cast(c_custkey as string), 3, '4'), '-', '123 456', '-', lpad(cast(c_custkey % 97 as string), 2, '0'), '.')"),
          "'S ' || lpad(c_custkey::VARCHAR, 3, '4') || '-' || '123 456' || '-' || lpad((c_custkey % 97)::VARCHAR, 2, '0') || '.'")
_category("pii_kpp", "kpp", "supplier", "s_suppkey", lambda: F.expr("concat('KPP:', lpad(cast(s_suppkey as string), 4, '6'), '-12 ', lpad(cast(s_suppkey as string), 3, '3'), ',')"),
          "'KPP:' || lpad(s_suppkey::VARCHAR, 4, '6') || '-12 ' || lpad(s_suppkey::VARCHAR, 3, '3') || ','")


@query("SELECT page_id, match FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)example\\.[a-z]+') || regexp_extract_all(html, '(?i)LICENSE')) AS match FROM pages)")
def pii_custom(spark, sf):
    return pii.detect(table(spark, sf, "pages").select("page_id", F.col("html").alias("text")), categories=(), custom=[r"example\.[a-z]+", "[invalid", "LICENSE"]).select("page_id", "match")


LETTERS = r"len(regexp_extract_all({t}, '\p{{L}}'))"
CYR = r"(len(regexp_extract_all({t}, '[\x{{0400}}-\x{{0481}}\x{{048A}}-\x{{04FF}}]')) / nullif(" + LETTERS + ", 0))"
LAT = "(len(regexp_extract_all({t}, '[A-Za-z]')) / nullif(" + LETTERS + ", 0))"
USED = (f"CASE WHEN {LETTERS} = 0 THEN 'rus' WHEN {CYR} > 0.7 THEN 'rus' WHEN {LAT} > 0.7 THEN 'eng' WHEN {CYR} > 0.2 AND {LAT} > 0.2 THEN 'rus+eng' WHEN {CYR} > {LAT} THEN 'rus' ELSE 'eng' END")
STRICT = (f"CASE WHEN {LETTERS} = 0 THEN 'UNKNOWN' WHEN {CYR} > 0.6 THEN 'RUS' WHEN {LAT} > 0.6 THEN 'ENG' WHEN {CYR} > 0.15 AND {LAT} > 0.15 THEN 'RUS+ENG' WHEN {CYR} > {LAT} THEN 'RUS' WHEN {LAT} > {CYR} THEN 'ENG' ELSE 'UNKNOWN' END")

# Documents hold no Cyrillic: a share of their letters is replaced by look-alikes, so that every branch is taken.
MIXED_SQL = f"CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN translate(text, '{LOOKALIKE_LATIN}', '{LOOKALIKE_CYRILLIC}') WHEN 2 THEN translate(text, 'aeiontr', 'аеионтр') ELSE translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'абцдефгхийклмнопярстуввхызАБЦДЕФГХИЙКЛМНОПЯРСТУВВХЫЗ') END"


def mixed_documents(spark, sf):
    t, k = F.col("text"), F.col("doc_id") % 4
    made = (
        F.when(k == 0, t).when(k == 1, F.translate(t, LOOKALIKE_LATIN, LOOKALIKE_CYRILLIC)).when(k == 2, F.translate(t, "aeiontr", "аеионтр"))
        .otherwise(F.translate(t, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "абцдефгхийклмнопярстуввхызАБЦДЕФГХИЙКЛМНОПЯРСТУВВХЫЗ"))
    )
    return table(spark, sf, "documents").select("doc_id", made.alias("text"))


@query(f"SELECT doc_id, {USED.format(t='t')} AS language FROM (SELECT doc_id, {MIXED_SQL} AS t FROM documents)")
def lang_detect_used(spark, sf):
    return mixed_documents(spark, sf).select("doc_id", X.language(F.col("text")).alias("language"))


@query(f"SELECT doc_id, c AS language, CASE c WHEN 'RUS' THEN 'Русский' WHEN 'ENG' THEN 'English' WHEN 'RUS+ENG' THEN 'Русский + English' ELSE 'Unknown' END AS name FROM (SELECT doc_id, {STRICT.format(t='t')} AS c FROM (SELECT doc_id, {MIXED_SQL} AS t FROM documents))")
def lang_detect_strict(spark, sf):
    coded = mixed_documents(spark, sf).select("doc_id", X.language_strict(F.col("text")).alias("language"))
    return coded.withColumn("name", X.language_name(F.col("language")))


@query(f"SELECT {USED.format(t='text')} AS language, category, count(*) AS n_matches FROM documents JOIN ({sql_all('documents', 'doc_id', 'text')}) USING (doc_id) GROUP BY ALL")
def pii_by_language(spark, sf):
    docs = table(spark, sf, "documents").select(X.language(F.col("text")).alias("language"), "text")
    return pii.detect(docs).groupBy("language", "category").agg(F.count("*").alias("n_matches"))


# --- clean-up. Results are returned as hashes next to lengths, as whole texts would only be hashed again.
SPACES_SQL = r"regexp_replace(regexp_replace(regexp_replace({t}, ' {{2,}}', ' ', 'g'), ' +([.,;:!?)])', '\1', 'g'), '(\() +', '\1', 'g')"
BREAKS_SQL = r"array_to_string(list_transform(string_split(regexp_replace(replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), chr(10))"
DIGITS_SQL = r"regexp_replace(regexp_replace({t}, '([0-9])l([0-9])', '\1' || '1' || '\2', 'g'), '([0-9])O([0-9])', '\1' || '0' || '\2', 'g')"


def _rewrite(name: str, make, change, made_sql: str, change_sql: str, source: str = "documents", key: str = "doc_id") -> None:
    def run(spark, sf):
        rows = table(spark, sf, source).select(key, make().alias("text")).select(key, change(F.col("text")).alias("text"))
        return rows.select(key, F.char_length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))

    sql = f"SELECT {key}, length(t)::INT AS n_chars, sha256(t) AS sha256 FROM (SELECT {key}, {change_sql.format(t='s')} AS t FROM (SELECT {key}, {made_sql} AS s FROM {source}))" if change_sql else None
    query(sql, name)(run)


_spaced = lambda: F.replace(F.replace(F.col("text"), F.lit("."), F.lit("  .")), F.lit("("), F.lit("(  "))
_rewrite("clean_spaces", _spaced, X.fix_spaces, "replace(replace(text, '.', '  .'), '(', '(  ')", SPACES_SQL)
_rewrite("clean_linebreaks", lambda: F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n \t")), F.lit(","), F.lit("\n\n\n\r")), X.fix_line_breaks, "replace(replace(text, '. ', '.' || chr(13) || chr(10) || ' ' || chr(9)), ',', chr(10) || chr(10) || chr(10) || chr(13))", BREAKS_SQL)
_rewrite("clean_digits", lambda: F.translate(F.col("text"), "aeio", "10lO"), X.fix_digits, "translate(text, 'aeio', '10lO')", DIGITS_SQL)
_rewrite("clean_urls", lambda: F.concat(F.lit("see "), F.replace(F.replace(F.col("url"), F.lit("/"), F.lit(" / ")), F.lit(" /  / "), F.lit(" // ")), F.lit(", then")), X.fix_urls,
         "'see ' || replace(replace(url, '/', ' / '), ' /  / ', ' // ') || ', then'",
         r"array_to_string(list_transform(list_zip(regexp_split_to_array({t}, '(?i)https?\s*:\s*//\s*[a-zA-Z0-9\s._\-/]+'), regexp_extract_all({t}, '(?i)https?\s*:\s*//\s*[a-zA-Z0-9\s._\-/]+')), lambda z: z[1] || coalesce(regexp_replace(z[2], '\s+', '', 'g'), '')), '')", "pages", "page_id")
URLS_SQL = r"array_to_string(list_transform(list_zip(regexp_split_to_array({t}, '(?i)https?\s*:\s*//\s*[a-zA-Z0-9\s._\-/]+'), regexp_extract_all({t}, '(?i)https?\s*:\s*//\s*[a-zA-Z0-9\s._\-/]+')), lambda z: z[1] || coalesce(regexp_replace(z[2], '\s+', '', 'g'), '')), '')"
_rewrite("clean_text", lambda: F.concat(F.lit("at https : // a.b "), F.col("text"), F.lit(" 1l2 ")), X.clean, "'at https : // a.b ' || text || ' 1l2 '",
         r"regexp_replace(" + DIGITS_SQL.format(t=BREAKS_SQL.replace("{t}", SPACES_SQL.replace("{t}", URLS_SQL.replace("{t}", "s")))).replace("{", "{{").replace("}", "}}").replace("{{{{", "{{").replace("}}}}", "}}") + r", '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')")

MAP_WORD = rf"CASE WHEN len(regexp_extract_all(w, '[\x{{{{0400}}}}-\x{{{{052F}}}}]')) = 0 OR len(regexp_extract_all(w, '[A-Za-z]')) = 0 THEN w WHEN len(regexp_extract_all(w, '[\x{{{{0400}}}}-\x{{{{052F}}}}]')) >= len(regexp_extract_all(w, '[A-Za-z]')) THEN translate(w, '{LOOKALIKE_LATIN}', '{LOOKALIKE_CYRILLIC}') ELSE translate(w, '{LOOKALIKE_CYRILLIC}', '{LOOKALIKE_LATIN}') END"
_rewrite("post_mixed_alphabet", lambda: F.translate(F.col("text"), "ontr", "онтр"), X.fix_mixed_alphabets, "translate(text, 'ontr', 'онтр')",
         r"array_to_string(list_transform(regexp_extract_all({t}, '[\p{{L}}0-9]+|[^\p{{L}}0-9]+'), lambda w: " + MAP_WORD + "), '')")
_rewrite("post_substitutions", lambda: F.replace(F.replace(F.col("text"), F.lit(" the"), F.lit("   the")), F.lit(","), F.lit(" ,,")), X.substitute, "replace(replace(text, ' the', '   the'), ',', ' ,,')", "replace(replace(replace(replace({t}, '  ', ' '), ' ,', ','), ' .', '.'), ',,', ',')")
_rewrite("post_spaces", lambda: F.replace(F.replace(F.col("text"), F.lit(" of"), F.lit("   of")), F.lit("\n"), F.lit("  \r\n   ")), X.normalize_space, "replace(replace(text, ' of', chr(160) || ' ' || chr(8195) || 'of'), chr(10), '  ' || chr(13) || chr(10) || '   ')",
         r"array_to_string(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({t}, '[\x{{00A0}}\x{{2000}}-\x{{200B}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g'), '(\S) {{2,}}', '\1 ', 'g'), '\r\n|\n|\r'), lambda x: regexp_replace(x, '[\s\p{{Z}}]+$', '')), chr(10))")
_quotes = r"array_to_string(list_transform(string_split({t}, chr(34)), lambda p, i: CASE WHEN i = 1 THEN '' WHEN i % 2 = 0 THEN '«' ELSE '»' END || p), '')"
_rewrite("post_quotes", lambda: F.replace(F.col("text"), F.lit(" th"), F.lit(' "th')), X.pair_quotes, "replace(text, ' th', ' ' || chr(34) || 'th')", _quotes)
_rewrite("post_punctuation", lambda: F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(" ,")), F.lit(" of "), F.lit(" - ")), X.fix_punctuation, "replace(replace(text, ', ', ' ,'), ' of ', ' - ')",
         r"regexp_replace(regexp_replace(regexp_replace({t}, ' +([,\.;:!?])', '\1', 'g'), '([,;:!?])([\p{{L}}0-9])', '\1 \2', 'g'), '(\p{{L}}) - (\p{{L}})', '\1 — \2', 'g')")


@query()
def post_digit_letter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.translate("text", "aeiz", "0l13").alias("text"))
    return docs.select("doc_id", F.sha2(C.fix_digits_and_letters("text").cast("binary"), 256).alias("sha256"))


@query()
def post_linebreak(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit(",\n")).alias("text"))
    return docs.select("doc_id", F.sha2(C.restore_line_breaks("text").cast("binary"), 256).alias("sha256"))


@query()
def post_changes_by_processor(spark, sf):
    docs = mixed_documents(spark, sf).withColumn("fixed", C.corrected(F.col("text"), F.when(F.col("doc_id") % 5 == 0, "TABLE"), F.lit("ru")))
    # Not explode: Spark would ask for texts with changes first, and run the chain a second time for that.
    return docs.select(F.explode_outer("fixed.changes").alias("c")).where("c is not null").groupBy(F.col("c.processor").alias("processor")).agg(F.count("*").alias("n_changes"), F.round(F.avg("c.confidence"), 9).alias("confidence"))


@query()
def post_statistics(spark, sf):
    docs = mixed_documents(spark, sf).withColumn("fixed", C.corrected(F.col("text")))
    s = C.statistics(docs, "text", "fixed").select("doc_id", "statistics.*")
    return s.select("doc_id", "total", F.to_json("by_processor").alias("by_processor"), "length_before", "length_after")


ITEM_SQL = r"regexp_matches(regexp_replace(line, '^[\s\p{Z}]+', ''), '^([0-9]+[.)>]\s.*|[-–—•*]\s.*|[а-яa-z][.)>]\s.*)$')"


@query(rf"""
WITH l AS (SELECT doc_id, unnest(p) AS line, unnest(p[2:] || [NULL]) AS following, generate_subscripts(p, 1) AS no FROM (SELECT doc_id, string_split(replace(text, ', ', chr(10) || '- '), chr(10)) AS p FROM documents)),
t AS (SELECT *, regexp_replace(line, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS x FROM l)
SELECT doc_id, no, {ITEM_SQL} AS is_item, ((length(x) < 60 AND upper(x) = x AND regexp_matches(x, '\p{{L}}')) OR (length(x) < 80 AND coalesce(regexp_replace(following, '^[\s\p{{Z}}]+', '') = '', false))) AS is_heading FROM t
""")
def post_line_kinds(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.split(F.replace("text", F.lit(", "), F.lit("\n- ")), "\n", -1).alias("p"))
    rows = docs.select("doc_id", "p", F.posexplode("p").alias("i", "line"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("no"), X.is_list_item(F.col("line")).alias("is_item"), X.is_heading(F.col("line"), F.get("p", F.col("i") + 1)).alias("is_heading"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n_words, len(string_split(text, chr(10))) AS n_lines, 'OCR[batch]: ' || len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) || ' words, ' || len(string_split(text, chr(10))) || ' blocks, ' || (doc_id % 101)::VARCHAR || '% conf, ' || n_chars || 'ms, lang=' || lang AS summary FROM documents")
def doc_counters(spark, sf):
    d = table(spark, sf, "documents")
    n_lines = F.size(F.split("text", "\n", -1))
    words = X.word_count(F.col("text"))
    return d.select("doc_id", words.cast("long").alias("n_words"), n_lines.cast("long").alias("n_lines"),
                    L.summary(F.lit("batch"), words, n_lines, (F.col("doc_id") % 101 + 0.5) / 100, F.col("n_chars").cast("int"), F.col("lang")).alias("summary"))


# --- words
TOKENS = r"SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS no FROM (SELECT doc_id, string_split(replace(text, ' a', ' |~a'), ' ') AS p FROM documents)"


def _tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split(F.replace("text", F.lit(" a"), F.lit(" |~a")), " ", -1).alias("p"))
    return d.select("doc_id", F.posexplode("p").alias("ordinal", "text")).withColumn("confidence", (F.col("doc_id") * 7 + F.col("ordinal")) % 101)


# Applied twice, a replacement that consumes both digits does what one that only looks at them does.
_once = "regexp_replace({}, '([0-9]){}([0-9])', '\\1{}\\2', 'g')"
_ONCE = _once.format(_once.format("t", "l", "1"), "O", "0")
_TWICE = _once.format(_once.format(_once.format(_once.format("t", "l", "1"), "l", "1"), "O", "0"), "O", "0")


@query(rf"""
SELECT doc_id, count(*) AS n_words, md5(string_agg(c, ' ' ORDER BY no)) AS words FROM (SELECT doc_id, no, {_TWICE} AS c FROM (
  SELECT doc_id, no, regexp_replace(regexp_replace(w, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '^[|\[\]{{}}~`^\\]+|[|\[\]{{}}~`^\\]+$', '', 'g') AS t
  FROM (SELECT doc_id, no, CASE WHEN no % 9 = 0 THEN '[' || no || 'l' || doc_id || 'O1l1' ELSE w END AS w FROM ({TOKENS}))
  WHERE (doc_id * 7 + no - 1) % 101 >= 15 AND regexp_replace(w, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') <> '' AND NOT regexp_matches(regexp_replace(w, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '^[^\p{{L}}\p{{Nd}}]$')
    AND NOT regexp_matches(w, '[|\[\]{{}}~`^\\]{{2,}}'))) WHERE c <> '' GROUP BY doc_id
""")
def word_filters(spark, sf):
    """Every ninth word is one with a bracket and digits to mend."""
    at = F.col("ordinal") + 1
    words = _tokens(spark, sf).withColumn("text", F.when(at % 9 == 0, F.concat(F.lit("["), at, F.lit("l"), "doc_id", F.lit("O1l1"))).otherwise(F.col("text")))
    return L.filter_words(words).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.md5(L.ordered_text("ordinal", "text", " ").cast("binary")).alias("words"))


@query(r"""
SELECT doc_id, round(avg(c), 9) AS confidence, round(avg(c * 0.7), 9) AS handwritten FROM (
  SELECT doc_id, CASE WHEN regexp_replace(w, '^[\s\p{Z}]+', '') = '' THEN 0 ELSE least(1, greatest(0, 0.85::DOUBLE * len(regexp_extract_all(w, '[\p{L}\p{Nd}]')) / length(w) + CASE WHEN length(w) >= 5 THEN 0.1::DOUBLE WHEN length(w) >= 3 THEN 0.05::DOUBLE ELSE 0::DOUBLE END)) END AS c FROM (""" + TOKENS + ")) GROUP BY doc_id")
def conf_estimate(spark, sf):
    w = _tokens(spark, sf)
    return w.groupBy("doc_id").agg(F.round(F.avg(X.confidence(F.col("text"))), 9).alias("confidence"), F.round(F.avg(X.confidence(F.col("text"), handwritten=True)), 9).alias("handwritten"))


@query(rf"""
SELECT doc_id, CASE WHEN regexp_replace(t, '^[\s\p{{Z}}]+', '') <> '' AND c > 0.6 AND (coalesce(len(regexp_extract_all(t, '[\x{{0410}}-\x{{044F}}\x{{0401}}\x{{0451}}]')) / nullif(len(regexp_extract_all(t, '\p{{L}}')), 0), 0) > 0.2 OR len(regexp_extract_all(t, '\p{{L}}')) < 5) THEN 'fast' WHEN quality IS NOT NULL THEN 'second' ELSE 'none' END AS engine
FROM (SELECT d.doc_id, {MIXED_SQL} AS t, (d.doc_id % 10) / 10.0 AS c, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
""".replace("doc_id % 4", "d.doc_id % 4"))
def engine_choice(spark, sf):
    """The fast engine's text where it is accepted, else the second engine's (here: documents with a label), else none."""
    second = table(spark, sf, "labels").select("doc_id", "quality")
    both = mixed_documents(spark, sf).join(second, "doc_id", "left")
    fast = X.accepts_fast_engine(F.col("text"), (F.col("doc_id") % 10) / 10)
    return both.select("doc_id", F.when(fast, "fast").when(F.col("quality").isNotNull(), "second").otherwise("none").alias("engine"))


# --- barcodes: payloads are composed from keys
CODES_SQL = """(SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN 'https://shop.example/' || p_partkey WHEN 1 THEN 'WIFI:S:net' || p_partkey || ';T:' || CASE p_partkey % 4 WHEN 1 THEN 'nopass' WHEN 3 THEN 'wep' ELSE '' END || ';P:;S:last' || p_partkey % 7 || ';;'
  WHEN 2 THEN 'BEGIN:VCARD' || chr(10) || 'FN:' || p_name || chr(10) || 'TEL;CELL: +' || p_partkey || ' ' || chr(10) || 'TEL:' || p_size || chr(10) || 'EMAIL:a' || p_partkey || '@b.co' || chr(10) || 'END:VCARD' WHEN 3 THEN 'mailto:u' || p_partkey || '@x.org?subject=s'
  WHEN 4 THEN 'tel:+' || p_partkey WHEN 5 THEN 'smsto:+' || p_partkey || ':hi:there' WHEN 6 THEN 'geo:' || p_size || '.5,' || p_partkey % 90 || CASE WHEN p_partkey % 4 = 0 THEN '?q=a' ELSE '' END WHEN 7 THEN lpad((p_partkey * 7919 % 1000)::VARCHAR, 3, '0') || lpad(p_partkey::VARCHAR, 10, '3')
  WHEN 8 THEN lpad((p_partkey * 31)::VARCHAR, 8, '5') ELSE p_name END AS raw, CASE p_partkey % 10 WHEN 7 THEN 'EAN_13' WHEN 8 THEN 'EAN_8' WHEN 9 THEN 'CODE_128' ELSE 'QR_CODE' END AS format FROM part)"""


def codes(spark, sf):
    raw = """CASE p_partkey % 10 WHEN 0 THEN concat('https://shop.example/', p_partkey) WHEN 1 THEN concat('WIFI:S:net', p_partkey, ';T:', CASE p_partkey % 4 WHEN 1 THEN 'nopass' WHEN 3 THEN 'wep' ELSE '' END, ';P:;S:last', p_partkey % 7, ';;')
      WHEN 2 THEN concat('BEGIN:VCARD\\nFN:', p_name, '\\nTEL;CELL: +', p_partkey, ' \\nTEL:', p_size, '\\nEMAIL:a', p_partkey, '@b.co\\nEND:VCARD') WHEN 3 THEN concat('mailto:u', p_partkey, '@x.org?subject=s')
      WHEN 4 THEN concat('tel:+', p_partkey) WHEN 5 THEN concat('smsto:+', p_partkey, ':hi:there') WHEN 6 THEN concat('geo:', p_size, '.5,', p_partkey % 90, CASE WHEN p_partkey % 4 = 0 THEN '?q=a' ELSE '' END)
      WHEN 7 THEN concat(lpad(cast(p_partkey * 7919 % 1000 as string), 3, '0'), lpad(cast(p_partkey as string), 10, '3')) WHEN 8 THEN lpad(cast(p_partkey * 31 as string), 8, '5') ELSE p_name END"""
    kind = "CASE p_partkey % 10 WHEN 7 THEN 'EAN_13' WHEN 8 THEN 'EAN_8' WHEN 9 THEN 'CODE_128' ELSE 'QR_CODE' END"
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(raw).alias("raw"), F.expr(kind).alias("format"))


TYPE_SQL = r"CASE WHEN starts_with(raw, 'http://') OR starts_with(raw, 'https://') THEN 'URL' WHEN starts_with(raw, 'WIFI:') THEN 'WIFI' WHEN starts_with(raw, 'BEGIN:VCARD') OR starts_with(raw, 'MECARD:') THEN 'CONTACT_VCARD' WHEN starts_with(raw, 'mailto:') OR regexp_matches(raw, '^[\w.+-]+@[\w-]+\.[\w.]+$') THEN 'EMAIL' WHEN starts_with(lower(raw), 'tel:') THEN 'PHONE' WHEN starts_with(raw, 'smsto:') OR starts_with(raw, 'SMSTO:') OR starts_with(raw, 'sms:') THEN 'SMS' WHEN starts_with(raw, 'geo:') THEN 'GEO' WHEN format IN ('EAN_13', 'EAN_8', 'UPC_A', 'UPC_E') THEN 'PRODUCT' ELSE 'TEXT' END"


@query(f"SELECT id, kind, CASE kind WHEN 'URL' THEN 'Ссылка' WHEN 'WIFI' THEN 'WiFi сеть' WHEN 'CONTACT_VCARD' THEN 'Контакт' WHEN 'EMAIL' THEN 'Email' WHEN 'PHONE' THEN 'Телефон' WHEN 'SMS' THEN 'SMS' WHEN 'GEO' THEN 'Геолокация' WHEN 'PRODUCT' THEN 'Товар (' || CASE format WHEN 'EAN_13' THEN 'EAN-13' ELSE 'EAN-8' END || ')' ELSE 'Текст' END AS title, CASE kind WHEN 'EMAIL' THEN replace(raw, 'mailto:', '') WHEN 'PHONE' THEN substr(raw, 5) ELSE raw END AS plain FROM (SELECT *, {TYPE_SQL} AS kind FROM {CODES_SQL})")
def barcode_classify(spark, sf):
    c = codes(spark, sf).withColumn("p", B.parsed(F.col("raw"), F.col("format")))
    plain = F.coalesce("p.email", "p.phone", "raw")
    return c.select("id", F.col("p.kind").alias("kind"), B.title(F.col("p.kind"), F.col("format")).alias("title"), plain.alias("plain"))


@query("WITH c AS (SELECT id, CASE WHEN id % 3 = 0 THEN lpad((id * 31)::VARCHAR, 8, '5') WHEN id % 3 = 1 THEN lpad((id * 7919)::VARCHAR, 13, '46') ELSE lpad(id::VARCHAR, 9, '1') END AS code FROM (SELECT p_partkey AS id FROM part)) SELECT id, code, CASE WHEN length(code) IN (8, 12, 13, 14) THEN (10 - list_sum(list_transform(range(2, length(code) + 1), lambda i: (code[length(code) - i + 1])::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 = (code[length(code)])::INT ELSE false END AS valid FROM c")
def barcode_ean(spark, sf):
    code = F.expr("CASE WHEN p_partkey % 3 = 0 THEN lpad(cast(p_partkey * 31 as string), 8, '5') WHEN p_partkey % 3 = 1 THEN lpad(cast(p_partkey * 7919 as string), 13, '46') ELSE lpad(cast(p_partkey as string), 9, '1') END")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), code.alias("code")).withColumn("valid", B.check_digit_valid(F.col("code")))


def _countries(table_) -> str:
    return "CASE " + " ".join(f"WHEN n BETWEEN {a} AND {b} THEN '{c}'" for a, b, c in table_) + " END"


@query(f"SELECT id, {_countries(B.COUNTRIES)} AS country, {_countries(B.MORE_COUNTRIES)} AS country_long FROM (SELECT p_partkey AS id, p_partkey * 7919 % 1000 AS n FROM part)")
def barcode_country(spark, sf):
    code = F.concat(F.lpad((F.col("p_partkey") * 7919 % 1000).cast("string"), 3, "0"), F.lit("0000000000"))
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), code.alias("code"))
    return c.select("id", B.country(F.col("code")).alias("country"), B.country(F.col("code"), B.MORE_COUNTRIES).alias("country_long"))


def _only(spark, sf, kind):
    c = codes(spark, sf)
    return c.where(B.content_type(F.col("raw"), F.col("format")) == kind)


@query(rf"WITH m AS (SELECT id, regexp_extract_all(substr(raw, 9), '([TSPH]):([^;]*)') AS a FROM {CODES_SQL} WHERE starts_with(raw, 'WIFI:')), v AS (SELECT id, list_filter(a, lambda x: x[1] = 'S')[-1][3:] AS s, list_filter(a, lambda x: x[1] = 'P')[-1][3:] AS p, upper(list_filter(a, lambda x: x[1] = 'T')[-1][3:]) AS t FROM m) SELECT id, coalesce(s, '') AS ssid, p AS password, CASE WHEN t IN ('WEP', 'WPA', 'WPA2') THEN t WHEN t = '' THEN 'OPEN' ELSE 'WPA' END AS encryption FROM v")
def barcode_wifi(spark, sf):
    return _only(spark, sf, "WIFI").select("id", B.wifi(F.col("raw")).alias("w")).select("id", "w.*")


@query(rf"SELECT id, nullif(regexp_extract(raw, 'FN:(.+)', 1), '') AS name, array_to_string(list_transform(regexp_extract_all(raw, 'TEL[^:]*:(.+)', 1), lambda x: trim(x)), ',') AS phones, array_to_string(regexp_extract_all(raw, 'EMAIL[^:]*:(.+)', 1), ',') AS emails FROM {CODES_SQL} WHERE starts_with(raw, 'BEGIN:VCARD')")
def barcode_vcard(spark, sf):
    return _only(spark, sf, "CONTACT_VCARD").select("id", B.vcard(F.col("raw")).alias("v")).select("id", "v.name", F.array_join("v.phones", ",").alias("phones"), F.array_join("v.emails", ",").alias("emails"))


@query(f"SELECT id, string_split(substr(raw, 7), ':')[1] AS number, regexp_replace(substr(raw, 7), '^[^:]*:', '') AS message FROM {CODES_SQL} WHERE starts_with(raw, 'smsto:')")
def barcode_sms(spark, sf):
    return _only(spark, sf, "SMS").select("id", B.sms(F.col("raw")).alias("s")).select("id", "s.*")


@query(f"SELECT id, coalesce(try_cast(string_split(substr(raw, 5), ',')[1] AS DOUBLE), 0) AS latitude, coalesce(try_cast(string_split(substr(raw, 5), ',')[2] AS DOUBLE), 0) AS longitude FROM {CODES_SQL} WHERE starts_with(raw, 'geo:')")
def barcode_geo(spark, sf):
    return _only(spark, sf, "GEO").select("id", B.geo(F.col("raw")).alias("g")).select("id", "g.*")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'two' ELSE 'one' END AS engine FROM supplier WHERE NOT (s_suppkey % 6 = 3)")
def barcode_engine(spark, sf):
    """The first decoder's results, or the second's where it has none; suppliers stand for images."""
    s = F.col("s_suppkey")
    one, two = F.when(s % 3 != 0, F.array(F.lit("one"))), F.when(s % 6 != 3, F.array(F.lit("two")))
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(B.first_engine("AUTO", one, two)).alias("engine"))


@query(f"SELECT id, raw, format, 'some' AS list FROM {CODES_SQL} WHERE format IN ('EAN_13', 'CODE_128') UNION ALL SELECT id, raw, format, 'all' FROM {CODES_SQL}")
def barcode_allowed_formats(spark, sf):
    every = codes(spark, sf)
    kept = lambda name, *formats: every.where(B.allowed(F.col("format"), formats)).select("id", "raw", "format", F.lit(name).alias("list"))
    return kept("some", "EAN_13", "CODE_128").unionByName(kept("all"))


_cases = lambda of, names, default: f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {default} END"
_pick = lambda names: f"list_value({', '.join(repr(n) for n in names)})[p_partkey % {len(names)} + 1]"
_FORMATS, _VALUES = [*B.FORMAT_NAMES, "MAXICODE"], [*B.VALUE_TYPES, "TYPE_ISBN"]


@query(f"SELECT p_partkey, {_cases(_pick(_FORMATS), B.FORMAT_NAMES, repr(B.UNKNOWN_FORMAT))} AS format_name, {_cases(_pick(_VALUES), B.VALUE_TYPES, repr('UNKNOWN'))} AS kind FROM part")
def barcode_codes(spark, sf):
    """Names of all formats, and content types of all value types, with one of each that is not known."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", B.format_name(pick(_FORMATS)).alias("format_name"), B.content_type_of_value(pick(_VALUES)).alias("kind"))


@query("""
SELECT o_orderkey, min(l_partkey % 97)::DOUBLE AS "left", min(l_suppkey % 89)::DOUBLE AS top, max(l_partkey % 97)::DOUBLE AS "right", max(l_suppkey % 89)::DOUBLE AS bottom
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(*) >= 2
""")
def barcode_points(spark, sf):
    """The box around the points of a code; lines of an order stand for them."""
    points = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr("struct(cast(l_partkey % 97 as double) AS x, cast(l_suppkey % 89 as double) AS y)")).alias("points"))
    at = points.select(F.col("l_orderkey").alias("o_orderkey"), B.points_box(F.col("points")).alias("box")).where("box is not null")
    return at.select("o_orderkey", "box.*")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value / 200 >= 0.9 THEN 'good' WHEN value / 200 >= 0.7 THEN 'fair' ELSE 'poor' END AS icon FROM events")
def accuracy_icon(spark, sf):
    return table(spark, sf, "events").select("event_id", ranking.icon(F.col("event_type") != "error", F.col("value") / 200).alias("icon"))


@query(r"""
WITH d AS (SELECT doc_id, string_split(replace(replace(replace(text, ', ', ',' || chr(10)), ' a', chr(10) || '- a'), ' t', chr(10) || 't'), chr(10)) AS p FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(p))) AS no, p FROM d), m AS (SELECT doc_id, no, p[no] AS line, p[no + 1] AS following FROM l)
SELECT doc_id, no, regexp_replace(line, '^[\s\p{Z}]+', '') <> '' AND regexp_replace(following, '^[\s\p{Z}]+', '') <> '' AND NOT regexp_matches(line, '[.!?:;]$') AND NOT regexp_matches(following, '^(  |\t)')
  AND NOT regexp_matches(regexp_replace(following, '^[\s\p{Z}]+', ''), '^(\d+[.)>]\s.*|[-–—•*]\s.*|[а-яa-z][.)>]\s.*)$') AND (regexp_matches(following, '^\p{Ll}') OR regexp_matches(line, '(-|,| и| или| а| но)$')) AS merges FROM m
""")
def post_merges(spark, sf):
    """Whether each line goes on in the next; commas and two first letters break the lines."""
    broken = F.replace(F.replace(F.replace("text", F.lit(", "), F.lit(",\n")), F.lit(" a"), F.lit("\n- a")), F.lit(" t"), F.lit("\nt"))
    rows = table(spark, sf, "documents").select("doc_id", F.split(broken, "\n", -1).alias("p")).select("doc_id", "p", F.posexplode("p").alias("i", "line"))
    rows = rows.withColumn("following", F.get("p", F.col("i") + 1)).where("following is not null")
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("no"), X.merges(F.col("line"), F.col("following")).alias("merges"))


@query("""
SELECT c_custkey, CASE upper(n) WHEN 'MLKIT' THEN 'mlkit' WHEN 'TESSERACT' THEN 'tesseract' ELSE 'hybrid' END AS by_name, CASE c_custkey % 3 WHEN 0 THEN 'mlkit' WHEN 1 THEN 'tesseract' ELSE 'hybrid' END AS by_type
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'mlKit' WHEN 1 THEN 'TESSERACT' WHEN 2 THEN 'Hybrid' ELSE c_mktsegment END AS n FROM customer)
""")
def engine_dispatch(spark, sf):
    name = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'mlKit' WHEN 1 THEN 'TESSERACT' WHEN 2 THEN 'Hybrid' ELSE c_mktsegment END")
    kind = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'ML_KIT' WHEN 1 THEN 'TESSERACT' ELSE 'HYBRID' END")
    return table(spark, sf, "customer").select("c_custkey", settings.engine_of_name(name).alias("by_name"), settings.engine_of_type(kind).alias("by_type"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 10 THEN 0 ELSE CASE s_suppkey % 11 WHEN 6 THEN 90 WHEN 3 THEN 180 WHEN 8 THEN 270 ELSE 0 END END::INT AS degrees FROM supplier")
def exif_rotation(spark, sf):
    """Rotation of images whose heads are written from keys, in both byte orders; one in eleven has no directory."""
    from ..sources.image_files import rotation

    tag = "lpad(hex(s_suppkey % 11), 2, '0')"
    big = f"concat('4D4D002A00000008', '0001', '0112', '0003', '00000001', '00', {tag}, '0000', '00000000')"
    little = f"concat('49492A0008000000', '0100', '1201', '0300', '01000000', {tag}, '00', '0000', '00000000')"
    head = F.expr(f"unhex(concat('FFD8', CASE WHEN s_suppkey % 11 = 10 THEN 'FFDA' ELSE concat('FFE1', '0022', '457869660000', CASE WHEN s_suppkey % 2 = 0 THEN {big} ELSE {little} END, 'FFDA') END))")
    return table(spark, sf, "supplier").select("s_suppkey", rotation(head).alias("degrees"))


@query("SELECT doc_id, left(text, 50) || CASE WHEN length(text) > 50 THEN '…' ELSE '' END AS preview FROM documents")
def text_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("SELECT s_nationkey, bool_or(s_suppkey % 4 = 1) AS ready FROM supplier GROUP BY s_nationkey")
def engine_any_ready(spark, sf):
    """Suppliers stand for engines, nations for devices."""
    return ranking.any_ready(table(spark, sf, "supplier").select("s_nationkey", (F.col("s_suppkey") % 4 == 1).alias("ready")), "s_nationkey")


@query(f"SELECT c_custkey, {_ONCE} AS consuming, {_TWICE} AS everywhere FROM (SELECT c_custkey, translate((c_custkey * 7919 + 131313)::VARCHAR, '38', 'lO') AS t FROM customer)")
def digit_fixes(spark, sf):
    t = F.translate((F.col("c_custkey").cast("long") * 7919 + 131313).cast("string"), "38", "lO")
    return table(spark, sf, "customer").select("c_custkey", X.fix_digits(t).alias("consuming"), X.fix_digits_everywhere(t).alias("everywhere"))


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(coalesce(text, ''), '{DETECTORS[c]}') AS {c}" for c in DETECTORS) + f", doc_id IN (SELECT doc_id FROM ({sql_all('documents', 'doc_id', 'text')})) AS any_pii FROM documents")
def pii_contains(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", *[pii.contains(t, c).alias(c) for c in DETECTORS], pii.has_pii(t).alias("any_pii"))


# --- accuracy
# levenshtein counts bytes there, so each other character of an item becomes a control character of one byte first.
@query(r"""
WITH b AS (SELECT item_id, trim(lower(text)) AS e, trim(lower(replace(translate(text, 'aeo', 'ecu'), 'th', 't'))) AS a FROM benchmark),
m AS (SELECT *, array_to_string(list_distinct(regexp_extract_all(e || a, '[^\x{0}-\x{7F}]')), '') AS wide FROM b),
c AS (SELECT item_id, translate(e, wide, left(array_to_string(list_transform(range(14, 32), lambda k: chr(k::INT)), ''), length(wide)::INT)) AS e,
  translate(a, wide, left(array_to_string(list_transform(range(14, 32), lambda k: chr(k::INT)), ''), length(wide)::INT)) AS a FROM m)
SELECT item_id, round(CASE WHEN e = '' THEN CASE WHEN a = '' THEN 1 ELSE 0 END ELSE greatest(0, 1 - levenshtein(e, a)::DOUBLE / greatest(length(e), length(a))) END, 9) AS accuracy FROM c
""")
def char_accuracy(spark, sf):
    b = table(spark, sf, "benchmark")
    actual = F.replace(F.translate("text", "aeo", "ecu"), F.lit("th"), F.lit("t"))
    return b.select("item_id", F.round(X.char_accuracy(F.col("text"), actual), 9).alias("accuracy"))


@query(r"""
WITH RECURSIVE b AS (SELECT item_id, lower(text) AS e, lower(replace(text, 'th', 't')) AS a FROM benchmark),
m AS (SELECT *, array_to_string(list_distinct(regexp_extract_all(e || a, '[^\x{0}-\x{7F}]')), '') AS wide FROM b),
n AS (SELECT item_id, e, a, wide, left(array_to_string(list_transform(range(14, 32), lambda k: chr(k::INT)), ''), length(wide)::INT) AS narrow FROM m),
w AS (SELECT item_id, list_filter(regexp_split_to_array(translate(e, wide, narrow), '\s+'), lambda x: x <> '') AS e, list_filter(regexp_split_to_array(translate(a, wide, narrow), '\s+'), lambda x: x <> '') AS a FROM n),
f(item_id, i, free, hits) AS (SELECT item_id, 0, a, 0 FROM w UNION ALL
  SELECT item_id, i + 1, CASE WHEN pos > 0 THEN free[:pos - 1] || free[pos + 1:] ELSE free END, hits + CASE WHEN pos > 0 THEN 1 ELSE 0 END
  FROM (SELECT f.item_id, i, free, hits, coalesce(list_position(list_transform(free, lambda x: levenshtein(x, w.e[i + 1]) <= 1), true), 0) AS pos FROM f JOIN w ON f.item_id = w.item_id WHERE i < len(w.e)))
SELECT f.item_id, round(CASE WHEN len(w.e) = 0 THEN CASE WHEN len(w.a) = 0 THEN 1 ELSE 0 END ELSE hits / len(w.e) END, 9) AS accuracy FROM f JOIN w ON f.item_id = w.item_id WHERE i = len(w.e)
""")
def word_accuracy(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.round(X.word_accuracy(F.col("text"), F.replace("text", F.lit("th"), F.lit("t"))), 9).alias("accuracy"))
