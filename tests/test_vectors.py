"""Literal cases: detectors, correction, language, barcodes, confidence, plans and flows."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import barcode as B
from palimpsest.functions import geometry as G
from palimpsest.functions import text as X
from palimpsest.operators import corrections as C
from palimpsest.operators import layout as L
from palimpsest.operators import licences as K
from palimpsest.operators import pii, ranking


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r.x for r in df.select("i", expression(F.col("text")).alias("x")).orderBy("i").collect()]


HITS = {
    "credit_card": ["4532015112830366", "5555555555554444", "378282246310005", "4532-0151-1283-0366", "4532 0151 1283 0366"],
    "passport_rf": ["4400 123456", "4400123456", "5012345678"],
    "email": ["test@example.com", "user.name+tag@domain.co.uk", "user123@test-domain.org"],
    "phone_rf": ["+7 (999) 123-45-67", "+79991234567", "8 (999) 123-45-67", "89991234567"],
    "date": ["01.01.2023", "01/01/2023", "25.12.95"],
    "inn": ["123456789012", "1234567890"],
    "snils": ["123-456-789-00", "12345678900"],
    "kpp": ["1234-12-123", "1234 12 123"],
}


@pytest.mark.parametrize("category", HITS)
def test_detectors_find(spark, category):
    found = column(spark, HITS[category], lambda t: pii.found(t, category))
    assert [f[0] for f in found] == HITS[category]


def test_detectors_refuse(spark):
    assert column(spark, ["1234567890123456", "4532015112830367", "4532-0151-1283-036", "abc4567890123456", "", None], lambda t: pii.found(t, "credit_card")) == [[]] * 6


def test_mixed_text_and_custom(spark):
    df = spark.createDataFrame([(1, "Contact: test@example.com, Phone: +79991234567, Card: 4532015112830366"), (2, "a secret-ABCD"), (3, None)], "doc_id int, text string")
    rows = pii.detect(df, categories=("email", "phone_rf", "credit_card"), custom=["[invalid-regex", r"\bSECRET-[A-Z0-9]{4}\b"]).collect()
    assert sorted((r.doc_id, r.category, r.match) for r in rows) == [(1, "credit_card", "4532015112830366"), (1, "email", "test@example.com"), (1, "phone_rf", "+79991234567"), (2, "custom", "secret-ABCD")]
    assert column(spark, ["mail a@b.co now"], pii.mask) == ["mail ██████ now"]


def test_cleaning(spark):
    assert column(spark, ["see https : // a.b/c d, x", "no link", "http://a.b http://c.d я"], X.fix_urls) == ["see https://a.b/cd, x", "no link", "http://a.bhttp://c.d я"]
    assert column(spark, ["a  b , c ( d )"], X.fix_spaces) == ["a b, c (d)"]
    assert column(spark, ["a\r\n\r\n\r\n b \r c"], X.fix_line_breaks) == ["a\n\nb\nc"]
    assert column(spark, ["1l2l3 4O5"], X.fix_digits) == ["112l3 405"]
    assert column(spark, ["1l2l3 4O5"], X.fix_digits_everywhere) == ["11213 405"]
    assert column(spark, [" \t ", "a  b "], X.clean) == ["", "a b"]
    assert column(spark, ["a   b , c,,d"], X.substitute) == ["a  b, c,d"]
    assert column(spark, ["a  b  \r\n  c "], X.normalize_space) == ["a b\n  c"]
    assert column(spark, ['"a" "b'], X.pair_quotes) == ["«a» «b"]
    assert column(spark, ["a ,b 12:30 x - y - z"], X.fix_punctuation) == ["a, b 12: 30 x — y - z"]


def test_mixed_alphabets(spark):
    cases = {"Мосkва — столица Pоссии": "Мосkва — столица России", "Неllо Wоrld": "Неllо World", "Hello": "Hello"}
    assert column(spark, list(cases), X.fix_mixed_alphabets) == list(cases.values())
    assert [C.mixed_alphabets(t, []) for t in cases] == list(cases.values())


def test_digits_and_letters(spark):
    cases = {"Сумма: 1О00": "Сумма: 1000", "Д0кумент": "ДОкумент", "w0rd": "wOrd", "b3st": "b3st", "с3т": "сЗт", "a1b": "alb", "1l2l3": "11213", "5S5B5б5": "5558565", "a00b": "a00b", "Hello World": "Hello World"}
    assert column(spark, list(cases), C.fix_digits_and_letters) == list(cases.values())


def test_restore_lines(spark):
    cases = {
        "перенос-\nка слова": "переноска слова", "one,\nTwo\nThree": "one, TwoThree", "head\n\nbody": "head\n\nbody", "a.\nb": "a.\nb", "text\n1. item": "text\n1. item",
        "ALL CAPS\nlower": "ALL CAPS\nlower", "single": "single", "first line of it\nsecond goes on\nThird": "first line of it second goes onThird",
    }
    assert column(spark, [*cases, None], C.restore_line_breaks) == [*cases.values(), None]


def test_chain(spark):
    df = spark.createDataFrame([("Д0кумент  с  ошибkами .", None), ("Слово  два", "TABLE"), ('Он сказал "да" ,нет', None), (None, None)], "text string, kind string")
    rows = C.statistics(df.withColumn("r", C.corrected(F.col("text"), F.col("kind"), F.lit("ru"))), "text", "r").collect()
    assert [r.r.text for r in rows] == ["ДОкумент с ошибkами.", "Слово два", "Он сказал «да», нет", None]
    assert rows[0].statistics.total == 4 and rows[0].statistics.by_processor == {C.OCR: 4}
    assert rows[2].statistics.by_processor == {C.OCR: 1, C.PUNCTUATION: 3}


def test_chain_steps_agree_with_expressions(spark):
    texts = ["a   b ,, c .d", "x   y  \r\n z ", 'q "w" - e: r,t', "Cтол и Pука 5"]
    assert column(spark, texts, X.substitute) == [C.literal_substitutions(t, []) for t in texts]
    assert column(spark, texts, X.normalize_space) == [C.space(t, []) for t in texts]
    assert column(spark, texts, lambda t: X.fix_punctuation(t, True)) == [C.punctuation(t, [], True) for t in texts]
    assert column(spark, texts, X.fix_mixed_alphabets) == [C.mixed_alphabets(t, []) for t in texts]


def test_language(spark):
    texts = ["", "123", "Привет мир", "Hello", "Привет hello", "ñññ", "Приветы ab"]
    assert column(spark, texts, X.language) == ["rus", "rus", "rus", "eng", "rus+eng", "eng", "rus"]
    assert column(spark, texts, X.language_strict) == ["UNKNOWN", "UNKNOWN", "RUS", "ENG", "RUS+ENG", "UNKNOWN", "RUS"]


def test_confidence_and_engines(spark):
    assert [round(x, 4) for x in column(spark, ["", "ab", "abc", "abcde", "a.b.c", "..."], X.confidence)] == [0.0, 0.85, 0.9, 0.95, 0.61, 0.05]
    assert column(spark, ["Привет", "Hello", "123", " "], lambda t: X.accepts_fast_engine(t, F.lit(0.7))) == [True, False, True, False]
    assert column(spark, ["Привет"], lambda t: X.accepts_fast_engine(t, F.lit(0.6))) == [False]


def test_accuracy(spark):
    assert column(spark, ["Привет"], lambda t: F.round(X.char_accuracy(t, F.lit("прювет ")), 4)) == [0.8333]
    assert column(spark, ["", "abc"], lambda t: X.char_accuracy(t, F.lit(""))) == [1.0, 0.0]
    assert column(spark, ["one two two", "cat bat", ""], lambda t: F.round(X.word_accuracy(t, F.lit("two one bat")), 4)) == [0.6667, 0.5, 0.0]


def test_barcodes(spark):
    assert column(spark, ["5901234123457", "96385074", "4600000000003", "5901234123450", "12", "", "x"], B.check_digit_valid) == [True, True, False, False, False, False, False]
    assert column(spark, ["4601", "400", "690", "999", "45", "4x0", "471"], B.country) == ["Россия", "Германия", "Китай", None, None, None, None]
    wifi = column(spark, ["WIFI:S:x;T:nopass;P:;;", "WIFI:T:;S:x;;", "WIFI:S:a;S:b;T:wep;P:q;;", "WIFI:"], B.wifi)
    assert [tuple(w) for w in wifi] == [("x", "", "WPA"), ("x", None, "OPEN"), ("b", "q", "WEP"), ("", None, "WPA")]
    assert [tuple(x) for x in column(spark, ["smsto:+1:hi:there", "sms:5"], B.sms)] == [("+1", "hi:there"), ("5", None)]
    assert [tuple(x) for x in column(spark, ["geo:1.5,2.5", "geo:1.5,2.5?q=a", "geo:x"], B.geo)] == [(1.5, 2.5), (1.5, 0.0), (0.0, 0.0)]
    card = column(spark, ["BEGIN:VCARD\nFN:A B\nTEL;CELL:+1 \nTEL:2\nEMAIL:a@b.co", "MECARD:N:x;;"], B.vcard)
    assert (card[0].name, card[0].phones, card[0].emails) == ("A B", ["+1", "2"], ["a@b.co"]) and card[1].name is None
    kinds = column(spark, ["http://a", "a@b.co", "TEL:1", "sms:1", "MECARD:", "590", "mailto:x"], lambda t: B.parsed(t, F.lit("EAN_8")))
    assert [k.kind for k in kinds] == ["URL", "EMAIL", "PHONE", "SMS", "CONTACT_VCARD", "PRODUCT", "EMAIL"]
    assert kinds[5].product.valid is False and kinds[6].email == "x" and kinds[0].url == "http://a"
    assert column(spark, ["URL", "PRODUCT", "UNKNOWN"], lambda t: B.title(t, F.lit("EAN_8"))) == ["Ссылка", "Товар (EAN-8)", "EAN-8"]
    points = F.array(F.struct(F.lit(1).alias("x"), F.lit(5).alias("y")), F.struct(F.lit(3).alias("x"), F.lit(2).alias("y")))
    assert tuple(column(spark, ["a"], lambda t: B.points_box(points))[0]) == (1, 2, 3, 5)


def test_tree_without_words(spark):
    box = "struct<left:float,top:float,right:float,bottom:float>"
    word = f"struct<text:string,box:{box},confidence:float>"
    schema = f"blocks array<struct<text:string,box:{box},confidence:float,lines:array<struct<text:string,box:{box},confidence:float,words:array<{word}>>>>>"
    b = (0.0, 0.0, 50.0, 20.0)
    trees = [([("Hi you", b, 0.9, [("Hi you", b, 0.9, [("Hi", b, 0.5), ("you", b, 1.0)])]), ("x", b, 0.75, [("x", b, 0.7, [])])],), ([],)]
    rows = spark.createDataFrame(trees, schema).select(L.tree_confidence(F.col("blocks")).alias("c"), L.full_text(F.col("blocks")).alias("t"), L.tree_counts(F.col("blocks")).alias("n")).collect()
    assert [(round(r.c, 6), r.t, tuple(r.n)) for r in rows] == [(0.75, "Hi you\n\nx", (2, 2)), (0.0, "", (0, 0))]


def test_corners_and_crops(spark):
    pts = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(100, 0), (0, 0), (0, 90), (100, 90)]])
    got = column(spark, ["a"], lambda t: G.order_corners(pts))[0]
    assert [(p.x, p.y) for p in got] == [(0, 0), (0, 90), (100, 90), (100, 0)]
    got = column(spark, ["a"], lambda t: G.order_corners(pts, strict=False))[0]
    assert [(p.x, p.y) for p in got] == [(0, 0), (100, 0), (100, 90), (0, 90)]


def test_licence(spark):
    key = F.unhex(F.sha2(F.lit("k"), 256))
    assert column(spark, ["secret", ""], lambda t: K.decrypt(K.encrypt(t, key), key)) == ["secret", ""]
    assert column(spark, ["bm90IGl0"], lambda t: K.decrypt(t, key)) == [""]
    as_of = F.lit("2026-01-01 00:00:00").cast("timestamp")
    assert column(spark, ["2030-12-31", "2020-01-01", "2026-01-01", "x", None], lambda t: K.in_date(t, as_of)) == [True, False, True, False, False]
    assert column(spark, ["{'features': ['scan','redact']}", "[]", "scan", None], K.features) == [["scan", "redact"], [], [], []]


def test_ranking(spark):
    rows = [("a", "c1", "hello", "hello", 100, 1, True), ("a", "c1", "hello", "hellx", 201, 2, True), ("a", "c2", "x", "", 0, 1, False), ("b", "c1", "hello", "hello", 9000, 1, True), ("z", "c1", "hello", "", 5, 1, False)]
    cases = ranking.cases(spark.createDataFrame(rows, "engine string, case_name string, expected string, actual string, run_ms long, run_no long, success boolean"))
    engines = ranking.engines(cases)
    got = {r.engine: (round(r.char_accuracy, 4), r.ms, r.success_rate) for r in engines.collect()}
    assert got == {"a": (0.8, 150, 0.5), "b": (1.0, 9000, 1.0), "z": (0.0, 0, 0.0)}
    assert ranking.best(engines).first().engine == "a"
    assert "a" in ranking.report(engines).where("engine = 'a'").first().line


def test_chain_of_own_steps(spark):
    shout = C.Step("shout", lambda t, log, _: log.append(("Shout", t, t.upper(), 0, 1.0)) or t.upper(), ("RECEIPT",))
    df = spark.createDataFrame([("a  b", None), ("a  b", "RECEIPT"), (None, "TABLE")], "text string, kind string")
    rows = df.select(C.corrected(F.col("text"), F.col("kind"), chain=(*C.CHAIN[2:3], shout)).alias("r")).collect()
    assert [(r.r.text, [c.processor for c in r.r.changes]) for r in rows] == [("A B", [C.SPACE, "Shout"]), ("a b", [C.SPACE]), (None, [])]
    assert C.correct("a  b", chain=()) == ("a  b", [])
