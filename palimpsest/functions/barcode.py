"""Column expressions for barcode payloads: classification, parsing, check digits, origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import coordinates

PRODUCT_FORMATS = ("EAN_13", "EAN_8", "UPC_A", "UPC_E")
# Display names by format.
FORMAT_NAMES = {
    "QR_CODE": "QR Code", "AZTEC": "Aztec", "DATA_MATRIX": "Data Matrix", "PDF_417": "PDF 417", "EAN_13": "EAN-13", "EAN_8": "EAN-8", "UPC_A": "UPC-A", "UPC_E": "UPC-E",
    "CODE_128": "Code 128", "CODE_39": "Code 39", "CODE_93": "Code 93", "CODABAR": "Codabar", "ITF": "ITF (Interleaved 2 of 5)",
}
UNKNOWN_FORMAT = "Неизвестный"
# Titles by content type; a product adds its format.
TITLES = {"URL": "Ссылка", "WIFI": "WiFi сеть", "CONTACT_VCARD": "Контакт", "EMAIL": "Email", "PHONE": "Телефон", "SMS": "SMS", "GEO": "Геолокация", "TEXT": "Текст"}
# First three digits and where they are issued.
COUNTRIES = (
    (460, 469, "Россия"), (400, 440, "Германия"), (300, 379, "Франция"), (690, 695, "Китай"), (0, 19, "США/Канада"), (30, 39, "США/Канада"), (60, 139, "США/Канада"), (500, 509, "Великобритания"),
)
MORE_COUNTRIES = COUNTRIES + (
    (450, 459, "Япония"), (490, 499, "Япония"), (800, 839, "Италия"), (840, 849, "Испания"), (870, 879, "Нидерланды"), (471, 471, "Тайвань"), (880, 880, "Южная Корея"), (885, 885, "Таиланд"), (890, 890, "Индия"),
)
VALUE_TYPES = {"TYPE_URL": "URL", "TYPE_WIFI": "WIFI", "TYPE_CONTACT_INFO": "CONTACT_VCARD", "TYPE_EMAIL": "EMAIL", "TYPE_PHONE": "PHONE", "TYPE_SMS": "SMS", "TYPE_GEO": "GEO", "TYPE_PRODUCT": "PRODUCT", "TYPE_TEXT": "TEXT"}


def chain(of: Column, cases: dict[str, str], default: Column | None = None) -> Column:
    out = F
    for key, value in cases.items():
        out = out.when(of == key, value)
    return out.otherwise(default) if default is not None else out.otherwise(F.lit(None))


def content_type(raw: Column, format: Column) -> Column:
    starts = lambda *heads: F.coalesce(*[F.when(F.startswith(raw, F.lit(h)), True) for h in heads], F.lit(False))
    return (
        F.when(starts("http://", "https://"), "URL").when(starts("WIFI:"), "WIFI").when(starts("BEGIN:VCARD", "MECARD:"), "CONTACT_VCARD")
        .when(starts("mailto:") | raw.rlike(r"^[\w.+-]+@[\w-]+\.[\w.]+$"), "EMAIL").when(starts("tel:", "TEL:"), "PHONE").when(starts("smsto:", "SMSTO:", "sms:"), "SMS")
        .when(starts("geo:"), "GEO").when(format.isin(*PRODUCT_FORMATS), "PRODUCT").otherwise("TEXT")
    )


def content_type_of_value(value_type: Column) -> Column:
    return chain(value_type, VALUE_TYPES, F.lit("UNKNOWN"))


def format_name(format: Column) -> Column:
    return chain(format, FORMAT_NAMES, F.lit(UNKNOWN_FORMAT))


def title(type: Column, format: Column) -> Column:
    return F.when(type == "PRODUCT", F.concat(F.lit("Товар ("), format_name(format), F.lit(")"))).otherwise(chain(type, TITLES, format_name(format)))


def without(raw: Column, *heads: str) -> Column:
    """Remove each of the prefixes in turn, as far as it is there."""
    for h in heads:
        raw = F.when(F.startswith(raw, F.lit(h)), F.substr(raw, F.lit(len(h) + 1))).otherwise(raw)
    return raw


def check_digit_valid(code: Column) -> Column:
    """EAN-8, UPC-A, EAN-13 or GTIN-14 by its digits: weights 3, 1, 3 ... from the right of the payload."""
    digits = F.regexp_replace(code, r"\D", "")
    n = F.char_length(digits)
    reverse = F.split(F.reverse(digits), "")
    total = F.aggregate(F.transform(F.slice(reverse, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda d, i: d.cast("int") * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, b: a + b)
    return F.when(n.isin(8, 12, 13, 14), (10 - total % 10) % 10 == F.get(reverse, F.lit(0)).cast("int")).otherwise(F.lit(False))


def country(code: Column, table=COUNTRIES) -> Column:
    head = F.when(F.char_length(code) >= 3, F.substring(code, 1, 3))
    number = F.when(head.rlike(r"^[+-]?\d+$"), head.cast("int"))
    out = F
    for low, high, name in table:
        out = out.when(number.between(low, high), name)
    return out.otherwise(F.lit(None))


def wifi(raw: Column) -> Column:
    """struct(ssid, password, encryption). The last of a repeated key counts. "nopass" is compared after upper-casing and so never matches: it is WPA."""
    body = without(raw, "WIFI:")
    pairs = F.regexp_extract_all(body, F.lit(r"([TSPH]):([^;]*)"), F.lit(0))
    last = lambda key: F.try_element_at(F.filter(pairs, lambda x: F.startswith(x, F.lit(key + ":"))), F.lit(-1))
    value = lambda key: F.substr(last(key), F.lit(3))
    kind = F.upper(value("T"))
    encryption = F.when(kind.isin("WEP", "WPA", "WPA2"), kind).when(kind == "", "OPEN").otherwise("WPA")
    return F.struct(F.coalesce(value("S"), F.lit("")).alias("ssid"), value("P").alias("password"), encryption.alias("encryption"))


def vcard(raw: Column) -> Column:
    first = lambda p: F.when(raw.rlike(p), F.regexp_extract(raw, p, 1))
    every = lambda p: F.transform(F.regexp_extract_all(raw, F.lit(p), F.lit(1)), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.struct(first(r"FN:(.+)").alias("name"), first(r"ORG:(.+)").alias("organization"), every(r"TEL[^:]*:(.+)").alias("phones"), every(r"EMAIL[^:]*:(.+)").alias("emails"))


def sms(raw: Column) -> Column:
    parts = F.split(without(raw, "smsto:", "SMSTO:", "sms:"), ":", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("number"), F.get(parts, F.lit(1)).alias("message"))


def geo(raw: Column) -> Column:
    parts = F.split(without(raw, "geo:"), ",", -1)
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    return F.struct(number(0).alias("latitude"), number(1).alias("longitude"))


def parsed(raw: Column, format: Column) -> Column:
    """Tagged struct: ``kind`` and one nullable struct or value for each variant."""
    kind = content_type(raw, format)
    when = lambda k, v: F.when(kind == k, v)
    product = F.struct(raw.alias("barcode"), format.alias("format"), check_digit_valid(raw).alias("valid"), country(raw).alias("country"))
    return F.struct(
        kind.alias("kind"), when("URL", raw).alias("url"), when("WIFI", wifi(raw)).alias("wifi"), when("CONTACT_VCARD", vcard(raw)).alias("contact"),
        when("EMAIL", without(raw, "mailto:")).alias("email"), when("PHONE", without(raw, "tel:", "TEL:")).alias("phone"), when("SMS", sms(raw)).alias("sms"),
        when("GEO", geo(raw)).alias("geo"), when("PRODUCT", product).alias("product"), when("TEXT", raw).alias("text"),
    )


def first_engine(preferred: str, one: Column, two: Column) -> Column:
    """Results (arrays) of two decoders: one, two, or the first that is not empty."""
    empty = F.expr("array()")
    if preferred in ("ONE", "TWO"):
        return F.coalesce(one if preferred == "ONE" else two, empty)
    return F.when(F.size(F.coalesce(one, empty)) > 0, one).otherwise(F.coalesce(two, empty))


def points_box(points: Column) -> Column:
    """Least box around the points (array of struct x, y), null for fewer than two."""
    xs, ys = coordinates(points, "x"), coordinates(points, "y")
    box = F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))
    return F.when(F.size(points) >= 2, box)


def allowed(format: Column, formats=()) -> Column:
    """Whether a code's format may be decoded; without formats all may."""
    return format.isin(*formats) if formats else F.lit(True)
