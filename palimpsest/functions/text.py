"""Column expressions for cleaning, correcting and classifying recognised text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def trim(text: Column) -> Column:
    """Strip Unicode white space; the library's trim() only knows U+0020."""
    return F.regexp_replace(text, P.TRIM, "")


def lines(text: Column) -> Column:
    return F.split(text, P.LINE_END, -1)


def is_blank(text: Column) -> Column:
    return trim(text) == ""


# --- clean-up: URLs, spaces, line breaks, digits ------------------------------------------------------------------

URL = r"(?i)https?\s*:\s*//\s*[a-zA-Z0-9\s._\-/]+"


def fix_urls(text: Column) -> Column:
    """Delete all white space inside a URL match. The match runs on over following ASCII words, and so does the deletion."""
    gaps, found = F.split(text, URL, -1), F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.regexp_replace(m, r"\s+", ""), F.lit("")))), "")


def fix_spaces(text: Column) -> Column:
    text = F.regexp_replace(text, " {2,}", " ")
    text = F.regexp_replace(text, r" +([.,;:!?)])", "$1")
    return F.regexp_replace(text, r"(\() +", "$1")


def fix_line_breaks(text: Column) -> Column:
    """Unix line ends, at most one empty line; lines are trimmed after that, so blank lines with spaces do not collapse."""
    text = F.regexp_replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n{3,}", "\n\n")
    return F.array_join(F.transform(F.split(text, "\n", -1), trim), "\n")


def fix_digits(text: Column) -> Column:
    """l and O between digits, left to right, each match consuming both digits: 1l2l3 becomes 112l3."""
    return F.regexp_replace(F.regexp_replace(text, r"(\d)l(\d)", r"$1\1$2"), r"(\d)O(\d)", r"$1\0$2")


def fix_digits_everywhere(text: Column) -> Column:
    """The same without consuming: 1l2l3 becomes 11213."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<=\d)l(?=\d)", "1"), r"(?<=\d)O(?=\d)", "0")


def clean(text: Column) -> Column:
    return F.when(is_blank(text), F.lit("")).otherwise(trim(fix_digits(fix_line_breaks(fix_spaces(fix_urls(text))))))


# --- correction -------------------------------------------------------------------------------------------------

TOKEN = r"[\p{L}\d]+|[^\p{L}\d]+"


def fix_mixed_word(word: Column) -> Column:
    """A word of both alphabets gets the look-alikes of the one with more letters; Cyrillic wins ties."""
    cyrillic, latin = F.regexp_count(word, F.lit(P.CYRILLIC_WIDE)), F.regexp_count(word, F.lit(P.LATIN))
    return (
        F.when((cyrillic == 0) | (latin == 0), word)
        .when(cyrillic >= latin, F.translate(word, P.LOOKALIKE_LATIN, P.LOOKALIKE_CYRILLIC))
        .otherwise(F.translate(word, P.LOOKALIKE_CYRILLIC, P.LOOKALIKE_LATIN))
    )


def fix_mixed_alphabets(text: Column) -> Column:
    """Only texts with letters of both alphabets are taken apart."""
    fixed = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), fix_mixed_word), "")
    return F.when(text.rlike(P.CYRILLIC_WIDE) & text.rlike(P.LATIN), fixed).otherwise(text)


# Literal substitutions, in order; each is one pass, so three spaces become two.
SUBSTITUTIONS = (("  ", " "), (" ,", ","), (" .", "."), (",,", ","))


def substitute(text: Column) -> Column:
    for old, new in SUBSTITUTIONS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalize_space(text: Column) -> Column:
    text = F.regexp_replace(text, r"[\x{00A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}]", " ")
    text = F.regexp_replace(text, r"(?<=\S) {2,}", " ")
    return F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(x, P.TRIM_END, "")), "\n")


def pair_quotes(text: Column) -> Column:
    """The n-th straight quote opens if n is odd and closes if even, over the whole text."""
    parts = F.split(text, '"', -1)
    quoted = F.transform(parts, lambda part, i: F.concat(F.when(i == 0, F.lit("")).when(i % 2 == 1, F.lit("«")).otherwise(F.lit("»")), part))
    return F.array_join(quoted, "")


def fix_punctuation(text: Column, russian: Column | bool = False) -> Column:
    text = F.regexp_replace(text, r" +([,\.;:!?])", "$1")
    text = F.regexp_replace(text, r"([,;:!?])([\p{L}\d])", "$1 $2")
    russian = russian if isinstance(russian, Column) else F.lit(russian)
    text = F.when(russian, pair_quotes(text)).otherwise(text)
    return F.regexp_replace(text, r"(\p{L}) - (\p{L})", "$1 — $2")


LIST_ITEM = r"^(\d+[.)>]\s.*|[-–—•*]\s.*|[а-яa-z][.)>]\s.*)$"


def is_list_item(line: Column) -> Column:
    return F.regexp_replace(line, P.TRIM_START, "").rlike(LIST_ITEM)


def is_heading(line: Column, following: Column) -> Column:
    """A short upper-case line, or one before a blank line; ``following`` is null at the end."""
    x = trim(line)
    shouting = (F.char_length(x) < 60) & (F.upper(x) == x) & x.rlike(r"\p{L}")
    return shouting | ((F.char_length(x) < 80) & F.coalesce(is_blank(following), F.lit(False)))


def merges(line: Column, following: Column) -> Column:
    """Whether a line goes on in the following one (both as they are tested: end and start trimmed)."""
    stays = is_blank(line) | is_blank(following) | line.rlike(r"[.!?:;]$") | following.rlike(r"^(  |\t)") | is_list_item(following)
    return ~stays & (following.rlike(r"^\p{Ll}") | line.rlike(r"(-|,| и| или| а| но)$"))


def preview(text: Column, size: int = 50) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.concat(F.left(text, F.lit(size)), F.when(F.char_length(text) > size, "…").otherwise(""))


# --- language and confidence ------------------------------------------------------------------------------------


def _by_shares(text: Column, decide) -> Column:
    """decide(letters, Cyrillic share, Latin share); each count reads the text once, whatever the branches ask."""
    letters, cyrillic, latin = (F.regexp_count(text, F.lit(p)) for p in (r"\p{L}", P.CYRILLIC_BLOCK, P.LATIN))
    counts = F.array(F.struct(letters.alias("letters"), cyrillic.alias("cyrillic"), latin.alias("latin")))

    def decided(c: Column) -> Column:
        of = F.nullif(c["letters"], F.lit(0))
        return decide(c["letters"], c["cyrillic"] / of, c["latin"] / of)

    return F.get(F.transform(counts, decided), F.lit(0))


def language(text: Column) -> Column:
    """rus, eng or rus+eng by shares of letters; rus where there is no letter."""
    return _by_shares(text, lambda letters, cyrillic, latin: (
        F.when(letters == 0, "rus").when(cyrillic > 0.7, "rus").when(latin > 0.7, "eng")
        .when((cyrillic > 0.2) & (latin > 0.2), "rus+eng").when(cyrillic > latin, "rus").otherwise("eng")
    ))


def language_strict(text: Column) -> Column:
    return _by_shares(text, lambda letters, cyrillic, latin: (
        F.when(letters == 0, "UNKNOWN").when(cyrillic > 0.6, "RUS").when(latin > 0.6, "ENG")
        .when((cyrillic > 0.15) & (latin > 0.15), "RUS+ENG").when(cyrillic > latin, "RUS").when(latin > cyrillic, "ENG").otherwise("UNKNOWN")
    ))


def language_name(code: Column) -> Column:
    return F.when(code == "RUS", "Русский").when(code == "ENG", "English").when(code == "RUS+ENG", "Русский + English").otherwise("Unknown")


def confidence(text: Column, handwritten: bool = False) -> Column:
    """Heuristic confidence of a word without one: share of letters and digits, and a bonus for length."""
    size = F.char_length(text)
    bonus = F.when(size >= 5, 0.1).when(size >= 3, 0.05).otherwise(0.0)
    value = 0.85 * F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}]")) / size + bonus
    value = F.when(is_blank(text), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))
    return value * 0.7 if handwritten else value


def accepts_fast_engine(text: Column, average: Column) -> Column:
    """The fast engine's text is kept if it is there, confident, and Cyrillic enough or almost without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    share = F.coalesce(F.regexp_count(text, F.lit(P.CYRILLIC_ALPHABET)) / F.nullif(letters, F.lit(0)), F.lit(0.0))
    return F.coalesce(~is_blank(text) & (average > 0.6) & ((share > 0.2) | (letters < 5)), F.lit(False))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+", -1), lambda w: ~is_blank(w)))


# --- similarity -------------------------------------------------------------------------------------------------


def char_accuracy(expected: Column, actual: Column) -> Column:
    e, a = trim(F.lower(expected)), trim(F.lower(actual))
    longest = F.greatest(F.char_length(e), F.char_length(a))
    return F.when(e == "", F.when(a == "", 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(e, a) / longest))


def word_accuracy(expected: Column, actual: Column) -> Column:
    """Share of expected words that find a partner within one edit. Greedy and in order: each takes the first that is left."""
    split = lambda x: F.filter(F.split(F.lower(x), r"\s+", -1), lambda w: ~is_blank(w))
    e, a = split(expected), split(actual)

    def step(state: Column, word: Column) -> Column:
        near = F.transform(state["left"], lambda w: F.levenshtein(w, word) <= 1)
        at = F.coalesce(F.array_position(near, True), F.lit(0)).cast("int")
        left = F.when(at > 0, F.filter(state["left"], lambda w, i: i != at - 1)).otherwise(state["left"])
        return F.struct(left.alias("left"), (state["matched"] + F.when(at > 0, 1).otherwise(0)).alias("matched"))

    matched = F.aggregate(e, F.struct(a.alias("left"), F.lit(0).alias("matched")), step, lambda s: s["matched"])
    return F.when(F.size(e) == 0, F.when(F.size(a) == 0, 1.0).otherwise(0.0)).otherwise(matched / F.size(e))
