"""Sequential text corrections, and the whole correction chain with its change log.

Digits and letters depend on a left neighbour that may just have been corrected, and merging lines on what was merged
before, so these run in Arrow batches; each row is one text, and nothing is shuffled. The rest of the chain has JVM
expressions in functions.text; the logged chain below does those steps too, as a change's place is needed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.text import SUBSTITUTIONS

# What a digit between letters, and a letter between digits, is taken for.
DIGIT_AMONG_CYRILLIC = {"0": "О", "3": "З"}
DIGIT_AMONG_LATIN = {"0": "O", "1": "l"}
LETTER_AMONG_DIGITS = {**dict.fromkeys("ОоOo", "0"), **dict.fromkeys("Зз", "3"), **dict.fromkeys("Ilі", "1"), **dict.fromkeys("Ss", "5"), "B": "8", "б": "6"}

OCR, LINES, SPACE, PUNCTUATION = "OCR Error Corrector", "Line Break Restorer", "Whitespace Normalizer", "Punctuation Fixer"
TO_CYRILLIC = str.maketrans(P.LOOKALIKE_LATIN, P.LOOKALIKE_CYRILLIC)
TO_LATIN = str.maketrans(P.LOOKALIKE_CYRILLIC, P.LOOKALIKE_LATIN)
BLANK = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

CHANGE = T.StructType([T.StructField(n, T.StringType()) for n in ("processor", "original", "replacement")] + [T.StructField("position", T.IntegerType()), T.StructField("confidence", T.DoubleType())])
CORRECTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("changes", T.ArrayType(CHANGE))])
Change = tuple[str, str, str, int, float]
#: Corrected texts leave Python in pieces of about this many characters, those of the changes included, however many texts came in.
PIECE = 1 << 20

MIXED_WORD = re.compile(r"[^\W_]+")
SOME_LATIN, SOME_CYRILLIC = re.compile("[A-Za-z]"), re.compile("[\u0400-\u052f]")
#: Where digits_and_letters can change something: a character of its tables before a letter or digit.
DOUBTFUL = re.compile(rf"[{''.join(DIGIT_AMONG_CYRILLIC | DIGIT_AMONG_LATIN)}](?=[^\W\d_])|[{''.join(LETTER_AMONG_DIGITS)}](?=\d)")


def _cyrillic(c: str) -> bool:
    return "Ѐ" <= c <= "ԯ"


def _latin(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _digit(c: str) -> bool:
    return unicodedata.category(c) == "Nd"


def _edit(pattern: str, text: str, make, who: str, sure: float, log: list[Change]) -> str:
    def swap(m: re.Match) -> str:
        new = make(m)
        log.append((who, m[0], new, m.start(), sure))
        return new

    return re.sub(pattern, swap, text)


def mixed_alphabets(text: str, log: list[Change]) -> str:
    out, at = [], 0
    for m in MIXED_WORD.finditer(text):
        word = m[0]
        if word.isascii() or not SOME_LATIN.search(word):
            continue
        cyrillic, latin = len(SOME_CYRILLIC.findall(word)), len(SOME_LATIN.findall(word))
        new = word if not cyrillic else word.translate(TO_CYRILLIC if cyrillic >= latin else TO_LATIN)
        if new == word:
            continue
        log.append((OCR, word, new, m.start(), 0.9))
        out += [text[at : m.start()], new]
        at = m.end()
    return "".join([*out, text[at:]])


def digits_and_letters(text: str, log: list[Change]) -> str:
    chars = list(text)
    for m in DOUBTFUL.finditer(text, 1):
        i = m.start()
        c, left, right = chars[i], chars[i - 1], chars[i + 1]
        if _digit(c) and left.isalpha() and right.isalpha():
            near = chars[max(0, i - 3) : i] + chars[i + 1 : i + 4]
            table = DIGIT_AMONG_CYRILLIC if sum(map(_cyrillic, near)) > sum(map(_latin, near)) else DIGIT_AMONG_LATIN
        elif c.isalpha() and _digit(left) and _digit(right):
            table = LETTER_AMONG_DIGITS
        else:
            continue
        if c in table:
            log.append((OCR, c, table[c], i, 0.85))
            chars[i] = table[c]
    return "".join(chars)


def literal_substitutions(text: str, log: list[Change]) -> str:
    for old, new in SUBSTITUTIONS:
        text = _edit(re.escape(old), text, lambda m, new=new: new, OCR, 0.7, log)
    return text


def _item(line: str) -> bool:
    return bool(re.fullmatch(r"\d+[.)>]\s.*|[-–—•*]\s.*|[а-яa-z][.)>]\s.*", line.lstrip(BLANK)))


def _heading(line: str, following: str | None) -> bool:
    x = line.strip(BLANK)
    if len(x) < 60 and x.upper() == x and any(c.isalpha() for c in x):
        return True
    return len(x) < 80 and following is not None and not following.strip(BLANK)


def _goes_on(line: str, following: str) -> bool:
    if not line.strip(BLANK) or not following.strip(BLANK) or line[-1] in ".!?:;" or _item(following):
        return False
    return following[0].islower() or line.endswith(("-", ",", " и", " или", " а", " но"))


def restore_lines(text: str, log: list[Change]) -> str:
    """Lines that were broken in the middle of a sentence are joined in pairs. No newline follows a joined pair, so what comes next stands right behind it."""
    rows = re.split(P.LINE_END, text)
    if len(rows) < 2:
        return text
    out, size, i = [], 0, 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    while i < len(rows):
        line = rows[i].rstrip(BLANK)
        following = rows[i + 1] if i + 1 < len(rows) else None
        i += 1
        if not line:
            put("\n")
        elif _item(line) or _heading(line, following) or following is None or not _goes_on(line, following.lstrip(BLANK)):
            put(line + "\n")
        else:
            tail = following.lstrip(BLANK)
            hyphen = line.endswith("-") and tail[0].islower()
            joined = line[:-1] + tail if hyphen else f"{line} {tail}"
            log.append((LINES, f"{line}\n{tail}", joined, size, 0.9 if hyphen else 0.8))
            put(joined)
            i += 1
    return "".join(out).rstrip(BLANK)


def space(text: str, log: list[Change]) -> str:
    text = re.sub(r"[\u00a0\u2000-\u200b\u202f\u205f\u3000]", " ", text)
    text = _edit(r"(?<=\S) {2,}", text, lambda m: " ", SPACE, 1.0, log)
    return "\n".join(x.rstrip(BLANK) for x in re.split(P.LINE_END, text))


def punctuation(text: str, log: list[Change], russian: bool) -> str:
    text = _edit(r" +([,.;:!?])", text, lambda m: m[1], PUNCTUATION, 0.8, log)
    text = _edit(r"([,;:!?])([^\W_])", text, lambda m: f"{m[1]} {m[2]}", PUNCTUATION, 0.8, log)
    if russian:
        n = iter(range(len(text)))
        text = _edit('"', text, lambda m: "»" if next(n) % 2 else "«", PUNCTUATION, 0.8, log)
    return _edit(r"([^\W\d_]) - ([^\W\d_])", text, lambda m: f"{m[1]} — {m[2]}", PUNCTUATION, 0.7, log)


@dataclass(frozen=True)
class Step:
    """A step of the chain: run(text, log, language) gives the new text and logs what it has changed; not for the kinds left out."""

    name: str
    run: Callable[[str, list[Change], str | None], str]
    left_out: tuple[str, ...] = ()


CHAIN = (
    Step("characters", lambda t, log, _: literal_substitutions(digits_and_letters(mixed_alphabets(t, log), log), log)),
    Step("lines", lambda t, log, _: restore_lines(t, log), ("TABLE", "RECEIPT")),
    Step("space", lambda t, log, _: space(t, log)),
    Step("punctuation", lambda t, log, language: punctuation(t, log, language == "ru")),
)


def correct(text: str, document_type: str | None = None, language: str | None = None, chain: tuple[Step, ...] = CHAIN) -> tuple[str, list[Change]]:
    """The chain, and its changes; those of a step count only if the step changed the text."""
    changes: list[Change] = []
    for step in chain:
        if document_type in step.left_out:
            continue
        log: list[Change] = []
        new = step.run(text, log, language)
        if new != text:
            changes += log
        text = new
    return text, changes


@F.pandas_udf(T.StringType())
def fix_digits_and_letters(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else digits_and_letters(t, []))


@F.pandas_udf(T.StringType())
def restore_line_breaks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else restore_lines(t, []))


def _piece(texts: list[str | None], logs: list[list[Change]]) -> pa.Array:
    """CORRECTED rows, built column by column: no object for each change but its tuple."""
    ends = [0]
    for log in logs:
        ends.append(ends[-1] + len(log))
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64()]
    columns = zip(*(c for log in logs for c in log), strict=True) if ends[-1] else [()] * len(kinds)
    changes = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], CHANGE.names)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), changes)], CORRECTED.names)


def pieces(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]], chain: tuple[Step, ...] = CHAIN) -> Iterator[pa.Array]:
    """Texts, document types and languages to CORRECTED rows, one for each text, a piece at a time."""
    for batch in batches:
        fixed, logs, size = [], [], 0
        for t, k, x in zip(*batch, strict=True):
            new, log = correct(t.as_py(), k.as_py(), x.as_py(), chain) if t.is_valid else (None, [])
            fixed.append(new)
            logs.append(log)
            size += len(new or "") + sum(len(c[1]) + len(c[2]) for c in log)
            if size >= PIECE:
                yield _piece(fixed, logs)
                fixed, logs, size = [], [], 0
        if fixed:
            yield _piece(fixed, logs)


def corrected(text: Column, document_type: Column | None = None, language: Column | None = None, chain: tuple[Step, ...] = CHAIN) -> Column:
    """struct(text, changes) by the steps of the chain, in order; others can be put in or left away."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return pieces(batches, chain)

    none = F.lit(None).cast("string")
    return F.arrow_udf(run, CORRECTED)(text, none if document_type is None else document_type, none if language is None else language)


def statistics(df: DataFrame, text: str, result: str) -> DataFrame:
    """df with ``statistics``: total changes, changes by processor, and lengths before and after."""
    changes = F.col(f"{result}.changes")
    who = F.transform(changes, lambda c: c["processor"])
    counts = F.transform(F.array_distinct(who), lambda p: F.struct(p.alias("k"), F.size(F.filter(who, lambda x: x == p)).alias("v")))
    return df.withColumn(
        "statistics",
        F.struct(F.size(changes).alias("total"), F.map_from_entries(counts).alias("by_processor"), F.char_length(text).alias("length_before"), F.char_length(f"{result}.text").alias("length_after")),
    )
