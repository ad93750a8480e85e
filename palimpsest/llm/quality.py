"""Quality rules: base measures of a text, and how far its distributions are from those of its language.

measure(docs) adds one struct column (``quality`` by default) with the measures; judge(docs) adds it with the verdict.

References are pooled counts over every document of a language that passes the base rules: character classes, and
common words against all other words. A document's distance is the least Jensen-Shannon distance (base 2, 0 to 1) to
any language's reference, as texts may be mislabelled. It is taken only above a least length, and the limit for words
falls with the length (word_limit + word_slack / sqrt(words)), since short texts scatter. Languages outside
Rules.languages, and null, share the one reference "other": there are a fixed few references of fixed size, which are
collected and given to the tasks.

Cases: a null text counts as empty (no words, so base_failed). A group without any passing document has no reference;
with no reference at all, documents are judged by the base rules alone. A text without a plain word (digits only, say)
has no distances. Repeated rows are measured one by one and all count. Other columns pass through whatever their names;
a column of the result's name is refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .store import refuse

# Frequent function words of the languages with a reference of their own.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to a in that is was for it with as on be by this are from or",
    "es": "de la que el en y a los se del las un por con una para es al lo como",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus avec",
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "other")
STOPS = b".,;:!?'\"()-"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    languages: tuple[str, ...] = tuple(COMMON_WORDS)
    #: Least lengths for the two distances, in characters and words.
    min_chars: int = 250
    min_plain_words: int = 60
    max_char_distance: float = 0.3
    word_limit: float = 0.12
    word_slack: float = 2.6


STRUCT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.ArrayType(T.LongType(), False)) for n in ("char_counts", "word_counts")]
)
ARROW = pa.struct(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [(n, pa.list_(pa.int64())) for n in ("char_counts", "word_counts")]
)
JUDGED = T.StructType(
    [*STRUCT.fields, T.StructField("base_failed", T.BooleanType()), T.StructField("char_distance", T.DoubleType())]
    + [T.StructField("word_distance", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of a code point by its first byte; continuation bytes have the class after the last."""
    table = np.full(256, CLASSES.index("symbol"), np.uint8)
    for c in range(256):
        if c >= 0x80:
            table[c] = len(CLASSES) if c < 0xC0 else CLASSES.index("other")
        elif chr(c).isalpha():
            table[c] = CLASSES.index("lower" if chr(c).islower() else "upper")
        elif chr(c).isdigit():
            table[c] = CLASSES.index("digit")
        elif c in vec.SPACES:
            table[c] = CLASSES.index("blank")
        elif c in STOPS:
            table[c] = CLASSES.index("stop")
    return table


@lru_cache(1)
def vocabulary_hashes() -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in VOCABULARY]
    ends = np.cumsum([len(w) for w in raw])
    h = vec.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
    order = np.argsort(h)
    return h[order], order


def repeated_lines(body: bytes) -> int:
    seen: set[bytes] = set()
    count = 0
    for line in body.split(b"\n"):
        if line in seen:
            count += 1
        elif line.strip():
            seen.add(line)
    return count


def measure_piece(data: np.ndarray, offsets: np.ndarray, lines: bool = True) -> dict[str, np.ndarray | list]:
    """The measures of each text; without lines, n_dup_lines is 0 (the references don't need it)."""
    n = len(offsets) - 1

    def per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[at])

    text_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.bincount(text_of_byte * 8 + class_table()[data], minlength=8 * n).reshape(n, 8)[:, : len(CLASSES)]
    del text_of_byte

    words = vec.Words(data, offsets, vec.WHITE)
    texts = words.text_of
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        inside = np.flatnonzero(texts[:-2] == texts[2:])
        triples = vec.windows(words.hashes(), 3)[inside]
        triples = vec.mix(triples + texts[inside].astype(np.uint64) * np.uint64(vec.BASE))
        _, which, times = np.unique(triples, return_inverse=True, return_counts=True)
        again = inside[times[which] > 1]
        for k in range(3):
            covered[again + k] = True

    plain = vec.Words(data, offsets, vec.NOT_ASCII_LETTER, vec.ASCII_LOWER)
    known, order = vocabulary_hashes()
    hashes = plain.hashes()
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    kind = np.where(known[at] == hashes, order[at], len(known))
    k = len(known) + 1
    common = np.bincount(plain.text_of * k + kind, minlength=n * k).reshape(n, k)

    raw = data.tobytes()
    return {
        "n_words": words.counts,
        "word_chars": classes.sum(1) - classes[:, CLASSES.index("blank")],
        "n_symbols": per_text(vec.lut(SYMBOLS)[data], offsets),
        "n_dup_lines": [repeated_lines(raw[a:b]) if lines else 0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)],
        "n_repeat_words": per_text(covered, words.first),
        "char_counts": classes.astype(np.int64),
        "word_counts": common.astype(np.int64),
    }


def _lists(counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * counts.shape[1], pa.int32()), pa.array(counts.ravel()))


def _struct(found: dict, kind: pa.StructType) -> pa.StructArray:
    return pa.StructArray.from_arrays([_lists(found[f.name]) if f.name.endswith("_counts") else pa.array(found[f.name], f.type) for f in kind], fields=list(kind))


def measure(docs: DataFrame, text: str = "text", column: str = "quality") -> DataFrame:
    return _with_struct(docs, text, column, STRUCT, ARROW, lambda found: found)


def _with_struct(docs: DataFrame, text: str, column: str, kind: T.StructType, arrow: pa.StructType, finish) -> DataFrame:
    refuse(docs, column)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for row, data, offsets in vec.pieces(batch.column(at)):
                part = batch.slice(row, len(offsets) - 1)
                out = _struct(finish(measure_piece(data, offsets)), arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, column])

    return docs.mapInArrow(vec.tidy(run), T.StructType([*docs.schema.fields, T.StructField(column, kind)]))


def base_failed(q: dict, rules: Rules) -> np.ndarray:
    return (q["n_words"] < rules.min_words) | (100 * q["n_repeat_words"] > rules.max_repeat_percent * q["n_words"])


def references(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> list:
    """A row (ref_group, ref_chars, ref_words) for each language group: pooled counts of its documents that pass the base rules.

    A task adds up its documents and gives one row for each group; there are len(Rules.languages) + 1 groups.
    """
    groups = [*rules.languages, "other"]

    def run(batches):
        chars = np.zeros((len(groups), len(CLASSES)), np.int64)
        words = np.zeros((len(groups), len(VOCABULARY) + 1), np.int64)
        for batch in batches:
            for row, data, offsets in vec.pieces(batch.column(1)):
                n = len(offsets) - 1
                q = measure_piece(data, offsets, lines=False)
                of = np.array([groups.index(x) if x in rules.languages else len(groups) - 1 for x in batch.column(0).slice(row, n).to_pylist()])
                fine = ~base_failed(q, rules)
                np.add.at(chars, of[fine], q["char_counts"][fine])
                np.add.at(words, of[fine], q["word_counts"][fine])
        some = np.flatnonzero(chars.any(1))
        yield pa.RecordBatch.from_arrays([pa.array([groups[k] for k in some], pa.string()), _lists(chars[some]), _lists(words[some])], ["ref_group", "chars", "words"])

    def pooled(field: str, size: int) -> Column:
        return F.array(*[F.sum(F.col(field)[i]) for i in range(size)])

    rows = docs.select(F.col(lang).cast("string"), text).mapInArrow(vec.tidy(run), "ref_group string, chars array<long>, words array<long>")
    return rows.groupBy("ref_group").agg(pooled("chars", len(CLASSES)).alias("ref_chars"), pooled("words", len(VOCABULARY) + 1).alias("ref_words")).collect()


def nearest(counts: np.ndarray, references_: list[list[int]]) -> np.ndarray:
    """Least Jensen-Shannon distance (base 2) of each row of counts to a reference; NaN for an all-zero row or without references."""
    out = np.full(len(counts), np.nan)
    total = counts.sum(1)
    rows = np.flatnonzero(total > 0)
    p = counts[rows] / total[rows, None]
    for reference in references_:
        if not sum(reference):
            continue
        q = np.array(reference, float) / sum(reference)
        both = p + q
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(p > 0, p * np.log2(2 * p / both), 0.0) + np.where(q > 0, q * np.log2(2 * q / both), 0.0)
        distance = np.sqrt(np.maximum(0.0, terms.sum(1) / 2))
        out[rows] = np.fmin(out[rows], distance)
    return out


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", column: str = "quality", rules: Rules = Rules()) -> DataFrame:
    """docs with ``column``: the measures, base_failed, char_distance, word_distance (null where not taken) and kept.

    The texts are read twice, once for the references and once to be judged; nothing but the references is moved.
    """
    refuse(docs, column)
    refs = references(docs, text, lang, rules)  # a row for each language group
    by_chars, by_words = [list(r.ref_chars) for r in refs], [list(r.ref_words) for r in refs]

    def finish(q: dict) -> dict:
        failed = base_failed(q, rules)
        chars, plain = q["char_counts"].sum(1), q["word_counts"].sum(1)
        char = np.where(~failed & (chars >= rules.min_chars), nearest(q["char_counts"], by_chars), np.nan)
        word = np.where(~failed & (plain >= rules.min_plain_words), nearest(q["word_counts"], by_words), np.nan)
        limit = rules.word_limit + rules.word_slack / np.sqrt(np.maximum(plain, 1))
        far = (char > rules.max_char_distance) | (word > limit)  # a comparison with NaN is false
        given = lambda x: pa.array(x, pa.float64(), mask=np.isnan(x))
        return q | {"base_failed": failed, "char_distance": given(char), "word_distance": given(word), "kept": ~failed & ~far}

    return _with_struct(docs, text, column, JUDGED, pa.struct([*ARROW, ("base_failed", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64()), ("kept", pa.bool_())]), finish)
