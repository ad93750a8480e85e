"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Benchmark items are cut into windows of words. A window's shingles are its word pairs (a window of one word has that
word); they are ordered by rarity (times in the benchmark's texts, then longer before shorter, then by text). Containment of
the whole window is asked for, so one shingle, the rarest, is the necessary prefix: a text without it can't hold the
window. Texts are matched with the prefix shingles; where one stands, the window must fit around it within the text
(length and positional bounds), and its words must be equal one by one.

The prefix shingles' hashes are a bitmap of at most 2**MAX_BITS bits in the plan. A text is read once; only the places
whose pair of words passes the bitmap leave the scan, each with the words around it, and meet the prefix shingles by a
join on the hash. Passing the bitmap, and equal hashes, decide nothing: the words do.

Cases: null texts and items have no words; an item without words has no window. Equal items share windows and are each
counted. An item with a null id hits as any other and counts as one item, without a name in the list. Rows that repeat
an id, or have none, are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store, fresh

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The bitmap takes 512 KB at most; it has 64 bits a shingle up to 2**MAX_BITS / 64 of them, then lets more through.
MAX_BITS = 22


def lower_ascii(text: Column) -> Column:
    """A-Z only; the library's lower() does just that for texts that are all ASCII, and much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def neighbours(words: Column, of) -> Column:
    """of(a, b) of each pair of neighbours, in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), of)


def shingles_of(words: Column) -> Column:
    """Pairs of neighbours, in order, joined by a space."""
    return neighbours(words, lambda a, b: F.concat(a, F.lit(" "), b))


def key_of(shingle: Column) -> Column:
    """The hash of a shingle: of its two words, or of its one."""
    parts = F.split(shingle, " ")
    return F.when(F.size(parts) == 2, F.xxhash64(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.xxhash64(shingle))


def windows_of(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item, window, length): the distinct windows of each item, as arrays of words."""
    words = items.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    return words.select("item", "words", F.explode(starts).alias("start")).select("item", F.slice("words", F.col("start"), F.lit(size)).alias("window")).distinct()


def prefixes_of(windows: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """(key, single, place, window): the rarest shingle of each distinct window, and where in the window it first stands."""

    def shingles(words: Column) -> Column:
        return F.when(F.size(words) == 1, words).otherwise(shingles_of(words))

    each = windows.select("window").distinct().select("window", F.posexplode(shingles(F.col("window"))).alias("at", "shingle"))
    # Counted in whole items: by windows, a pair at an item's end would seem rarer than one in its middle.
    times = items.select(words_of(F.col(text)).alias("words")).select(F.explode(shingles(F.col("words"))).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("times"))
    order = F.struct("times", -F.char_length("shingle"), "shingle", "at")
    best = each.join(times, "shingle").groupBy("window").agg(F.min(order).alias("best"))
    return best.select(key_of(F.col("best.shingle")).alias("key"), (F.size("window") == 1).alias("single"), (F.col("best.at") + 1).alias("place"), "window")


def bitmap(keys: DataFrame, max_bits: int):
    """A test of longs: true for each key, and for few others. The bitmap is one literal of at most 2**max_bits bits."""
    bits = max(6, min(max_bits, (64 * max(1, keys.count())).bit_length()))
    bucket = lambda k: k.bitwiseAND(F.lit((1 << bits) - 1))
    bit = lambda k: bucket(k).bitwiseAND(F.lit(63)).cast("int")
    word = lambda k: F.shiftright(bucket(k), 6).cast("int")
    set_ = keys.select(word(F.col("key")).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("key"))).alias("bit"))
    held = [0] * (1 << (bits - 6))
    for r in set_.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most 2**(max_bits - 6)
        held[r.word] = r.bits
    # A string that is split and cast is folded into one literal array, whatever its length.
    table = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")
    return lambda k: F.call_function("shiftright", F.get(table, word(k)), bit(k)).bitwiseAND(F.lit(1)) == 1


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13, percent: int = 5) -> DataFrame:
    """One row per row of docs: id, text_hash, n_words, n_hit, n_items, items (ids of items, sorted as strings), contaminated."""
    store = Store(docs.sparkSession, "decontaminate")
    windows = store.write(windows_of(items, item_id, item_text, size), "windows")
    prefixes = store.write(prefixes_of(windows, items, item_text), "prefixes")
    none = F.expr("cast(array() as array<struct<at:int,key:bigint>>)")
    read = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), words_of(F.col(text)).alias("words"))
    places = []
    for single, of in ((False, "pairs"), (True, "ones")):
        keys = prefixes.where(F.col("single") == single).select("key").distinct()
        if single and keys.isEmpty():  # most benchmarks have no item of one word
            continue
        passes = bitmap(keys, MAX_BITS)
        read = read.select("*", (F.transform("words", lambda w: F.xxhash64(w)) if single else neighbours(F.col("words"), lambda a, b: F.xxhash64(a, b))).alias(of))
        read = read.select("*", F.exists(of, passes).alias(f"any_{of}"))
        placed = F.filter(F.transform(of, lambda k, i: F.struct(i.alias("at"), k.alias("key"))), lambda x: passes(x["key"]))
        places.append(F.when(F.col(f"any_{of}"), placed).otherwise(none))
    spots = read.select(F.monotonically_increasing_id().alias("row"), "id", "text_hash", F.size("words").cast("long").alias("n_words"), "words", F.concat(*places).alias("spots"))
    spots = spots.select("row", "id", "text_hash", "n_words", "words", F.posexplode_outer("spots").alias("nth", "spot"))
    # Of the words around a place (0-based), a window that holds it needs at most size - 1 to either side.
    low = F.greatest(F.col("spot.at") - F.lit(size - 1), F.lit(0))
    around = F.when(F.col("spot").isNotNull(), F.slice(F.col("words"), low + 1, F.lit(2 * size)))
    spots = spots.select("row", "id", "text_hash", "n_words", "nth", F.col("spot.at").alias("at"), F.col("spot.key").alias("key"), low.alias("low"), around.alias("around"))
    spots = store.write(spots, "spots")
    base = spots.where("nth is null or nth = 0")

    found = spots.where("key is not null").select("row", "at", "key", "low", "around").join(prefixes, "key")
    start, length = F.col("at") - F.col("place") + 1, F.size("window")
    offset = start - F.col("low")
    fits = found.where(offset >= 0).where(F.slice("around", offset + 1, length) == F.col("window"))
    hits = store.write(fits.select("row", start.alias("start"), length.alias("length"), "window").distinct(), "hits")

    covered = hits.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("word")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    held = hits.select("row", "window").distinct().join(windows, "window").select("row", F.col("item").cast("string").alias("item")).distinct()
    held = held.groupBy("row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    out = base.select("row", "id", "text_hash", "n_words").join(covered, "row", "left").join(held, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("id").alias(id), "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """docs without the contaminated ones, columns as they are."""
    bad_id, bad_hash = fresh(docs, "bad_id", "bad_hash")
    bad = contamination(docs, items, id, text, **more).where("contaminated").select(F.col(id).alias(bad_id), F.col("text_hash").alias(bad_hash))
    return docs.join(bad.distinct(), (F.xxhash64(docs[text]) == F.col(bad_hash)) & docs[id].eqNullSafe(F.col(bad_id)), "left_anti")
