"""MinHash near-duplicates with HyperMinHash sketches.

A document's set is its distinct word shingles. One hash of each shingle names a bucket and, by its other bits, a
value; a bucket keeps only the leading-zero count and the next MANTISSA bits of its least value (16 bits in all).
Empty buckets borrow a value from others by a fixed pseudo-random order before banding. Documents that agree on all
registers of a band are candidates. The candidates' Jaccard similarity is estimated from the registers, less the
share of equal registers that chance alone gives, and what may reach the threshold is verified on the full sets.

Documents with equal sets are one class (an entry, named by the hash of its set). Entries of a band bucket are grouped
under the bucket's least entry, its leader; buckets with the same leader are one group, so a member of many buckets of
a family stands in few groups. Members are compared with a leader (linear in the group's size) and linked parts become one
component. Only groups that still hold several components are looked at again, in tiles of bounded size: members
outside the group's largest component are counted against the tile's members through an index of all their shingles,
which gives the exact similarity of every pair at once and so needs no estimate. A tile returns one link for each two
components that it joins, not the pairs. So every pair that shares a band and could join two components is tested
exactly, and what a group of copies makes is linear in its size. Groups with over a thousandth of all members (at most a
thousand groups) are joined with what is known of them by broadcast, the others by shuffle.

Cases: null or empty texts have the empty set and are linked with nothing. A null id can't be linked: its row is
returned with a null component and kept. Rows that repeat an id are one vertex, whatever their texts: what is linked
with any of them is linked with all. Each row is returned.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .components import components
from .store import Store
from .substring import joined_by

BUCKETS, MANTISSA, EMPTY = 512, 10, 0xFFFF
#: A pair at 80 % shares a band with probability 1 - (1 - 0.8**8)**64, all but 8 in a million; one at 40 % with 4 in 100.
ROWS, BANDS = 8, 64
TRIES = 64
#: An estimate this far below the threshold still goes to verification: over four standard errors of 512 registers, and
#: more of a small set's, whose registers hold nearly all of it.
MARGIN = 0.08
#: Shingles on either side of a tile, about.
TILE = 1 << 20


def shingle_hashes(words: vec.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle; a text of fewer words has one, of all its words."""
    h, texts = words.hashes(), words.text_of
    n = max(0, len(h) - size + 1)
    inside = np.flatnonzero(texts[:n] == texts[size - 1 : size - 1 + n])
    whole = np.flatnonzero((words.counts > 0) & (words.counts < size))
    rest = vec.range_hashes(h, words.first[whole], words.counts[whole])
    return np.concatenate([texts[inside], whole]), np.concatenate([vec.windows(h, size)[inside], vec.mix(rest)])


def registers(sorted_hashes: np.ndarray) -> np.ndarray:
    out = np.full(BUCKETS, EMPTY, np.uint16)
    bucket = (sorted_hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    value = ((sorted_hashes[first] >> np.uint64(3)) & np.uint64((1 << 52) - 1)).astype(np.float64)
    fraction, length = np.frexp(value)
    mantissa = np.where(value > 0, (2 * fraction - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out[bucket[first]] = ((52 - length) << MANTISSA) + mantissa
    return out


@lru_cache(1)
def lenders() -> np.ndarray:
    """lenders[k, j]: the bucket that an empty bucket j asks in its try k."""
    x = vec.mix(np.arange(TRIES * BUCKETS, dtype=np.uint64) + np.uint64(0xA5A5))
    return (x % np.uint64(BUCKETS)).astype(np.int64).reshape(TRIES, BUCKETS)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers (rows of BUCKETS) with the empty ones borrowed; rows must have a value."""
    out = regs.copy()
    for ask in lenders():
        gaps = out == EMPTY
        if not gaps.any():
            return out
        out = np.where(gaps, regs[:, ask], out)
    twice = np.concatenate([out, out], 1)
    at = np.where(twice != EMPTY, np.arange(2 * BUCKETS), 2 * BUCKETS)
    following = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :BUCKETS]
    return np.take_along_axis(twice, np.minimum(following, 2 * BUCKETS - 1), 1)


def band_keys(full: np.ndarray) -> np.ndarray:
    """Keys of the bands of filled registers."""
    r = full[:, : ROWS * BANDS].astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(vec.BASE)
    for k in range(ROWS):
        key = vec.mix(key + r[:, :, k])
    return key


@lru_cache(4096)
def chance(a: int, b: int) -> float:
    """Share of equal registers of two disjoint sets, of the buckets that either fills; sizes as powers of 2**0.5."""
    edges = [0.0]
    for zeros in range(40, -1, -1):
        edges += list(2.0 ** -(zeros + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)))
    lows = np.array([*edges, 1.0])
    na, nb = 2 ** (a / 2) / BUCKETS, 2 ** (b / 2) / BUCKETS
    pa_, pb = -np.diff(np.exp(-na * lows)), -np.diff(np.exp(-nb * lows))
    return float((pa_ * pb).sum() / (1 - np.exp(-na - nb)))


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, corrected for collisions."""
    empty = (x == EMPTY) & (y == EMPTY)
    share = ((x == y) & ~empty).sum(1) / np.maximum(1, BUCKETS - empty.sum(1))
    size = lambda n: np.round(2 * np.log2(np.maximum(1, n))).astype(int)
    by_chance = np.array([chance(int(a), int(b)) for a, b in zip(size(nx), size(ny), strict=True)])
    return (share - by_chance) / (1 - by_chance)


SKETCH = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("entry", T.LongType())]
    + [T.StructField("registers", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False))]
)


def piece_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts, hashes = shingle_hashes(vec.Words(data, offsets, vec.WHITE, vec.ASCII_LOWER), size)
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    new = np.ones(len(texts), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])
    texts, hashes = texts[new], hashes[new]
    cuts = np.searchsorted(texts, np.arange(len(offsets)))
    return [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """docs (id, hash, text) -> id, hash, n_shingles, entry, registers, bands (the last three null for empty sets)."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in vec.pieces(batch.column(2)):
                sets = piece_sets(data, offsets, size)
                n = len(sets)
                regs = np.stack([registers(s) for s in sets])
                count = np.array([len(s) for s in sets])
                some = count > 0
                keys = np.zeros((n, BANDS), np.int64)
                if some.any():
                    keys[some] = band_keys(filled(regs[some])).view(np.int64)
                entry = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n).cast(pa.int64()),
                        batch.column(1).slice(row, n),
                        pa.array(count, pa.int64()),
                        pa.array(entry, mask=~some),
                        pa.array([r.tobytes() if k else None for r, k in zip(regs, some, strict=True)], pa.binary()),
                        pa.array([k if s else None for k, s in zip(keys, some, strict=True)], pa.list_(pa.int64())),
                    ],
                    [f.name for f in SKETCH.fields],
                )

    return docs.mapInArrow(vec.tidy(run), SKETCH)


def shingle_set(text: str, size: int) -> set:
    words = text.encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


PAIR = "a long, b long"


def _promising(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimate may reach the threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (2, 3))
                fine = estimate(x, y, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(fine))

    side = lambda k: sketches.select(F.col("entry").alias(k), F.col("registers").alias(f"r_{k}"), F.col("n_shingles").alias(f"n_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(vec.tidy(run), PAIR)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    def run(batches):
        held: dict[int, set] = {}

        def of(key: int, text: str) -> set:
            if key not in held:
                if sum(map(len, held.values())) >= 1 << 16:
                    held.clear()
                held[key] = shingle_set(text, size)
            return held[key]

        for batch in batches:
            fine = []
            for i in range(batch.num_rows):
                a, b, text_a, text_b = (batch.column(k)[i].as_py() for k in range(4))
                x, y = of(a, text_a), shingle_set(text_b, size)
                both = len(x & y)
                fine.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(fine, pa.bool_()))

    side = lambda k: texts.select(F.col("entry").alias(k), F.col("text").alias(f"t_{k}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b").mapInArrow(vec.tidy(run), PAIR)


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """texts (entry, text) -> (entry, shingles): the sorted hashes of the full set."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in vec.pieces(batch.column(1)):
                sets = piece_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array([x.tobytes() for x in sets], pa.binary())], ["entry", "shingles"])

    return texts.select("entry", "text").mapInArrow(vec.tidy(run), "entry long, shingles binary")


def tile_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of rows (probe, entry, component, shingles): probes against all others."""
    targets = [r for r in rows if not r[0]]
    probes = [r for r in rows if r[0]]
    if not targets or not probes:
        return []
    sets = [np.frombuffer(r[3], np.uint64) for r in targets]
    sizes = np.array([len(x) for x in sets])
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    part = np.array([r[2] for r in targets])
    now: dict[int, int] = {}  # a component of a probe that has become part of another

    def root(x: int) -> int:
        while x in now:
            x = now[x]
        return x

    links = []
    for _, entry, component, shingles in probes:
        mine = root(component)
        if (part == mine).all():
            continue
        own = np.frombuffer(shingles, np.uint64)
        lo, hi = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
        count = hi - lo
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(sizes))
        near = np.flatnonzero((100 * both >= percent * (len(own) + sizes - both)) & (part != mine))
        for other, first in zip(*np.unique(part[near], return_index=True), strict=True):
            links.append((entry, targets[near[first]][1]))
            part[part == other] = mine
            now[int(other)] = mine
    return links


def tiles(members: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, store: Store) -> DataFrame:
    """(a, b): links that join components within groups. members: lead, entry, component, of groups with several components."""
    sized = members.join(sizes, "entry")
    parts = sized.groupBy("lead", "component").agg(F.count("*").alias("times"), F.sum("n_shingles").alias("held"))
    largest = F.max_by(F.struct("component", "held"), F.struct("times", "component"))
    groups = parts.groupBy("lead").agg(largest.alias("main"), F.sum("held").alias("held"), F.sum("times").alias("times"))
    blocks = lambda n: F.greatest(F.ceil(n / TILE), F.lit(1)).cast("int")
    groups = groups.select("lead", F.col("main.component").alias("main"), blocks(F.col("held")).alias("n"), blocks(F.col("held") - F.col("main.held")).alias("m"), "times")
    at = joined_by(members, store.write(groups, "groups"), ["lead"], members.count()).drop("times")
    own = lambda n, salt: F.pmod(F.xxhash64("entry", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Each member is in one block, for every batch of probes; each probe is in one batch, for every block.
    targets = at.select("lead", own("n", 1).alias("i"), every("m").alias("j"), F.lit(False).alias("probe"), "entry", "component")
    probes = at.where("component <> main").select("lead", every("n").alias("i"), own("m", 2).alias("j"), F.lit(True).alias("probe"), "entry", "component")
    placed = targets.unionByName(probes).join(sets, "entry").select("lead", "i", "j", "probe", "entry", "component", "shingles")
    placed = placed.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")

    def run(batches):
        now, rows = None, []

        def out():
            links = tile_links(rows, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for *tile, probe, entry, component, shingles in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                    if tile != now:
                        if rows:
                            yield out()
                        now, rows = tile, []
                    rows.append((probe, entry, component, shingles))
        if rows:
            yield out()

    return placed.mapInArrow(vec.tidy(run), PAIR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable by links), kept (id is it)."""
    store = Store(docs.sparkSession, "near-dup")
    docs = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    sketches = store.write(sketch(docs, shingle).withColumn("row", F.monotonically_increasing_id()), "sketches")
    known = sketches.where("entry is not null and id is not null")
    classes = known.groupBy("entry").agg(F.min(F.struct("id", "row")).alias("head"))
    classes = store.write(classes.select("entry", F.col("head.id").alias("rep"), F.col("head.row").alias("row")), "classes")

    heads = known.join(classes.select("row"), "row", "left_semi")
    banded = heads.select("entry", F.explode("bands").alias("key"))
    leaders = banded.groupBy("key").agg(F.min("entry").alias("lead"), F.max("entry").alias("last")).where("lead <> last").drop("last")
    members = store.write(banded.join(leaders, "key").select("lead", "entry").distinct(), "members")
    grouped = members.select("entry").distinct()
    few = store.write(heads.select("id", "hash", "entry", "n_shingles", "registers").join(grouped, "entry", "left_semi"), "registers")
    # The one row of an entry is found again by its id and the hash of its text; rows repeated as a whole are one.
    near = docs.join(few.select("id", "hash", "entry"), ["id", "hash"]).dropDuplicates(["id", "hash"]).select("entry", "text")
    near = store.write(near, "texts")
    sets = store.write(sketches.select("id", "n_shingles", "entry"), "sets")
    # Rows of one id are one vertex.
    several = sets.where("entry is not null and id is not null").groupBy("id").agg(F.min("entry").alias("a"), F.max("entry").alias("z")).where("a <> z").drop("z")
    links = store.write(sets.join(several, "id").where("entry <> a").select("a", F.col("entry").alias("b")).distinct(), "links-id")
    store.drop("sketches")
    store.reclaim()

    linked = not links.isEmpty()
    labels = components(links, "a", "b", store, "components-id") if linked else docs.sparkSession.createDataFrame([], "node long, component long")

    def now() -> DataFrame:
        """members with their present components."""
        return members.join(labels.withColumnRenamed("node", "entry"), "entry", "left").withColumn("component", F.coalesce("component", "entry"))

    def first_leader():
        return members.where("entry <> lead").groupBy("entry").agg(F.min("lead").alias("a")).select("a", F.col("entry").alias("b"))

    def other_leaders():
        lead = labels.select(F.col("node").alias("lead"), F.col("component").alias("other"))
        pairs = now().join(lead, "lead", "left").where("coalesce(other, lead) <> component")
        pairs = pairs.select(F.col("lead").alias("a"), F.col("entry").alias("b"))
        return pairs.join(store.spark.read.schema(pairs.schema).parquet(store.path("pairs-0")), ["a", "b"], "left_anti")

    def in_tiles():
        at = now()
        mixed = at.groupBy("lead").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("times")).where("c0 <> c1").select("lead", "times")
        at = store.write(joined_by(at, store.write(mixed, "mixed-leads"), ["lead"], members.count()).drop("times"), "mixed")
        shingles = store.write(full_sets(near.join(at.select("entry").distinct(), "entry", "left_semi"), shingle), "shingles")
        return tiles(at, few.select("entry", "n_shingles"), shingles, percent, store)

    for step, proposed in enumerate((first_leader, other_leaders, in_tiles)):
        pairs = store.write(proposed(), f"pairs-{step}")
        if pairs.isEmpty():
            continue
        promising = pairs if proposed is in_tiles else _promising(pairs, few, percent / 100 - MARGIN)
        found = store.write(_verified(promising, near, shingle, percent), f"links-{step}")
        if found.isEmpty():
            continue
        links = links.unionByName(found)
        labels = components(links, "a", "b", store, f"components-{step}")
        store.reclaim()

    # A component's id is the smallest of all its rows' ids.
    named = labels.withColumnRenamed("node", "entry").join(classes, "entry")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    least = labels.join(least, "component").select(F.col("node").alias("entry"), "least")
    names = store.write(classes.select("entry", "rep").join(least, "entry", "left").select("entry", F.coalesce("least", "rep").alias("component_id")), "names")
    store.close("names", "sets")
    out = sets.join(names, "entry", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
