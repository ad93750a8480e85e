"""Near-duplicate lines by an exact set-similarity join with prefix, positional and length filters.

A line's set is its distinct words (white-space separated, unchanged). A line goes if an earlier line has a Jaccard
similarity of at least ``percent``; lines are judged on the input, not on what is left. Earlier is by (document id,
line number), and where these are equal by the line's set.

Words are ordered by rarity: how often they occur in all lines, as a power of two, then by hash. Counts are kept in
2**BUCKET_BITS hashed buckets, so the order has a bounded size (4 MB) and is one total order for all tasks, which is all
that the prefix filter needs. Lines with equal sets are one class, represented by its first line. Two different sets of
similarity p share a word among their rarest n - ceil(p * n) + 1 words; sets for which that needs equality (fewer than
four words at 80 %) have no prefix. A prefix word whose bucket counts 1 occurs once in all texts and is dropped.

A prefix word that is frequent (over 2**HOT_CLASS) is joined with a second word: sets that share a frequent prefix word
and no rarer one still share two of the words of a prefix that is longer by one, so each such line is dealt out by its
pairs of words instead. A key that may still have more than CELL lines is dealt to several cells by line.

Keys move as packed arrays, dealt by key (and cell). There, all lines of a key are in order of size, and each line meets
the earlier ones in its size range; position, size and a bitmap of the words (the bits in which two sets differ bound
their overlap) leave few candidates. A line proposes its best ``K`` candidates of a part only. Proposed pairs are verified
on the words of the lines. Lines that are not settled by them, and had more candidates or other cells, are proposed
again with a larger K, against all cells, until none is left; so no pair that could matter is left untested, and a
large family of near copies never meets pair by pair.

Cases: null and empty texts have no lines to lose; lines without words stay. A null id sorts before all others. Rows
that repeat an id with the same text are one document and are cut alike; with different texts they are two.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .store import Store, fresh, refuse

BUCKET_BITS, CHUNK = 22, 1 << 16
HOT_CLASS, CELL_BITS = 16, 18
#: Keys of one part, and pairs that are held as arrays at once.
PART_KEYS, PAIRS = 200_000, 1 << 19
FIRST_K, MORE_K = 2, 16


def merged_counts(df: DataFrame, buckets_of: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """Bit length (uint8) of how often each of the 2**BUCKET_BITS buckets comes, over arrays of bucket numbers made from df.

    A task sends its counts once, in compressed chunks; the chunks are added up apart, and 2**BUCKET_BITS bytes come back.
    """

    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, np.uint32)
        held: list[np.ndarray] = []
        for at in buckets_of(batches):
            held.append(at.astype(np.int32))
            if sum(map(len, held)) >= 1 << 20:
                total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
                held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
        rows = [(k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(total.reshape(-1, CHUNK)) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], ["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
                sums[k] = sums[k] + counts if k in sums else counts.astype(np.int64)
        for k, c in sums.items():
            length = np.frexp(c.astype(np.float64))[1].astype(np.uint8)  # 0 for 0, else the bit length
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(length.tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    rows = df.mapInArrow(vec.tidy(count), "chunk int, counts binary").repartition("chunk").mapInArrow(vec.tidy(add), "chunk int, counts binary").collect()
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in rows:  # at most 2**BUCKET_BITS / CHUNK
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(r.counts), np.uint8)
    return out


def word_classes(docs: DataFrame, text: str) -> np.ndarray:
    """Rarity class of each bucket of words, over all texts."""

    def buckets(batches):
        for batch in batches:
            for _, data, offsets in vec.pieces(batch.column(0)):
                yield (vec.Words(data, offsets, vec.WHITE).hashes() >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    return merged_counts(docs.select(text), buckets)


def shared(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


class Sets:
    """The sets of the lines of a piece: words in order of rarity, line by line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray):
        words = vec.Words(data, offsets, vec.WHITE)
        h, texts = words.hashes(), words.text_of
        breaks = np.append(0, np.cumsum(data == 10, dtype=np.int32))  # before each byte
        before = breaks[words.start]
        line = np.cumsum(np.diff(before + texts, prepend=-1) != 0) - 1
        first_word = np.flatnonzero(np.diff(line, prepend=-1))
        self.text = texts[first_word]
        self.number = before[first_word] - breaks[offsets[self.text]]
        del breaks
        kind = rarity[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        low = h & np.uint64((1 << 38) - 1)
        packed = (line.astype(np.uint64) << np.uint64(44)) | (kind.astype(np.uint64) << np.uint64(38)) | low
        order = np.argsort(packed) if len(line) and line[-1] < 1 << 20 else None
        new = np.ones(len(h), bool)
        if order is not None:
            packed, h_ = packed[order], h[order]
            new[1:] = packed[1:] != packed[:-1]
            if (h_[1:] != h_[:-1])[~new[1:]].any():  # two words of a line agree in the packed bits
                order = None
            else:
                h, line, kind = h_, (packed >> np.uint64(44)).astype(np.int64), ((packed >> np.uint64(38)) & np.uint64(63)).astype(np.uint8)
        if order is None:
            order = np.lexsort((h, low, kind, line))
            h, line, kind = h[order], line[order], kind[order]
            new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.h, self.line, self.kind = h[new], line[new], kind[new]
        self.begin = np.flatnonzero(np.diff(self.line, prepend=-1))
        self.n = np.diff(np.append(self.begin, len(self.h)))

    def hashes(self, salt: int) -> np.ndarray:
        return np.add.reduceat(vec.mix(self.h ^ np.uint64(salt)), self.begin).view(np.int64) if len(self.begin) else np.zeros(0, np.int64)

    def bits(self) -> list[np.ndarray]:
        """The parity of the words in each of 128 classes, as two longs."""
        if not len(self.begin):
            return [np.zeros(0, np.int64)] * 2
        one = np.uint64(1) << ((self.h >> np.uint64(32)) & np.uint64(63))
        high = (self.h & (np.uint64(1) << np.uint64(31))).astype(bool)
        return [np.bitwise_xor.reduceat(np.where(high == k, one, np.uint64(0)), self.begin).view(np.int64) for k in (False, True)]

    def keys(self, percent: int) -> tuple[np.ndarray, ...]:
        """(line, key, position, cells as a power of two) of the prefix words, and pairs of words for frequent ones."""
        n = self.n
        need = -(-percent * n // 100)
        # A different set of the needed overlap must exist: one with a word more.
        size = np.where(100 * n >= percent * (n + 1), n - need + 1, 0)
        at = np.arange(len(self.h)) - self.begin[self.line]
        token = (self.h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        inside = at < size[self.line]
        # Sets of fewer than two needed words have no second one to share.
        hot = inside & (self.kind > HOT_CLASS) & (need >= 2)[self.line]
        one = np.flatnonzero(inside & ~hot & (self.kind != 1))
        found = [(self.line[one], token[one], at[one], self.kind[one])]
        second = at < (size + (size > 0))[self.line]
        for step in range(1, int(size[self.line[hot]].max()) + 1 if hot.any() else 1):
            a = np.arange(len(self.h) - step)
            b = a + step
            a = a[(self.line[a] == self.line[b]) & second[b] & (hot[a] | hot[b]) & (self.kind[a] != 1) & (self.kind[b] != 1)]
            b = a + step
            pair = vec.mix(self.h[a] * np.uint64(vec.BASE) + self.h[b]).astype(np.uint32)
            # Both words are shared, which is one more than a single key's position says.
            found.append((self.line[a], pair, at[b] - 1, np.minimum(self.kind[a], self.kind[b])))
        line, key, place, kind = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(line, kind="stable")
        cells = np.maximum(0, kind.astype(np.int64) - CELL_BITS).astype(np.uint8)
        return line[order], key[order], place[order].astype(np.uint32), cells[order]


LINES = "id long, hash long, line int, set_a long, set_b long, n int, bits_a long, bits_b long, keys binary, places binary, cells binary, n_keys int, wide boolean"


def cut_binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(counts)) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def line_sets(docs: DataFrame, classes: np.ndarray, percent: int) -> DataFrame:
    """LINES of each line with a word; docs has id, hash and text."""
    rarity_ = shared(classes)

    def run(batches):
        rarity = np.frombuffer(zlib.decompress(rarity_), np.uint8)
        for batch in batches:
            for row, data, offsets in vec.pieces(batch.column(2)):
                sets = Sets(data, offsets, rarity)
                if not len(sets.n):
                    continue
                ids, hashes = (batch.column(k).slice(row, len(offsets) - 1).to_numpy(zero_copy_only=False)[sets.text] for k in (0, 1))
                line, key, place, cells = sets.keys(percent)
                count = np.bincount(line, minlength=len(sets.n))
                wide = np.bincount(line, weights=cells, minlength=len(sets.n)) > 0
                columns = [ids, hashes, sets.number.astype(np.int32), sets.hashes(0x51), sets.hashes(0xA7F3), sets.n.astype(np.int32), *sets.bits()]
                columns = [*map(pa.array, columns), *(cut_binary(x, count) for x in (key, place, cells)), pa.array(count, pa.int32()), pa.array(wide)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in LINES.split(", ")])

    return docs.select("id", "hash", "text").mapInArrow(vec.tidy(run), LINES)


#: Columns of packed keys; sizes and places have two bytes where all of a body fit, else four.
PACKED = [("key", 4), ("id", 8), ("line", 4), ("set_a", 8), ("bits_a", 8), ("bits_b", 8), ("n", 0), ("place", 0)]
KINDS = {2: np.uint16, 4: np.uint32, 8: np.int64}
EARLIER, LATER = 1, 2


def packed_parts(lines: DataFrame, parts: int, wanted: bytes | None) -> DataFrame:
    """(part, cell, role, size, body): the keys of lines (with their role) as packed arrays. wanted: only keys in these buckets."""

    def run(batches):
        asked = None if wanted is None else np.frombuffer(zlib.decompress(wanted), np.uint8)
        held: list[dict] = []
        size = 0

        def out():
            one = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
            order = np.lexsort((one["role"], one["cell"], one["part"]))
            one = {k: v[order] for k, v in one.items()}
            new = np.zeros(len(order), bool)
            for k in ("part", "cell", "role"):
                new |= np.diff(one[k].astype(np.int64), prepend=-1) != 0
            edges = np.flatnonzero(new)
            size = np.where(np.maximum.reduceat(np.maximum(one["n"], one["place"]), edges) < 1 << 16, 2, 4)
            bodies = [
                b"".join(one[k][a:b].astype(KINDS[w or small], copy=False).tobytes() for k, w in PACKED)
                for a, b, small in zip(edges, np.append(edges[1:], len(order)), size, strict=True)
            ]
            columns = [pa.array(one[k][edges], pa.int32()) for k in ("part", "cell", "role")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int32()), pa.array(bodies, pa.binary())], ["part", "cell", "role", "size", "body"])

        for batch in batches:
            col = {k: batch.column(batch.schema.get_field_index(k)) for k in batch.schema.names}
            count = col["n_keys"].to_numpy()
            own = np.repeat(np.arange(batch.num_rows), count)
            flat = lambda k, t: np.frombuffer(b"".join(col[k].to_pylist()), t)
            key, place, cells = flat("keys", np.uint32), flat("places", np.uint32), flat("cells", np.uint8)
            if asked is not None:
                fine = asked[key >> np.uint32(32 - BUCKET_BITS)] > 0
                own, key, place, cells = own[fine], key[fine], place[fine], cells[fine]
            if not len(key):
                continue
            one = {k: col[k].to_numpy(zero_copy_only=False)[own] for k in ("id", "line", "set_a", "n", "bits_a", "bits_b", "role")}
            one |= {"key": key, "place": place, "part": (vec.mix(key) % np.uint64(parts)).astype(np.int32)}
            many = np.left_shift(1, cells.astype(np.int64))
            one["cell"] = (vec.mix(one["set_a"].view(np.uint64)) % many.astype(np.uint64)).astype(np.int32)
            probe = np.flatnonzero((one["role"] == LATER) & (many > 1))
            if len(probe):  # open lines meet every cell
                again = np.repeat(probe, many[probe] - 1)
                step = np.arange(len(again)) - np.repeat(np.cumsum(many[probe] - 1) - (many[probe] - 1), many[probe] - 1) + 1
                cell = (one["cell"][again] + step) % many[again]
                one = {k: np.concatenate([v, cell.astype(v.dtype) if k == "cell" else v[again]]) for k, v in one.items()}
            held.append(one)
            size += len(one["key"])
            if size >= 1 << 18:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return lines.mapInArrow(vec.tidy(run), "part int, cell int, role int, size int, body binary")


def unpacked(rows: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """The columns of rows (role, size, body)."""
    found: dict[str, list[np.ndarray]] = {k: [] for k, _ in PACKED} | {"role": []}
    for role, size, body in rows:
        n, at = len(body) // sum(w or size for _, w in PACKED), 0
        for k, w in PACKED:
            found[k].append(np.frombuffer(body, KINDS[w or size], n, at))
            at += n * (w or size)
        found["role"].append(np.full(n, role, np.uint8))
    return {k: np.concatenate(v) for k, v in found.items()}


def best_candidates(keys: dict[str, np.ndarray], percent: int, k: int) -> tuple[np.ndarray, ...]:
    """(later line, earlier line, more): each later line's best k candidates of this part; more: it has others."""
    order = np.argsort((keys["key"].astype(np.uint64) << np.uint64(32)) | keys["n"].astype(np.uint64))
    keys = {c: v[order] for c, v in keys.items()}
    n, place = keys["n"].astype(np.int64), keys["place"].astype(np.int64)
    id_, line, set_a = keys["id"], keys["line"].view(np.int32), keys["set_a"]
    group = (np.cumsum(np.diff(keys["key"].astype(np.int64), prepend=-1) != 0) << 32) | n
    later = np.flatnonzero(keys["role"] & LATER)
    lo = np.searchsorted(group, (group[later] & ~np.int64(0xFFFFFFFF)) | -(-percent * n[later] // 100))
    hi = np.searchsorted(group, (group[later] & ~np.int64(0xFFFFFFFF)) | (100 * n[later] // percent), "right")
    count = hi - lo
    some = count > 1
    later, lo, count = later[some], lo[some], count[some]
    none = np.zeros(0, np.int64)
    best = (none, none, none.astype(float), none.astype(bool))  # rows y, x, score, and whether y had to leave some out

    def pruned(y, x, score, more):
        if not len(y):
            return y, x, score, more
        o = np.lexsort((set_a[x], score, line[y], id_[y], set_a[y]))
        y, x, score, more = y[o], x[o], score[o], more[o]
        other = (np.diff(set_a[y], prepend=set_a[y[:1]]) != 0) | (np.diff(id_[y], prepend=id_[y[:1]]) != 0) | (np.diff(line[y], prepend=line[y[:1]]) != 0)
        other[0] = True
        again = ~other & (np.diff(set_a[x], prepend=set_a[x[:1]]) == 0)  # a pair has one score, so its repeats stand together
        begin = np.flatnonzero(other)
        any_more = np.logical_or.reduceat(more, begin)
        own = np.cumsum(other) - 1
        fresh_ = np.cumsum(~again) - 1
        nth = fresh_ - fresh_[begin][own]
        left = any_more[own] | (np.maximum.reduceat(nth, begin) >= k)[own]
        fine = ~again & (nth < k)
        return y[fine], x[fine], score[fine], left[fine]

    at = 0
    ends = np.cumsum(count)
    while at < len(later):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        y = np.repeat(later[at:to], count[at:to])
        x = np.repeat(lo[at:to], count[at:to]) + np.arange(len(y)) - np.repeat(np.cumsum(count[at:to]) - count[at:to], count[at:to])
        at = to
        fine = np.minimum(n[x] - place[x], n[y] - place[y]) * (100 + percent) >= percent * (n[x] + n[y])
        x, y = x[fine], y[fine]
        tie = (line[x] < line[y]) | ((line[x] == line[y]) & (set_a[x] < set_a[y]))
        fine = ((id_[x] < id_[y]) | ((id_[x] == id_[y]) & tie)) & ((keys["role"][x] & EARLIER) > 0)
        x, y = x[fine], y[fine]
        total = n[x] + n[y]
        apart = sum(np.bitwise_count((keys[b][x] ^ keys[b][y]).view(np.uint64)).astype(np.int64) for b in ("bits_a", "bits_b"))
        fine = ((total - apart) // 2) * (100 + percent) >= percent * total
        x, y, score = x[fine], y[fine], apart[fine] / total[fine]
        best = pruned(*(np.concatenate(p) for p in zip(best, (y, x, score, np.zeros(len(y), bool)), strict=True)))
    y, x, _, more = best
    return tuple(c[r] for r in (y, x) for c in (id_, line, set_a)) + (more,)


PAIR = ["y_id", "y_line", "y_set", "x_id", "x_line", "x_set"]


def candidates(parts: DataFrame, percent: int, k: int) -> DataFrame:
    """PAIR columns and more; a pair can come from several parts."""

    def run(batches):
        now, bodies = None, []

        def out():
            columns = best_candidates(unpacked(bodies), percent, k)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*PAIR, "more"])

        for batch in batches:
            for *at, role, size, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    if bodies:
                        yield out()
                    now, bodies = at, []
                bodies.append((role, size, body))
        if bodies:
            yield out()

    dealt = parts.repartition("part", "cell").sortWithinPartitions("part", "cell")
    return dealt.mapInArrow(vec.tidy(run), "y_id long, y_line int, y_set long, x_id long, x_line int, x_set long, more boolean")


def place_bucket(ids: np.ndarray, lines: np.ndarray) -> np.ndarray:
    return (vec.mix(ids.astype(np.int64).view(np.uint64) * np.uint64(vec.BASE) + lines.astype(np.uint64)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bodies_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line, set_a, body) of the wanted (id, line), and of few others.

    The wanted places are a bitmap of fixed size, so the texts are read where they are and only those lines move.
    """

    def buckets(batches):
        for batch in batches:
            yield place_bucket(batch.column(0).to_numpy(), batch.column(1).to_numpy())

    asked_ = shared(np.packbits(merged_counts(wanted.select("id", "line"), buckets) > 0))

    def run(batches):
        asked = np.unpackbits(np.frombuffer(zlib.decompress(asked_), np.uint8))
        rarity = np.zeros(1 << BUCKET_BITS, np.uint8)  # any order will do for the hash of a set
        for batch in batches:
            for row, data, offsets in vec.pieces(batch.column(1)):
                ids = batch.column(0).slice(row, len(offsets) - 1).to_numpy(zero_copy_only=False)
                breaks = np.flatnonzero(data == 10)
                start = np.concatenate([offsets[:-1], breaks + 1])
                end = np.concatenate([breaks, offsets[1:]])
                start.sort()
                end.sort()
                count = 1 + np.diff(np.searchsorted(breaks, offsets))
                text = np.repeat(np.arange(len(ids)), count)
                number = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
                fine = np.flatnonzero((end > start) & (asked[place_bucket(ids[text], number)] > 0))
                if not len(fine):
                    continue
                raw = data.tobytes()
                lines = [raw[a:b] for a, b in zip(start[fine], end[fine], strict=True)]
                some = pa.array(lines, pa.large_binary()).view(pa.large_string())
                edges = np.append(0, np.cumsum(end[fine] - start[fine]))
                sets = Sets(np.frombuffer(b"".join(lines), np.uint8), edges, rarity)
                own = fine[sets.text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[text[own]]), pa.array(number[own], pa.int32()), pa.array(sets.hashes(0x51)), some.take(pa.array(sets.text)).cast(pa.string())], ["id", "line", "set_a", "body"]
                )

    return docs.select("id", "text").mapInArrow(vec.tidy(run), "id long, line int, set_a long, body string")


def verified(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """The later lines (id, line, set_a) of the pairs that are similar enough, by their words. bodies: one for each line."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part, fine = batch.slice(i, 1024), []
                held: dict[str, set] = {}
                for a, b in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    x = held[a] if a in held else held.setdefault(a, set(a.encode().split()))
                    y = held[b] if b in held else held.setdefault(b, set(b.encode().split()))
                    both = len(x & y)
                    fine.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(3)], ["id", "line", "set_a"]).filter(pa.array(fine, pa.bool_()))

    places = ["id", "line", "set_a"]
    side = lambda s: bodies.select(*[F.col(c).alias(f"{s}_{'set' if c == 'set_a' else c}") for c in places], F.col("body").alias(f"{s}_body"))
    both = pairs.select(*PAIR).join(side("y"), ["y_id", "y_line", "y_set"]).join(side("x"), ["x_id", "x_line", "x_set"])
    return both.select("y_id", "y_line", "y_set", "x_body", "y_body").mapInArrow(vec.tidy(run), "id long, line int, set_a long").distinct()


def kept_lines(docs: DataFrame, percent: int, store: Store) -> DataFrame:
    """(id, hash, line): of the lines that have words, those that stay. docs has id, hash and text."""
    spark = docs.sparkSession
    lines = line_sets(docs, word_classes(docs, "text"), percent)
    first = lines.groupBy("set_a", "set_b").agg(F.min(F.struct("id", "line", "hash", "n", "bits_a", "bits_b", "keys", "places", "cells", "n_keys", "wide")).alias("first"))
    lines = store.write(first.select("set_a", "first.*"), "classes")
    keyed = lines.where("n_keys > 0")
    n_lines, n_keys = keyed.agg(F.count("*"), F.coalesce(F.sum("n_keys"), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_keys // PART_KEYS)
    place = ["id", "line", "set_a"]
    gone = tested = open_ = None
    k, step = FIRST_K, 0
    while True:
        if open_ is None:
            asked, roles = None, keyed.withColumn("role", F.lit(EARLIER | LATER))
        else:

            def buckets(batches):
                for batch in batches:
                    yield (np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)

            asking = store.write(keyed.join(open_, place, "left_semi"), f"asking-{step}")
            asked = shared(merged_counts(asking.select("keys"), buckets))
            roles = keyed.withColumn("role", F.lit(EARLIER)).unionByName(asking.withColumn("role", F.lit(LATER)))
        found = store.write(candidates(packed_parts(roles.drop("set_b", "hash"), parts, asked), percent, k), f"found-{step}")
        pairs = found.select(*PAIR).distinct()
        if tested is not None:
            pairs = pairs.join(tested, PAIR, "left_anti")
        pairs = store.write(pairs, f"pairs-{step}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        ends = [pairs.select(*[F.col(f"{s}_{c}").alias(c) for c in ("id", "line")]) for s in "xy"]
        # Written, so that the joins on them have no aggregate below and a hot line can be split.
        bodies = store.write(bodies_of(docs, ends[0].unionByName(ends[1]).distinct()).dropDuplicates(place), f"bodies-{step}")
        fine = store.write(verified(pairs, bodies, percent), f"gone-{step}")
        store.drop(f"bodies-{step}")
        gone = fine if gone is None else gone.unionByName(fine)
        more = found.where("more").select(*[F.col(f"y_{c}").alias(d) for c, d in zip(("id", "line", "set"), place, strict=True)])
        if open_ is None:
            more = more.unionByName(keyed.where("wide").select(*place))
        open_ = store.write(more.distinct().join(gone, place, "left_anti"), f"open-{step}")
        n_open = open_.count()
        if not n_open:
            break
        # Few open lines may propose many each: their proposals stay within the number of lines.
        k, step = max(k * MORE_K, n_lines // n_open), step + 1
    return lines.select("id", "hash", "line", "set_a").join(gone, place, "left_anti").select("id", "hash", "line")


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, column: str = "lines") -> DataFrame:
    """docs with ``text`` cut to the lines that stay, and ``column``: struct(n_lines, n_removed)."""
    refuse(docs, column)
    store = Store(docs.sparkSession, "line-dedup", frugal=True)
    key, hash_ = F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.col(text))
    plain = docs.select(key.alias("id"), hash_.alias("hash"), F.col(text).cast("string").alias("text"))
    kept = kept_lines(plain, percent, store).groupBy("id", "hash").agg(F.collect_list("line").alias("stay"))
    kept = store.write(kept, "kept")
    store.close("kept")
    id_, hash_name, stay, kept_id, kept_hash = fresh(docs, "id", "hash", "stay", "kept_id", "kept_hash")
    asked = kept.select(F.col("id").alias(kept_id), F.col("hash").alias(kept_hash), F.col("stay").alias(stay))
    left = docs.withColumns({id_: key, hash_name: hash_})
    joined = left.join(asked, (F.col(id_) == F.col(kept_id)) & (F.col(hash_name) == F.col(kept_hash)), "left").drop(id_, hash_name, kept_id, kept_hash)
    at, stay_at = joined.columns.index(text), joined.columns.index(stay)
    fields = [f for f in joined.schema.fields if f.name != stay]
    keep = [joined.columns.index(f.name) for f in fields]
    kind = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                bodies, n_lines, n_removed = [], [], []
                for body, lines in zip(part.column(at).to_pylist(), part.column(stay_at).to_pylist(), strict=True):
                    parts = [] if body is None else body.split("\n")
                    staying = set(lines or ())
                    left = [x for k, x in enumerate(parts) if k in staying or not x.encode().split()]
                    bodies.append(None if body is None else "\n".join(left))
                    n_lines.append(len(parts))
                    n_removed.append(len(parts) - len(left))
                columns = [pa.array(bodies, pa.string()) if k == at else part.column(k) for k in keep]
                counts = pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], ["n_lines", "n_removed"])
                yield pa.RecordBatch.from_arrays([*columns, counts], [*(f.name for f in fields), column])

    return joined.mapInArrow(vec.tidy(run), T.StructType([*fields, T.StructField(column, kind)]))
