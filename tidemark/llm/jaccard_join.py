"""N-gram Jaccard join by vertical partitioning.

A text's set holds the distinct n-grams of its words.  All n-grams have one
global order: the frequent ones last, by falling rarity, the others by hash.
Two sets that are similar enough share an n-gram among the first few of each
(the prefix), so only sets that meet in a prefix are compared.  To compare,
the order is cut into fragments: a set is held fragment by fragment, overlaps
are counted for each, and the partial counts are summed for each pair.

Sets that are equal form one class, which takes part once, so copies cost
nothing.  The sets that share a prefix n-gram form its list.  First each class
is compared with its neighbours in its lists; classes that links connect form
groups; then what is left to compare are pairs of a list in different groups.
Links inside a group could not change it.  All links between groups are found,
so the groups are exact.

Two bounds spare pairs before sets are moved.  At the first n-gram that two sets
share, no more than what is left of both can be common.  And each set has a
sketch, a bit for every n-gram in a table of 3 to 6 bits an n-gram: bits in
which two sketches differ are n-grams that only one set has.  In lists of more
than ``LONG`` classes the sketches travel with the classes, so that of a list's
classes only those stay that the sketches can't tell from another one; they are
compared block by block, and no pairs are written down but links that connect
groups.

Which n-grams are frequent is counted over all documents, in batches of
``_BATCH`` n-grams; those that occur once in a batch aren't told on, so a count
is short by one a batch at most.  The heaviest 2**18 are told to all tasks
(4 MB).  Any order gives the same result; a good one only keeps rare n-grams in
prefixes.

Words and n-grams are known by 64-bit hashes and sets by size and a 64-bit sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, mix, released, slices, table, text_bytes, word_hashes, written
from tidemark.llm.components import components

FRAGMENTS = 4
#: n-grams whose frequency orders them; the others count as rare.
HEAVIEST = 1 << 18
#: Longest list of which all pairs in different groups are written down, and classes in a block of a longer one.
LONG, BLOCK = 32, 1024
#: Bytes of text that are hashed together (the arrays for them take some sixty times that), and n-grams counted together.
_SLICE, _BATCH = 1 << 19, 2_000_000
_PAIR = "n long, c long, n2 long, c2 long"
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def ngram_sets(batch: pa.RecordBatch, column: int, n: int) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text, sorted.  Fewer words than ``n``: the whole sequence as one."""
    hashes, offsets = word_hashes(*text_bytes(batch.column(column)))
    with np.errstate(over="ignore"):
        grams = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
        for k in range(n):
            factor = np.uint64(pow(_FACTORS[k % 4], 2 * (k // 4) + 1, 1 << 64))
            grams += mix(hashes[k : k + len(grams)] ^ factor) * factor
        grams = mix(grams)
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if end - start >= n:
                yield np.unique(grams[start : end - n + 1])
            elif end > start:
                short = np.uint64(end - start)
                for k, h in enumerate(hashes[start:end]):
                    short = mix(np.array([short * np.uint64(_FACTORS[k % 4]) ^ h], np.uint64))[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _set_hash(grams: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(grams ^ np.uint64(_FACTORS[1])).sum(dtype=np.uint64).view(np.int64)) if len(grams) else 0


def _first_of_class(batches: Iterator[pa.RecordBatch], column: int, n: int, text: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """Size, hash and n-grams of each different set of a partition that isn't empty, once."""
    seen: set[tuple[int, int]] = set()
    for batch in slices(batches, text, _SLICE):
        for grams in ngram_sets(batch, column, n):
            key = (len(grams), _set_hash(grams))
            if key[0] and key not in seen:
                seen.add(key)
                yield *key, grams


def sketch(grams: np.ndarray) -> np.ndarray:
    """A bit for each n-gram, by the end of its hash, in the smallest table of a power of 2 with three bits an n-gram."""
    bits = 1 << max(6, (3 * len(grams) - 1).bit_length())
    at = grams & np.uint64(bits - 1)
    out = np.zeros(bits, np.uint8)
    out[at.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches as the sketches with tables of ``size`` words, which are no longer."""
    return np.bitwise_or.reduce(words.reshape(len(words), -1, size), axis=1)


def _sets(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """_key, n, c, sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, _SLICE):
            found = [(len(g), _set_hash(g), sketch(g).tobytes() if len(g) else None) for g in ngram_sets(batch, 1, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary())))], names=["_key", "n", "c", "sketch"])

    return docs.select(F.col(key).alias("_key"), text).mapInArrow(released(run), f"_key {docs.schema[key].dataType.simpleString()}, n long, c long, sketch binary")


def _heavy(docs: DataFrame, text: str, n: int) -> Broadcast:
    """The heaviest n-grams, sorted, and their counts."""

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(held), return_counts=True)
        fine = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(grams[fine].view(np.int64)), pa.array(counts[fine])], names=["gram", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for _, _, grams in _first_of_class(batches, 0, n, text):
            held.append(grams)
            size += len(grams)
            if size > _BATCH:
                yield repeated(held)
                held, size = [], 0
        if held:
            yield repeated(held)

    counted = docs.select(text).mapInArrow(released(count), "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    found = counted.orderBy(F.desc("times"), "gram").limit(HEAVIEST).toArrow()
    grams, times = found["gram"].to_numpy().view(np.uint64), found["times"].to_numpy()
    order = np.argsort(grams)
    return docs.sparkSession.sparkContext.broadcast((grams[order], times[order]))


def _prefixes(docs: DataFrame, text: str, n: int, percent: int, heavy: Broadcast) -> DataFrame:
    """n, c, and for each n-gram of the prefix its hash and place; a set may come once from each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = heavy.value
        rows: list[tuple[int, int, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]), pa.int32()), pa.array(np.concatenate([r[2] for r in rows]).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), lists], names=["n", "c", "grams"])

        for size, set_hash, grams in _first_of_class(batches, 0, n, text):
            length = size - -(-percent * size // 100) + 1
            if len(keys):
                at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                count = np.where(keys[at] == grams, counts[at], 0)
                grams = grams[np.argsort(count, kind="stable")[:length]]
            else:
                grams = grams[:length]
            rows.append((size, set_hash, grams))
            if len(rows) >= 2048:
                yield made()
                rows = []
        if rows:
            yield made()

    return docs.select(text).mapInArrow(released(run), "n long, c long, grams array<long>")


def _segments(docs: DataFrame, text: str, n: int, wanted: Broadcast) -> DataFrame:
    """n, c and the segment in each fragment of the sets whose hash ``wanted`` may hold (it may hold some more)."""
    shift = np.uint64(64 - int(math.log2(FRAGMENTS)))
    names = [f"s{k}" for k in range(FRAGMENTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        rows: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def made() -> pa.RecordBatch:
            cuts = [np.searchsorted(r[2], np.arange(1, FRAGMENTS, dtype=np.uint64) << shift) for r in rows]
            columns = []
            for k in range(FRAGMENTS):
                parts = [r[2][(cut[k - 1] if k else 0) : (cut[k] if k < FRAGMENTS - 1 else None)] for r, cut in zip(rows, cuts, strict=True)]
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.array(np.concatenate(parts).view(np.int64))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *columns], names=["n", "c", *names])

        for size, set_hash, grams in _first_of_class(batches, 0, n, text):
            slot = set_hash % (len(bits) << 6)
            if not int(bits[slot >> 6]) >> (slot & 63) & 1:
                continue
            rows.append((size, set_hash, grams))
            held += size
            if held > 500_000:
                yield made()
                rows, held = [], 0
        if rows:
            yield made()

    found = docs.select(text).mapInArrow(released(run), "n long, c long, " + ", ".join(f"{x} array<long>" for x in names))
    return found.groupBy("n", "c").agg(*(F.first(x).alias(x) for x in names))


def _bit_table(classes: DataFrame) -> Broadcast:
    """A bit for each hash of ``classes``, in a table of some sixteen bits for each: 128 kB at least, 64 MB at most."""
    slots = 1 << min(29, max(20, (16 * classes.count()).bit_length()))
    words = classes.select(F.shiftright(F.pmod("c", F.lit(slots)), 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(c, {slots}) % 64 as int))").alias("b"))
    bits = np.zeros(slots >> 6, np.uint64)
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return classes.sparkSession.sparkContext.broadcast(bits)


def _close(left: list[bytes], right: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sketches of each pair, whose sizes sum to ``sizes``, leave room for its being similar."""
    differ = np.zeros(len(left), np.int64)
    lengths = np.minimum([len(x) for x in left], [len(x) for x in right])
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        one, other = (np.concatenate([folded(np.frombuffer(side[i], np.uint64)[None], length >> 3) for i in at]) for side in (left, right))
        differ[at] = np.bitwise_count(one ^ other).sum(axis=1)
    return (100 + percent) * differ <= (100 - percent) * sizes


def _second(frame: DataFrame) -> DataFrame:
    """A frame by (n, c) with the names of a pair's second class."""
    return frame.toDF(*(f"{x}2" for x in frame.columns))


def _sketches(sets: DataFrame) -> DataFrame:
    return sets.where("n > 0").groupBy("n", "c").agg(F.first("sketch").alias("sketch"))


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (n, c, n2, c2) that their sketches can't tell apart, stored."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sizes = batch.column(0).to_numpy() + batch.column(2).to_numpy()
                fine = pa.array(_close(batch.column(4).to_pylist(), batch.column(5).to_pylist(), sizes, percent))
                yield batch.select([0, 1, 2, 3]).filter(fine)

    both = pairs.join(_sketches(sets), ["n", "c"]).join(_second(_sketches(sets)), ["n2", "c2"]).select("n", "c", "n2", "c2", "sketch", "sketch2")
    return written(both.mapInArrow(released(close), _PAIR), "pairs")


def _classes(pairs: DataFrame) -> DataFrame:
    return pairs.select("c").unionByName(pairs.select(F.col("c2").alias("c"))).distinct()


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (n, c, n2, c2) that are similar: overlaps are counted for each fragment and summed."""
    met = pairs.join(_second(segments), ["n2", "c2"]).join(segments, ["n", "c"])
    common = sum((F.size(F.array_intersect(f"s{k}", f"s{k}2")) for k in range(FRAGMENTS)), F.lit(0))
    return met.select("n", "c", "n2", "c2", common.alias("common")).where(100 * F.col("common") >= percent * (F.col("n") + F.col("n2") - F.col("common"))).drop("common")


def _fits(n: Column | np.ndarray, place: Column | np.ndarray, n2: Column | np.ndarray, place2: Column | np.ndarray, percent: int) -> Column | np.ndarray:
    """Whether sizes are near, and what is left of both sets from their first common n-gram on can be enough."""
    sizes = percent * (n + n2)
    return (percent * n2 <= 100 * n) & (percent * n <= 100 * n2) & ((100 + percent) * (n - place) >= sizes) & ((100 + percent) * (n2 - place2) >= sizes)


def _pair_rows(rows: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs of rows (n, c, ...), the smaller (n, c) second, so that a pair is written one way."""
    n, c = rows[:2]
    swap = (n[a] < n[b]) | (n[a] == n[b]) & (c[a] < c[b])
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    found = np.stack([n[a], c[a], n[b], c[b]])
    if len(a):
        found = np.unique(found, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["n", "c", "n2", "c2"])


def _short_lists(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs in different groups of each list of ``lists`` (gram, n, c, place, g), which have ``LONG`` classes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = [x.to_numpy() for x in batch.columns]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            # The last list may go on in the next batch.
            whole = int(np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))[-1])
            rest = [x[whole:] for x in rows]
            yield from pairs([x[:whole] for x in rows])
        if rest is not None:
            yield from pairs(rest)

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, n, c, place, g = rows
        left, right = [], []
        for step in range(1, LONG):
            a = np.flatnonzero(gram[step:] == gram[:-step]) if len(gram) > step else np.zeros(0, np.int64)
            if not len(a):
                break
            b = a + step
            fine = (g[a] != g[b]) & _fits(n[a], place[a], n[b], place[b], percent)
            left.append(a[fine])
            right.append(b[fine])
        if left:
            yield _pair_rows((n, c), np.concatenate(left), np.concatenate(right))

    return lists.select("gram", "n", "c", "place", "g").repartition("gram").sortWithinPartitions("gram").mapInArrow(released(run), _PAIR)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (gram, i, j), by which ``batches`` are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = np.stack([batch.column(k).to_numpy() for k in range(3)])
        starts = np.flatnonzero(np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(axis=0)])) if batch.num_rows else np.zeros(0, np.int64)
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            name = tuple(names[:, start].tolist())
            if name != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = name
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _bit_rows(lists: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each list: a bit for each value that two lists or more have."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values, at, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    fine = times[at] > 1
    rows, at = rows[fine], place[at[fine]]
    out = np.zeros((len(lists), int(place[-1]) // 64 + 1 if len(values) else 1), np.uint64)
    np.bitwise_or.at(out, (rows, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def _numbers(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A column of lists of numbers as arrays."""
    flat = column.combine_chunks()
    return np.split(flat.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(flat).to_numpy())[:-1])


def _mates(rows: pa.Table, start: int, end: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (each of rows ``start`` to ``end``, a later row or one of the other block) of near sizes in different groups."""
    n, g, upper = (rows[x].to_numpy() for x in ("n", "g", "upper"))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(start, min(end, len(n))), np.arange(len(n)), indexing="ij"))
    fine = (a < b) & (g[a] != g[b]) & (percent * n[a] <= 100 * n[b]) & (percent * n[b] <= 100 * n[a])
    if rows["i"][0] != rows["j"][0]:
        fine &= upper[a] != upper[b]
    return a[fine], b[fine]


#: Numbers that a comparison of rows takes at a time.
_CELLS = 1 << 20


def _suspects(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """gram, i, j, upper, n, c, g, stored: the classes of long lists (gram, n, c, g, k) with a partner to be compared there.

    A list is cut into blocks, and every two blocks, i and j, meet once.  A
    class stays if its sketch can't be told from that of another in a different
    group, and this list is the first, by its n-gram, of the long ones that both
    are in.  So a class comes out a few times whatever its lists' lengths are.
    """
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    own = lists.groupBy("n", "c").agg(F.collect_list("gram").alias("grams"))  # no more than its prefix
    known = lists.join(own.join(_sketches(sets), ["n", "c"]), ["n", "c"])
    known = known.withColumn("b", F.pmod(F.xxhash64("c"), blocks).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), blocks - 1)))
    known = known.select("gram", F.least("b", "d").alias("i"), F.greatest("b", "d").alias("j"), (F.col("b") > F.col("d")).alias("upper"), "n", "c", "g", "sketch", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            stays = np.zeros(rows.num_rows, bool)
            n, gram = rows["n"].to_numpy(), rows["gram"][0].as_py()
            raw = [np.frombuffer(x, np.uint64) for x in rows["sketch"].to_pylist()]
            words = np.array([len(x) for x in raw])
            before = _bit_rows([x[x < gram] for x in _numbers(rows["grams"])])
            tables: dict[int, np.ndarray] = {}  # sketches as long as the key, longer ones folded
            where = {size: np.cumsum(words >= size) - 1 for size in np.unique(words).tolist()}
            for size in where:
                tables[size] = np.concatenate([folded(x[None], size) for x in raw if len(x) >= size])
            step = max(1, _CELLS // rows.num_rows)
            for start in range(0, rows.num_rows, step):
                a, b = _mates(rows, start, start + step, percent)
                least = np.minimum(words[a], words[b])
                for size in np.unique(least).tolist():
                    p, q = a[least == size], b[least == size]
                    some = max(1, _CELLS // max(size, before.shape[1]))
                    for at in range(0, len(p), some):
                        x, y = p[at : at + some], q[at : at + some]
                        first = ~(before[x] & before[y]).any(axis=1)
                        x, y = x[first], y[first]
                        differ = np.bitwise_count(tables[size][where[size][x]] ^ tables[size][where[size][y]]).sum(axis=1, dtype=np.int64)
                        fine = (100 + percent) * differ <= (100 - percent) * (n[x] + n[y])
                        stays[x[fine]] = stays[y[fine]] = True
            yield from rows.select(["gram", "i", "j", "upper", "n", "c", "g"]).filter(pa.array(stays)).combine_chunks().to_batches()

    dealt = known.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    return written(dealt.mapInArrow(released(run), "gram long, i int, j int, upper boolean, n long, c long, g long"), "suspects")


def _linked_suspects(suspects: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Links (n, c, n2, c2) among classes that share gram, i and j: so many that they connect what all links there do.

    The partial overlaps of a fragment are counted for all pairs at once; a pair
    goes as soon as its sets differ in more n-grams than similar ones can.
    """
    names = [f"s{k}" for k in range(FRAGMENTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            n, c, g = (rows[x].to_numpy() for x in ("n", "c", "g"))
            parts = [_numbers(rows[x]) for x in names]
            sizes = [np.array([len(x) for x in part]) for part in parts]
            bits = [_bit_rows(part) for part in parts]
            root: dict[int, int] = {}

            def top(x: int, root: dict[int, int] = root) -> int:
                while x in root:
                    x = root[x]
                return x

            found: list[tuple[int, int]] = []
            step = max(1, _CELLS // rows.num_rows)
            for start in range(0, rows.num_rows, step):
                a, b = _mates(rows, start, start + step, percent)
                some = max(1, _CELLS // max(x.shape[1] for x in bits))
                for at in range(0, len(a), some):
                    x, y = a[at : at + some], b[at : at + some]
                    differ = np.zeros(len(x), np.int64)
                    for part, size in zip(bits, sizes, strict=True):
                        differ += size[x] + size[y] - 2 * np.bitwise_count(part[x] & part[y]).sum(axis=1, dtype=np.int64)
                        fine = (100 + percent) * differ <= (100 - percent) * (n[x] + n[y])
                        x, y, differ = x[fine], y[fine], differ[fine]
                    for p, q in zip(x.tolist(), y.tolist(), strict=True):
                        one, other = top(int(g[p])), top(int(g[q]))
                        if one != other:
                            root[one] = other
                            found.append((p, q))
            p, q = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n[p], c[p], n[q], c[q])], names=["n", "c", "n2", "c2"])

    dealt = suspects.join(segments, ["n", "c"]).select("gram", "i", "j", "upper", "n", "c", "g", *names)
    return dealt.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j").mapInArrow(released(run), _PAIR)


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, component_id for each row of ``docs``.

    Two texts are linked if ``100 * common >= percent * union`` for their sets
    of word n-grams.  component_id is the smallest key that links reach, the
    row's own included.  Texts without words, and null texts, have an empty set
    and are linked with nothing.  Repeated rows each give a row.  A null key
    never becomes a component's id unless it has no other.  An empty table gives
    an empty one; other columns take no part, whatever their names are.  The
    result reads two stored tables, of sets and of classes.
    """
    sets = written(_sets(docs, key, text, n), "sets")
    heavy = _heavy(docs, text, n)

    # Who meets whom: the lists of two classes or more, and in each the neighbours by size, in long ones in changing order.
    places = _prefixes(docs, text, n, percent, heavy).select("n", "c", F.posexplode("grams").alias("place", "gram"))
    places = places.repartition("gram").groupBy("gram", "n", "c").agg(F.min("place").alias("place"))
    lists = places.withColumn("k", F.count("*").over(Window.partitionBy("gram"))).where("k > 1")
    order = Window.partitionBy("gram").orderBy("long", F.when(F.col("k") > LONG, F.xxhash64("gram", "c")), "n", "c")
    lists = lists.withColumn("long", F.when(F.col("k") > LONG, F.floor(F.log("n") / math.log(1.06))))
    met = written(lists.select("gram", "n", "c", "place", "k", *(F.lead(x).over(order).alias(f"{x}2") for x in ("n", "c", "place"))), "met")
    heavy.unpersist()
    one, two = F.struct("n", "c"), F.struct(F.col("n2").alias("n"), F.col("c2").alias("c"))
    side = met.where(F.col("c2").isNotNull() & _fits(F.col("n"), F.col("place"), F.col("n2"), F.col("place2"), percent))
    pairs = side.select(F.greatest(one, two).alias("a"), F.least(one, two).alias("b")).distinct().select("a.n", "a.c", F.col("b.n").alias("n2"), F.col("b.c").alias("c2"))
    pairs = written(pairs, "pairs")
    near = _near(pairs, sets, percent)
    wanted = _bit_table(_classes(near))
    links = _linked(near, _segments(docs, text, n, wanted), percent)
    found = components(links.select(one.alias("u"), two.alias("v")))
    groups = written(found, "groups")
    wanted.unpersist()
    drop_written(found)
    drop_written(near)

    # What is left: pairs of a list that are in different groups.
    own = groups.select("node.n", "node.c", F.xxhash64("root").alias("g"))
    still = met.select("gram", "n", "c", "place", "k").join(own, ["n", "c"], "left").withColumn("g", F.coalesce("g", F.xxhash64(one)))
    whole = Window.partitionBy("gram")
    still = written(still.withColumns({"_a": F.min("g").over(whole), "_z": F.max("g").over(whole)}).where("_a != _z").drop("_a", "_z"), "lists")
    drop_written(met)
    suspects = _suspects(still.where(F.col("k") > LONG), sets, percent)
    rest = _short_lists(still.where(F.col("k") <= LONG), percent).distinct().join(pairs, ["n", "c", "n2", "c2"], "left_anti")
    near = _near(rest, sets, percent)
    wanted = _bit_table(_classes(near).unionByName(suspects.select("c")).distinct())
    segments = _segments(docs, text, n, wanted)
    more = _linked(near, segments, percent).unionByName(_linked_suspects(suspects, segments, percent))
    found = components(more.select(one.alias("u"), two.alias("v")).unionByName(groups.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    wanted.unpersist()

    # The smallest key of each class, then of each component.
    classes = sets.where("n > 0").groupBy("n", "c").agg(F.min("_key").alias("_least"))
    named = classes.join(found.select("node.n", "node.c", "root"), ["n", "c"], "left").withColumn("root", F.coalesce("root", one))
    named = named.join(named.groupBy("root").agg(F.min("_least").alias("component_id")), "root").select("n", "c", "component_id")
    out = sets.drop("sketch").join(written(named, "named"), ["n", "c"], "left")
    for used in (pairs, still, suspects, near, groups, found):
        drop_written(used)
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_key").alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: 4-word shingles, at least 85 % in common."""
    return jaccard_components(table(spark, sf_dir, "documents"))
