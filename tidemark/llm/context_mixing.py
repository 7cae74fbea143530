"""Language-model scores by online logistic context mixing.

A token is coded by binary decisions and then by its share of what they leave.
Five decisions walk down a tree to the token's class: the end, the rare words
(with the unknown one), the middling words, or one of the clusters of common
words.  Words of a class have codes, bits of their hashes.  The sixth decision
is whether the word has the code that most often followed the two previous
words in this class; it is skipped where none did.  Among the words that the
decisions leave a word has its share of their smoothed count.

Each decision is predicted by several contexts (none, the previous class, the
previous word, the last two frequent words, the two previous words), by how
often each bit followed.  The predictions are stretched (log odds), mixed, and
squashed.  The gate selects the weights: by the decision's depth, by whether the
previous word is a common one, and by whether the two previous words were seen.
After each decision the weights move along the gradient of the coding cost.
The sixth has inputs of its own: the code's share of the class, how often it
followed, and whether the last such decision of the text held.
Weights start anew every ``SEGMENT`` tokens, so segments are scored side by
side; contexts reach across.

Clusters are learned too: a common word belongs to the frequent word that it
most often follows closely, relative to how often that one occurs.

Counts of all training tokens decide what is common.  The contexts of classes
and common words have a place each in a table of fixed size, summed over all
training tokens, which reaches the driver.  Those of rare words and of two
previous words are as many as the corpus has: documents are dealt into chunks, each chunk asks
for its contexts by key, with its own counts, and a shuffle by key sums them
and answers each chunk with log odds.  A word's key is its own; pairs of words
are hashed to slots, of which there are sixteen and more for each training
token, so fewer than one in sixteen contexts shares one.  A word's own count is
that of its context.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, fold, mix, released, slices, table, text_bytes, word_hashes, written

#: Words that every task knows, words with a cluster, and words that clusters are named after.
COMMON, CORE, ANCHORS, FREQUENT = 1 << 17, 1 << 13, 16, 256
DEPTH, NODES = 5, 32
#: Bits of a word's code within its class, and the lowest of them in its hash.
CODE, _CODE_AT = 10, 20
CODES = 1 << CODE
END, RARE, MIDDLE, FIRST = 0, 1, 2, 3  # classes; clusters begin at FIRST
CONTEXTS = 5
#: Places of the contexts that have one each: none, class and mark, two of the frequent words or none, a common word or none.
PLACES = (0, 1, 65, 65 + (FREQUENT + 1) ** 2)
SLOTS = PLACES[3] + COMMON + 1
#: Bits below a context's key in an entry: the class and (after two words) the code that followed, and whether the key is of one word.
_LOW_ONE, _LOW_TWO = 1 + DEPTH, 1 + DEPTH + CODE
#: Bits of an entry; a request has one more, whether in training.
_ENTRY = 63
#: Bytes of text in a chunk, and training tokens for each part of the keys.
_CHUNK, _PART = 1 << 22, 1 << 20
SEGMENT, RATE, START = 1024, 0.02, 0.3
#: Weight sets: by whether the previous class is one of rare or middling words, and whether the two previous words are known.
GATES = 4
#: Log odds are answered in steps of this; ``_NONE``: no code ever followed.
_STEP = 0.1
_NONE = -128
#: The first weights of the sixth decision: of the code's share, of 1, of the last such decision, and of how often it followed.
SHARE, BIAS, LAST, FOLLOWED = 0.0, -0.5, 0.5, 1.0
#: Bytes of text that are worked on together; the arrays for them take some sixty times that.
_SLICE = 1 << 20
#: Of each word, the mass that a word never seen has.
PRIOR = 0.1


@dataclass(frozen=True)
class Vocabulary:
    """Common words by rising hash: ``hashes``, ``counts``, ``rank`` (0: the most frequent), ``cluster`` (-1: none).

    ``rare``: the smoothed mass of the other training words by code.
    """

    hashes: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    cluster: np.ndarray
    tokens: int
    types: int
    documents: int
    rare: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if it isn't common."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def masses(self) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed mass of each class and code over the words known, and of each class with the end and one unknown word."""
        out = np.zeros((NODES, CODES))
        np.add.at(out, (self.classes(np.arange(len(self.hashes))), codes(self.hashes)), self.counts + PRIOR)
        out[RARE] += self.rare
        whole = out.sum(axis=1)
        whole[RARE] += PRIOR
        whole[END] = self.documents + PRIOR
        return out, whole

    def classes(self, places: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(places), RARE)
        cluster = self.cluster[places]
        return np.where(places < 0, RARE, np.where(cluster < 0, MIDDLE, FIRST + cluster))


def codes(hashes: np.ndarray) -> np.ndarray:
    """The code of each word within its class."""
    return (hashes >> np.uint64(_CODE_AT) & np.uint64(CODES - 1)).astype(np.int64)


class Tokens:
    """A batch's tokens end to end: each text's words and then its end."""

    def __init__(self, column: pa.Array) -> None:
        hashes, offsets = word_hashes(*text_bytes(column))
        n = len(offsets) - 1
        self.ends = offsets[1:] + np.arange(n)
        self.starts = offsets[:-1] + np.arange(n)
        self.is_end = np.zeros(len(hashes) + n, bool)
        self.is_end[self.ends] = True
        self.hashes = np.zeros(len(hashes) + n, np.uint64)
        self.hashes[~self.is_end] = hashes
        self.owner = np.repeat(np.arange(n), self.ends - self.starts + 1)


def _before(values: np.ndarray, starts: np.ndarray, none: int) -> np.ndarray:
    """Each token's predecessor's value in its text."""
    out = np.concatenate([np.array([none], values.dtype), values[:-1]])
    out[starts] = none
    return out


def _last(mark: np.ndarray, values: np.ndarray, tokens: Tokens, none: int) -> np.ndarray:
    """The value at the last marked token before each token of the same text."""
    at = np.maximum.accumulate(np.where(mark, np.arange(len(mark)), -1))
    at = np.concatenate([[-1], at[:-1]])
    fine = at >= tokens.starts[tokens.owner]
    return np.where(fine, values[np.maximum(at, 0)], none)


def contexts(tokens: Tokens, places: np.ndarray, classes: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The slot of each token in the contexts that have a place each, one row a context; -1 after a rare word in the last."""
    rank = np.where(places >= 0, vocabulary.rank[places] if len(vocabulary.rank) else 0, COMMON)
    previous_class = _before(classes.astype(np.int64), tokens.starts, 31)
    frequent = rank < FREQUENT
    last = _last(frequent, rank.astype(np.int64), tokens, FREQUENT)
    # The frequent word before the last one, read at the last one.
    second = _last(frequent, last, tokens, FREQUENT)
    word = PLACES[3] + 1 + _before(places.astype(np.int64), tokens.starts, -1)
    word[_after_rare(tokens, places)] = -1
    return np.stack([np.zeros(len(rank), np.int64), PLACES[1] + 2 * previous_class + (last < FREQUENT), PLACES[2] + last * (FREQUENT + 1) + second, word])


def _after_rare(tokens: Tokens, places: np.ndarray) -> np.ndarray:
    """Whether each token follows a word that isn't common."""
    return _before(places < 0, tokens.starts, False)


def _word_key(hashes: np.ndarray) -> np.ndarray:
    """Key of the context of one previous word: 57 bits, a word's own."""
    return mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - _ENTRY + _LOW_ONE)


def _entries(tokens: Tokens, places: np.ndarray, classes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """What is asked, for tokens after rare words and for all tokens: a context's key and what followed.

    After one word, an odd entry: the word's key and the class.  After two, an
    even one: the pair's slot, the first ``slots`` bits, the class and the code.
    """
    none = np.uint64(1)
    previous = _before(tokens.hashes, tokens.starts, none)
    two = _before(previous, tokens.starts, none)
    after = _after_rare(tokens, places)
    followed = classes.astype(np.uint64)
    with np.errstate(over="ignore"):
        slot = mix(mix(previous) * np.uint64(3) + mix(two) * np.uint64(5)) >> np.uint64(64 - slots) << np.uint64(_ENTRY - slots)
    one = _word_key(previous[after]) << np.uint64(_LOW_ONE) | followed[after] << np.uint64(1) | np.uint64(1)
    return one, slot | followed << np.uint64(1 + CODE) | codes(tokens.hashes).astype(np.uint64) << np.uint64(1)


def _paths(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and bits of each token's walk down the tree: arrays (depth, tokens)."""
    bits = np.stack([classes >> (DEPTH - 1 - d) & 1 for d in range(DEPTH)])
    nodes = np.stack([(1 << d) + (classes >> (DEPTH - d)) for d in range(DEPTH)])
    return nodes, bits


def mixed_cost(stretched: np.ndarray, bits: np.ndarray, gates: np.ndarray, lengths: np.ndarray, starts: np.ndarray, first_weights: np.ndarray | float = START, scale: float = 1.0) -> np.ndarray:
    """Natural log probability of each token's decisions.

    ``stretched`` (tokens, depth, contexts), in units of ``scale``, ``bits``
    (tokens, depth; -1: no such decision, its ``stretched`` are 0), ``gates``
    (tokens): the weight set.
    Texts are cut into segments, all of which take the same step together; each
    has weights of its own, which begin as ``first_weights``.
    """
    stretched, bits, chance = np.ascontiguousarray(stretched), np.ascontiguousarray(bits), np.ones(len(bits))
    pieces = -(-lengths // SEGMENT)
    first = np.repeat(starts, pieces) + SEGMENT * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(SEGMENT, np.repeat(starts + lengths, pieces) - first)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    weights = np.empty((len(first) * GATES, *stretched.shape[1:]), np.float32)
    weights[:] = first_weights
    sets = GATES * np.arange(len(first))
    for step in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -step, "left"))  # segments longer than step
        at = first[:live] + step
        x, own = stretched.take(at, axis=0) * np.float32(scale), sets[:live] + gates[at]
        w = weights.take(own, axis=0)
        logit = np.clip(np.einsum("tdc,tdc->td", w, x), -12, 12)
        p = 1 / (1 + np.exp(-logit))
        bit = bits.take(at, axis=0)
        chance[at] = np.where(bit == 1, p, np.where(bit == 0, 1 - p, 1)).prod(axis=1, dtype=float)
        x *= (np.float32(RATE) * (bit - p))[:, :, None]
        w += x
        weights[own] = w
    return np.log(chance)


# Learning


def _counts(training: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, held = [], [], 0

        def made() -> tuple[np.ndarray, np.ndarray]:
            unique, back = np.unique(np.concatenate(keys), return_inverse=True)
            return unique, np.bincount(back, np.concatenate(sums), len(unique)).astype(np.int64)

        for batch in slices(batches, text, _SLICE):
            hashes, _ = word_hashes(*text_bytes(batch.column(0)))
            unique, n = np.unique(hashes, return_counts=True)
            keys.append(unique)
            sums.append(n)
            held += len(unique)
            if held > 4_000_000:
                unique, n = made()
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n)], names=["h", "c"])
                keys, sums, held = [], [], 0
        if keys:
            unique, n = made()
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n)], names=["h", "c"])

    return training.select(text).mapInArrow(released(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


_PACKED = "part int, places binary, counts binary"


def _packed(cells: np.ndarray, parts: int) -> pa.RecordBatch:
    """A table of counts as one row for each part: places and counts of the cells that aren't 0."""
    width = -(-len(cells) // parts)
    at = np.flatnonzero(cells)
    cuts = np.searchsorted(at, np.arange(parts + 1) * width)
    rows = [(p, _planes((at[a:b] - p * width).astype("<u4")), _planes(cells[at[a:b]].astype("<u8"))) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "places", "counts"])


def _summed(rows: DataFrame, cells: int, parts: int) -> np.ndarray:
    """The sum of packed tables, part by part on the executors; the result has a fixed size.

    First those of some input partitions are summed, then the sums, so that a
    task holds about the square root of the number of partitions of a part.
    """
    width = -(-cells // parts)
    groups = math.isqrt(rows.rdd.getNumPartitions()) + 1

    def add(group: pa.Table) -> pa.Table:
        out = np.zeros(width, np.int64)
        for places, counts in zip(group["places"], group["counts"], strict=True):
            out[_from_planes(places.as_py(), "<u4")] += _from_planes(counts.as_py(), "<u8").astype(np.int64)
        at = np.flatnonzero(out)
        return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int32()), "places": pa.array([_planes(at.astype("<u4"))], pa.binary()), "counts": pa.array([_planes(out[at].astype("<u8"))], pa.binary())})

    whole = np.zeros(width * parts, np.float32)
    some = rows.groupBy("part", (F.spark_partition_id() % groups).alias("_g")).applyInArrow(add, _PACKED)
    for row in some.groupBy("part").applyInArrow(add, _PACKED).toLocalIterator():
        whole[row["part"] * width + _from_planes(bytes(row["places"]), "<u4").astype(np.int64)] = _from_planes(bytes(row["counts"]), "<u8")
    return whole[:cells]


def _clusters(training: DataFrame, text: str, vocabulary: Vocabulary) -> Vocabulary:
    shared = training.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cells = shared.value, np.zeros(CORE * ANCHORS, np.int64)
        for batch in slices(batches, text, _SLICE):
            tokens = Tokens(batch.column(0))
            places = np.where(tokens.is_end, -1, vocabulary.find(tokens.hashes))
            rank = np.where(places >= 0, vocabulary.rank[places], COMMON).astype(np.int64)
            anchor = _last(rank < ANCHORS, rank, tokens, ANCHORS)
            fine = (rank < CORE) & (anchor < ANCHORS)
            cells += np.bincount(rank[fine] * ANCHORS + anchor[fine], minlength=len(cells))
        yield _packed(cells, 16)

    if not len(vocabulary.hashes):
        return vocabulary
    seen = _summed(training.select(text).mapInArrow(released(run), _PACKED), CORE * ANCHORS, 16).reshape(CORE, ANCHORS)
    share = seen / np.maximum(seen.sum(axis=0, keepdims=True), 1)
    best = share.argmax(axis=1)
    cluster = np.where(vocabulary.rank < CORE, best[np.minimum(vocabulary.rank, CORE - 1)], -1)
    return Vocabulary(vocabulary.hashes, vocabulary.counts, vocabulary.rank, cluster, vocabulary.tokens, vocabulary.types, vocabulary.documents, vocabulary.rare)


def _tables(training: DataFrame, text: str, vocabulary: Vocabulary) -> np.ndarray:
    """Log odds (slots, nodes), in steps, of the contexts with a place each, from counts over all training tokens."""
    shared = training.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SLOTS * NODES, np.int64)
        for batch in slices(batches, text, _SLICE):
            tokens = Tokens(batch.column(0))
            if not len(tokens.owner):
                continue
            places = np.where(tokens.is_end, -1, shared.value.find(tokens.hashes))
            classes = np.where(tokens.is_end, END, shared.value.classes(places))
            for slot in contexts(tokens, places, classes, shared.value):
                np.add.at(cells, (slot * NODES + classes)[slot >= 0], 1)
        yield _packed(cells, 64)

    n = _summed(training.select(text).mapInArrow(released(run), _PACKED), SLOTS * NODES, 64)
    out = np.zeros((SLOTS, NODES), np.int8)
    for d in range(DEPTH):
        zero, one = np.moveaxis(n.reshape(SLOTS, 1 << d, 2, 1 << (DEPTH - 1 - d)).sum(axis=3), 2, 0)
        out[:, 1 << d : 2 << d] = np.clip(np.rint(np.log((one + np.float32(0.4)) / (zero + np.float32(0.4))) / _STEP), -127, 127)
    return out


# Contexts by key


def _shrunk(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _grown(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes, the first of each number first: sorted or small numbers compress well so."""
    return _shrunk(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_grown(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(rising: np.ndarray) -> bytes:
    """Rising 64-bit numbers: the leading halves by their steps, which are small."""
    half = np.uint64(32)
    return _planes((np.diff(rising >> half, prepend=np.uint64(0)) << half | rising & np.uint64(0xFFFFFFFF)).astype("<u8"))


def _from_steps(data: bytes) -> np.ndarray:
    x, half = _from_planes(data, "<u8"), np.uint64(32)
    return np.cumsum(x >> half, dtype=np.uint64) << half | x & np.uint64(0xFFFFFFFF)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _packs(docs: DataFrame, text: str) -> DataFrame:
    """Documents in chunks: chunk, docs (an Arrow stream); written, so that a chunk keeps its number and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, _CHUNK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["docs"])

    return written(docs.mapInArrow(run, "docs binary").select(F.monotonically_increasing_id().alias("chunk"), "docs"), "packs")


def _opened(pack: pa.Scalar) -> Iterator[pa.RecordBatch]:
    return iter(pa.ipc.open_stream(pack.as_py()))


def _sums(entries: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries, rising, and the sum of ``n`` of each."""
    order = np.argsort(entries)
    entries = entries[order]
    new = _runs(entries)
    return entries[new], np.add.reduceat(n[order].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)


def predictions(entries: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a key and ``DEPTH`` bits of class, rising, each of which ``n`` times was in training: the log odds of the
    decisions on the way to the class (depth, entries), in steps, and how often the key was there."""
    total = np.concatenate([[0], np.cumsum(n)])

    def level(bits: int) -> np.ndarray:
        """How often the key and the first ``bits`` bits of the class were there."""
        first = _runs(entries >> np.uint64(DEPTH - bits))
        last = np.append(first, len(entries))
        return np.repeat(total[last[1:]] - total[last[:-1]], np.diff(last))

    above = key = level(0)
    out = np.empty((DEPTH, len(entries)), np.int8)
    for d in range(DEPTH):
        below = level(d + 1)
        few = np.float32(0.4)
        odds = np.log((below.astype(np.float32) + few) / ((above - below).astype(np.float32) + few)) / np.float32(_STEP)
        bit = entries >> np.uint64(DEPTH - 1 - d) & np.uint64(1)
        out[d] = np.clip(np.rint(np.where(bit == 1, odds, -odds)), -127, 127)
        above = below
    return out, key


def _own_bits(entries: np.ndarray) -> np.ndarray:
    """1 or -1 (depth, entries) for the bits of each entry's class: odds times them are those of the own class, which compress well."""
    one = entries & np.uint64(1) == 1
    followed = (np.where(one, entries >> np.uint64(1), entries >> np.uint64(1 + CODE)) & np.uint64(NODES - 1)).astype(np.int8)
    return np.stack([(followed >> (DEPTH - 1 - d) & 1) * 2 - 1 for d in range(DEPTH)]).astype(np.int8)


def best_codes(entries: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a key and class with a code below, rising, of which ``n`` times were in training: the log odds, in steps, that
    the code is the most frequent one of its key and class (``_NONE``: none was there), and that code, the smallest of equals."""
    first = _runs(entries >> np.uint64(CODE))
    if not len(first):
        return np.zeros(0, np.int8), np.zeros(0, np.int64)
    total = np.add.reduceat(n, first)
    top = np.maximum.reduceat(n << CODE | CODES - 1 - (entries & np.uint64(CODES - 1)).astype(np.int64), first)
    count, best = top >> CODE, CODES - 1 - (top & CODES - 1)
    odds = np.clip(np.rint(np.log((count + 0.4) / (total - count + 0.4)) / _STEP), _NONE + 1, 127)
    size = np.diff(np.append(first, len(entries)))
    return np.repeat(np.where(total > 0, odds, _NONE).astype(np.int8), size), np.repeat(best, size)


def _answers(packs: DataFrame, text: str, vocabulary: Vocabulary, bits: int, slots: int) -> DataFrame:
    """chunk, part, and for each entry of the chunk in that part, rising, its predictions; for each word its total; for
    each pair's entry the log odds of the best code, and 0 if it is the entry's own or else 1 more than it.

    A part is the keys with the same leading ``bits``.  Keys are hashes and a
    chunk asks once for an entry, so parts are alike in size, whatever is frequent.
    """
    shared = packs.sparkSession.sparkContext.broadcast(vocabulary)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked = []
                for piece in slices(_opened(batch.column(1)[row]), text, _SLICE):
                    tokens = Tokens(piece.column(2))
                    places = np.where(tokens.is_end, -1, shared.value.find(tokens.hashes))
                    classes = np.where(tokens.is_end, END, shared.value.classes(places))
                    training = piece.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)[tokens.owner]
                    one, two = _entries(tokens, places, classes, slots)
                    asked += [one << np.uint64(1) | training[_after_rare(tokens, places)], two << np.uint64(1) | training]
                entries = np.sort(np.concatenate(asked))
                new = _runs(entries)
                n, entries = np.diff(np.append(new, len(entries))).astype("<u4"), entries[new]
                cuts = np.searchsorted(entries >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64)) if bits else np.array([0, len(entries)])
                rows = [(p, _steps(entries[a:b]), _planes(n[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                chunk = batch.column(0)[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary())))], names=["chunk", "part", "entries", "n"])

    def add(group: pa.Table) -> pa.Table:
        asked = [_from_steps(x.as_py()) for x in group["entries"]]
        entries, n = np.concatenate(asked), np.concatenate([_from_planes(x.as_py(), "<u4") for x in group["n"]])
        entries, n = _sums(entries >> np.uint64(1), np.where(entries & np.uint64(1) == 1, n, 0))
        one = entries & np.uint64(1) == 1
        odds, totals = np.empty((DEPTH, len(entries)), np.int8), np.zeros(len(entries), np.int64)
        odds[:, one], totals[one] = predictions(entries[one] >> np.uint64(1), n[one])
        odds[:, ~one], _ = predictions(entries[~one] >> np.uint64(1 + CODE), n[~one])
        odds *= _own_bits(entries)
        followed, miss = np.zeros(len(entries), np.int8), np.zeros(len(entries), "<u2")
        followed[~one], best = best_codes(entries[~one] >> np.uint64(1), n[~one])
        miss[~one] = np.where(best == (entries[~one] >> np.uint64(1) & np.uint64(CODES - 1)).astype(np.int64), 0, best + 1)
        out = []
        for mine in asked:
            mine = mine >> np.uint64(1)
            at = np.searchsorted(entries, mine[_runs(mine)])
            words, pairs = at[_words(entries[at])], at[~one[at]]
            out.append((_shrunk(np.ascontiguousarray(odds[:, at]).tobytes()), _planes(totals[words].astype("<u8")), _shrunk(followed[pairs].tobytes()), _planes(miss[pairs])))
        return pa.table({"chunk": group["chunk"].cast(pa.int64()), "part": group["part"].cast(pa.int32())} | {name: pa.array([x[k] for x in out], pa.binary()) for k, name in enumerate(("odds", "totals", "followed", "miss"))})

    asked = packs.mapInArrow(released(ask), "chunk long, part int, entries binary, n binary")
    return asked.groupBy("part").applyInArrow(add, "chunk long, part int, odds binary, totals binary, followed binary, miss binary")


def _words(entries: np.ndarray) -> np.ndarray:
    """Places of the first entry of each word's context among rising entries."""
    odd = np.flatnonzero(entries & np.uint64(1))
    return odd[_runs(entries[odd] >> np.uint64(_LOW_ONE))]


class Answer:
    """What a chunk was answered for its ``entries``; ``at`` is the place of each of them among the distinct ones."""

    def __init__(self, entries: np.ndarray, rows: pa.Table) -> None:
        order = np.argsort(entries)
        entries = entries[order]
        new = np.concatenate([[True], entries[1:] != entries[:-1]])[: len(entries)]
        self.at = np.empty(len(entries), np.int64)
        self.at[order] = np.cumsum(new) - 1
        entries = entries[new]
        words, pair = _words(entries), entries & np.uint64(1) == 0
        self.words, self.pair = entries[words] >> np.uint64(_LOW_ONE), np.cumsum(pair) - 1
        rows = rows.sort_by("part")
        parts = [np.frombuffer(_grown(x.as_py()), np.int8).reshape(DEPTH, -1) for x in rows["odds"]]
        self.odds = np.ascontiguousarray((np.concatenate([np.zeros((DEPTH, 0), np.int8), *parts], axis=1) * _own_bits(entries)).T)
        self.totals = np.concatenate([np.zeros(0, "<u8"), *(_from_planes(x.as_py(), "<u8") for x in rows["totals"])])
        self.followed = np.concatenate([np.zeros(0, np.int8), *(np.frombuffer(_grown(x.as_py()), np.int8) for x in rows["followed"])])
        self.miss = np.concatenate([np.zeros(0, "<u2"), *(_from_planes(x.as_py(), "<u2") for x in rows["miss"])])
        if len(self.odds) != len(entries) or len(self.totals) != len(words) or not len(self.followed) == len(self.miss) == pair.sum():
            raise ValueError("a chunk's answers don't fit its entries")

    def times(self, hashes: np.ndarray) -> np.ndarray:
        """How often each of these words of the chunk was in training."""
        return self.totals[np.searchsorted(self.words, _word_key(hashes))]

    def code(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs' entries at these places, the log odds in steps of the best code (``_NONE``: none), and 0 if it is the entry's own or 1 more than it."""
        at = self.pair[at]
        return self.followed[at], self.miss[at].astype(np.int64)


# Scoring


def score(docs: DataFrame, is_training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row.

    Scores are log10 probabilities of the words of the whole text (A-Z as a-z)
    and an end.  ``base_score`` is the smoothed unigram model's, with one
    unknown word beside the words of the training rows.  A null text counts as
    empty: it has the end only.  With no training row every word is unknown.
    """
    spark = docs.sparkSession
    docs = docs.select(key, F.coalesce(is_training, F.lit(False)).alias("_training"), text)
    training = docs.where("_training").select(text)
    counts = written(_counts(training, text), "counts")
    documents = training.count()
    words, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = counts.orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    by_code = counts.groupBy(F.shiftrightunsigned("h", _CODE_AT).bitwiseAND(CODES - 1).cast("int").alias("code")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
    drop_written(counts)
    hashes, n = common["h"].to_numpy().astype(np.int64).view(np.uint64), common["c"].to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    at, rare_counts, rare_types = by_code["code"].to_numpy(), np.zeros(CODES, np.int64), np.zeros(CODES, np.int64)
    rare_counts[at], rare_types[at] = by_code["c"].to_numpy(), by_code["n"].to_numpy()
    np.subtract.at(rare_counts, codes(hashes), n)
    np.subtract.at(rare_types, codes(hashes), 1)
    vocabulary = Vocabulary(hashes[order], n[order], np.argsort(np.argsort(-n, kind="stable"), kind="stable")[order], np.full(len(n), -1), words + documents, types + bool(documents), documents, rare_counts + PRIOR * rare_types)
    vocabulary = _clusters(training, text, vocabulary)
    model = spark.sparkContext.broadcast((vocabulary, _tables(training, text, vocabulary)))
    packs = _packs(docs, text)
    slots = min(_ENTRY - _LOW_TWO, max(16, (16 * (words + documents)).bit_length()))
    answers = _answers(packs, text, vocabulary, max(0, ((words + documents) // _PART).bit_length()), slots)

    def run(pack: pa.Table, answer: pa.Table) -> pa.Table:
        vocabulary, tables = model.value
        coded, masses = vocabulary.masses()
        first_weights = np.full((DEPTH + 1, CONTEXTS), START, np.float32)
        first_weights[DEPTH] = SHARE, BIAS, LAST, 0, FOLLOWED
        denominator = float(np.log10(vocabulary.tokens + PRIOR * (vocabulary.types + 1)))
        pieces = list(slices(_opened(pack["docs"][0]), text, _SLICE))
        asked = []
        for batch in pieces:
            tokens = Tokens(batch.column(2))
            places = np.where(tokens.is_end, -1, vocabulary.find(tokens.hashes))
            classes = np.where(tokens.is_end, END, vocabulary.classes(places))
            asked.append((tokens, places, classes, *_entries(tokens, places, classes, slots)))
        answer = Answer(np.concatenate([y for x in asked for y in x[3:]]), answer)
        out, done = [], 0
        for batch, (tokens, places, classes, one, two) in zip(pieces, asked, strict=True):
            n = batch.num_rows
            one, two = np.split(answer.at[done : done + len(one) + len(two)], [len(one)])
            done += len(one) + len(two)
            slot = contexts(tokens, places, classes, vocabulary)
            nodes, bits = _paths(classes)
            stretched = np.zeros((len(classes), DEPTH + 1, CONTEXTS), np.int8)
            for k in range(len(slot)):
                for d in range(DEPTH):
                    stretched[:, d, k] = tables.take(slot[k] * NODES + nodes[d], mode="wrap")
            stretched[slot[-1] < 0, :DEPTH, -2] = answer.odds.take(one, axis=0)
            stretched[:, :DEPTH, -1] = answer.odds.take(two, axis=0)
            times = np.where(tokens.is_end, vocabulary.documents, np.where(places >= 0, vocabulary.counts[places] if len(vocabulary.counts) else 0, 0))
            rare = classes == RARE
            times[rare] = answer.times(tokens.hashes[rare])
            # The sixth decision, where a code followed and leaves others; a word never seen has none of the codes.
            followed, miss = answer.code(two)
            best = np.where(miss > 0, miss - 1, codes(tokens.hashes))
            hit = (miss == 0) & (times > 0)
            with_code = coded[classes, best]
            without = masses[classes] - with_code
            asks = (followed != _NONE) & (classes != END) & (without >= PRIOR / 2)
            one = round(1 / _STEP)
            stretched[asks, DEPTH, 0] = np.clip(np.rint(np.log(with_code[asks] / without[asks]) / _STEP), -127, 127)
            stretched[asks, DEPTH, 1] = one
            stretched[asks, DEPTH, 2] = _last(asks, np.where(hit, one, -one), tokens, 0)[asks]
            stretched[asks, DEPTH, 4] = followed[asks]
            left = np.where(asks, np.where(hit, with_code, without), masses[classes])
            gates = (_before(classes, tokens.starts, END) < MIDDLE) + 2 * (stretched[:, 0, -1] != 0)
            lengths = tokens.ends - tokens.starts + 1
            decided = np.concatenate([bits, np.where(asks, hit, -1)[None]]).astype(np.int8).T
            cost = mixed_cost(stretched, decided, gates, lengths, tokens.starts, first_weights, _STEP) / np.log(10)
            # What the words that are left share.
            own = np.log10(times + PRIOR)
            total, base = (np.bincount(tokens.owner, x, n) for x in (cost + own - np.log10(left), own - denominator))
            known = np.bincount(tokens.owner, times > 0, n).astype(np.int64)
            size = np.diff(text_bytes(batch.column(2))[1])
            rate = pa.array(-total / np.log10(2) / np.maximum(size, 1), mask=size == 0)
            out.append(pa.RecordBatch.from_arrays([batch.column(0), pa.compute.invert(batch.column(1)), pa.array(lengths, pa.int64()), pa.array(known), pa.array(np.full(n, vocabulary.tokens, np.int64)), pa.array(base), pa.array(total), rate], names=names))
        return pa.Table.from_batches(out)

    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return packs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; learned from those whose id's crc32 mod 10 isn't 0."""
    return score(table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
