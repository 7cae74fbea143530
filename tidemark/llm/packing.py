"""Best-fit packing of documents into sequences under several capacities.

A bin (sequence) has three residual capacities: tokens, documents and attention
cost (the sum of squared lengths).  Items go in by falling length; each goes to
the bin, among those where every capacity suffices, that it leaves with the
smallest weighted residual norm (or that has the largest weighted dot-product
with it).  A new bin is opened only if none fits.

An item is its length alone, so the packing is computed for a histogram: bins
in the same state form one run of bins, and all items of a length are placed
run by run.  The result, a list of placements (length, first rank, items in a
bin, first bin, offset), depends on the number of different lengths and not on
the number of documents; both are bounded by the capacity.  Documents then find
their place by their rank among the documents of their length.  Ranks are
dealt out in many small groups (length and a hash of the document), so no task
gets all documents of a common length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe_codec import byte_table
from tidemark.llm.common import released, slices, table, written
from tidemark.llm.pretokens import PreTokens, byte_level_narrow


@dataclass(frozen=True)
class Capacities:
    """What a sequence may hold.  The defaults for documents and attention never bind before the tokens do."""

    tokens: int
    documents: int | None = None
    attention: int | None = None
    #: Of tokens, documents and attention in the residual norm or the dot-product.
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)
    rule: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def plan(histogram: dict[int, int], capacities: Capacities) -> np.ndarray:
    """Placements for ``histogram[length]`` items of each length.

    One row for each: length, first rank, items, items in a bin, first bin,
    offset.  The item of rank r goes to bin ``first_bin + (r - first) // in_a_bin``
    at ``offset + (r - first) % in_a_bin * length``.
    """
    full = capacities.vector()
    weights = np.array(capacities.weights) / full.astype(float) ** (2 if capacities.rule == "norm" else 1)
    runs: dict[tuple[int, int, int], list[list[int]]] = {}  # residuals to [first bin, bins]
    bins, out = 0, []

    def best(need: np.ndarray) -> tuple[int, int, int] | None:
        if not runs:
            return None
        states = np.array(list(runs), np.int64)
        fits = (states >= need).all(axis=1)
        if not fits.any():
            return None
        if capacities.rule == "norm":
            score = ((states - need).astype(float) ** 2 * weights).sum(axis=1)
        else:
            score = -(states.astype(float) * need / full * weights).sum(axis=1)
        score[~fits] = np.inf
        return tuple(map(int, states[int(np.argmin(score))]))

    for length in sorted(histogram, reverse=True):
        need, left, rank = np.array([length, 1, length**2], np.int64), histogram[length], 0
        if (need > full).any():
            raise ValueError(f"an item of {length} tokens fits no sequence")
        while left:
            state = best(need)
            if state is None:
                state, again = tuple(map(int, full)), int((full // need).min())
                first, have = bins, -(-left // again)
                bins += have
            else:
                first, have = runs[state].pop()
                if not runs[state]:
                    del runs[state]
                # By the norm, the bin just filled is again the best for the next item; by the dot-product it may not be.
                again = int((np.array(state) // need).min()) if capacities.rule == "norm" else 1
            use = min(have, -(-left // again))
            placed = min(left, use * again)
            out.append((length, rank, placed, again, first, int(full[0]) - state[0]))
            last = placed - (use - 1) * again
            for at, n, k in ((first, use - 1, again), (first + use - 1, 1, last), (first + use, have - use, 0)):
                if n > 0:
                    runs.setdefault(tuple(int(x) for x in np.array(state) - k * need), []).append([at, n])
            rank += placed
            left -= placed
    return np.array(out, np.int64).reshape(-1, 6)


#: Rows of a length in a group, at least; and groups in all, about, beyond which groups hold more rows.
GROUP_ROWS, GROUPS = 4096, 1 << 18


def pack(items: DataFrame, capacities: Capacities, length: str = "length", by: tuple[str, ...] = ()) -> DataFrame:
    """``items`` with sequence_id and offset long: where each row's ``length`` tokens go.

    ``by`` names columns whose hash deals the rows of a length into groups, as
    many as its rows need, and that order rows in them; ties may go either way,
    as rows equal in all of ``by`` and in length are alike.  Lengths must be 1
    to the capacity; rows with a null length get nulls.  ``items`` is read three
    times, so it should be a stored table.  The driver gets a count for each
    length and for each group: capacity and ``GROUPS`` rows, whatever the input.
    """
    spark = items.sparkSession
    taken = {"_group", "_rank", "sequence_id", "offset"}
    items = items.drop("_group", "_rank", "sequence_id", "offset")
    known = items.where(F.col(length).isNotNull())
    histogram = {int(r[0]): int(r[1]) for r in known.groupBy(length).count().collect()}
    placements = plan(histogram, capacities)
    rows = max(GROUP_ROWS, sum(histogram.values()) // GROUPS)
    many = {n: -(-k // rows) for n, k in histogram.items() if k > rows and by}
    groups = F.coalesce(F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in many.items() for x in pair)), F.col(length).cast("long")), F.lit(1)) if many else F.lit(1)
    items = items.withColumn("_group", F.pmod(F.xxhash64(*by), groups) if by else F.lit(0).cast("long"))
    # The rank that each group begins at, by length and group.
    found = items.where(F.col(length).isin(list(many))).groupBy(length, "_group").count().collect() if many else []
    found = np.array(sorted((int(r[0]), int(r[1]), int(r[2])) for r in found), np.int64).reshape(-1, 3)
    new = np.flatnonzero(np.diff(found[:, 0], prepend=-1))
    before = np.cumsum(found[:, 2]) - found[:, 2]
    before -= np.repeat(before[new], np.diff(np.append(new, len(found))))
    lookup = spark.sparkContext.broadcast((placements[np.lexsort((placements[:, 1], placements[:, 0]))], found[:, 0] << 32 | found[:, 1], before))

    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy(length, "_group").orderBy(*(by or (length,)))) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, groups, before = lookup.value
        keys = table_[:, 0] << 44 | table_[:, 1]
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            null = np.array(get(length).is_null())
            n = get(length).fill_null(0).cast(pa.int64()).to_numpy()
            group, rank = get("_group").cast(pa.int64()).to_numpy(), get("_rank").cast(pa.int64()).to_numpy()
            if len(groups):
                at = np.minimum(np.searchsorted(groups, n << 32 | group), len(groups) - 1)
                rank = rank + np.where(groups[at] == n << 32 | group, before[at], 0)
            at = np.maximum(np.searchsorted(keys, n << 44 | rank, "right") - 1, 0)
            row = table_[at] if len(table_) else np.zeros((len(n), 6), np.int64)
            step, each = rank - row[:, 1], np.maximum(row[:, 3], 1)
            sequence, offset = row[:, 4] + step // each, row[:, 5] + step % each * n
            keep = [i for i, name in enumerate(batch.schema.names) if name not in taken]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequence, pa.int64(), mask=null), pa.array(offset, pa.int64(), mask=null)],
                names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    return ranked.mapInArrow(released(place), items.drop("_group").schema.add("sequence_id", "long").add("offset", "long"))


class IdEncoder:
    """Ids by a byte-level tokenizers file with the library's defaults; one per worker process.

    Where every merge makes the token with the next id, and the engines agree on
    a text's characters, tiktoken gives the same ids over the file's own
    vocabulary in half the time; any other file or text goes to the library.
    """

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cutter = PreTokens(byte_level_narrow(), pattern)
        with open(path, encoding="utf-8") as lines:
            model = json.load(lines)["model"]
        back = {c: bytes([b]) for b, c in enumerate(byte_table())}
        ranks = {b"".join(map(back.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.special}
        made = [ranks.get(b"".join(back[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))) for m in model["merges"]]
        in_order = len(ranks) == 256 + len(made) and made == list(range(256, 256 + len(made)))
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if in_order else None

    def encode(self, text: str) -> list[int]:
        """The ids of one whole text."""
        if self.fast and self.cutter.agreed(text) and not any(s in text for s in self.special):
            return self.fast(text)
        return self.library.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[str, IdEncoder] = {}


def worker_encoder(path: str, pattern: str) -> IdEncoder:
    """This process's encoder; made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = IdEncoder(path, pattern)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, pattern: str, end: int, most: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The documents' pieces: ``key``, piece, start, length, ids_crc32 and, if wanted, ids.

    A document is its ids and then ``end``; a null text is an empty one, so it
    has that one id.  Longer documents than ``most`` are cut into pieces of that
    length, of which only the first may be shorter.  Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, pattern)
        for batch in slices(batches, text, 4 << 20):
            keys, numbers, starts, lengths, sums, kept = [], [], [], [], [], []
            for row, x in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encoder.encode(x or ""), end], "<u4").tobytes()
                start, n = 0, len(ids) // 4
                for number, stop in enumerate(range((n - 1) % most + 1, n + 1, most)):
                    keys.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(stop - start)
                    sums.append(zlib.crc32(ids[4 * start : 4 * stop]))
                    if with_ids:
                        kept.append(np.frombuffer(ids[4 * start : 4 * stop], "<i4"))
                    start = stop
            columns = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            yield pa.RecordBatch.from_arrays(
                [*columns, *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])],
                names=[key, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(released(run), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, path: str, pattern: str, end: int, most: int, key: str = "doc_id", text: str = "text", with_ids: bool = False, capacities: Capacities | None = None) -> DataFrame:
    """Cut, then pack: the columns of ``pieces`` and sequence_id, offset.

    The pieces are written to shared storage once, as they are counted first
    and then placed.
    """
    cut = written(pieces(docs, path, pattern, end, most, key, text, with_ids), "pieces")
    return pack(cut, capacities or Capacities(most), by=(key, "piece", "ids_crc32"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 1024 tokens and their places in sequences of 1024."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, 2, 1024)
