"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library encodes; its model is built from a ranks file (one
base64 token and its rank per line).  Every byte is shown to the library as one
printable character, and decoding turns that table round: ids become
characters, characters become bytes, and only the joined bytes of a document
are read as UTF-8, so a character that is split over tokens comes back whole.

The model holds every pair of tokens whose join is a token, ordered by the rank
of the join, and looks a whole pre-token up before it merges.  Merging by rank
of the join and by order of the pairs agree then; the tests hold it against
the tiktoken library.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm.common import released, slices, table
from tidemark.llm.pretokens import Cache, PreTokens, byte_level_narrow


def byte_table() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def model_json(ranks: dict[bytes, int]) -> str:
    """The ranks as a tokenizers model; it does no splitting of its own."""
    shown = byte_table()
    text = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [
        [text[token[:k]], text[token[k:]]]
        for token in sorted(ranks, key=ranks.__getitem__)
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    ]
    return json.dumps({
        "version": "1.0", "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None, "truncation": None, "padding": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {"type": "BPE", "vocab": {text[t]: r for t, r in ranks.items()}, "merges": merges, "ignore_merges": True},
    })


class ByteCodec:
    """Encodes pre-tokens and decodes ids; one per worker process."""

    def __init__(self, model: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.cutter = PreTokens(byte_level_narrow(), pattern)
        self.pattern, self.library = pattern, None
        back = {c: b for b, c in enumerate(byte_table())}
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in self.tokenizer.get_vocab().items()}
        self.words = Cache(lambda new: [e.ids for e in self.tokenizer.encode_batch(new, add_special_tokens=False)])
        self.digests = Cache(self._digests)

    def _digests(self, words: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        for encoded in self.tokenizer.encode_batch(words, add_special_tokens=False):
            yield len(encoded.ids), ",".join(map(str, encoded.ids)).encode(), self.decode(encoded.ids)

    def _whole(self, text: str) -> list[int]:
        """For characters on whose class the engines differ: the tiktoken library, with the same ranks."""
        if self.library is None:
            import tiktoken

            ranks = {token: i for i, token in self.token_bytes.items()}
            self.library = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self.library.encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        words = self.cutter.cut(text)
        if words is None:
            return self._whole(text)
        self.words.fill(words)
        return [i for w in words for i in self.words[w]]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Start and end byte of each token in the UTF-8 of the text."""
        out, at = [], 0
        for i in self.encode(text):
            out.append((at, at := at + len(self.token_bytes[i])))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of tokens, SHA-256 of the ids with commas, SHA-256 of the decoded bytes."""
        cut = [self.cutter.cut(text) for text in texts]
        self.digests.fill(set().union(*(words for words in cut if words)))
        get = self.digests.__getitem__
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                ids = self._whole(text)
                found = [(len(ids), ",".join(map(str, ids)).encode(), self.decode(ids))]
            else:
                found = list(map(get, words))
            yield (
                sum(x[0] for x in found),
                hashlib.sha256(b",".join([x[1] for x in found])).hexdigest(),
                hashlib.sha256(b"".join([x[2] for x in found])).hexdigest(),
            )


_CODECS: dict[tuple[int, str], ByteCodec] = {}


def worker_codec(model: str, pattern: str) -> ByteCodec:
    """This process's codec; made once."""
    key = (hash(model), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteCodec(model, pattern)
    return _CODECS[key]


def _setup(spark: SparkSession, ranks_path: str):
    return spark.sparkContext.broadcast(model_json(read_ranks(ranks_path)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``ids`` array<int>, ``starts`` array<int> (first byte of each token).

    Null texts count as empty: both arrays are empty.  Columns of ``docs`` that
    already have these names are replaced.  The model is a few MB of fixed size.
    """
    model = _setup(docs.sparkSession, ranks_path)
    docs = docs.drop("ids", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model.value, pattern)
        for batch in slices(batches, text):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids = pa.array([codec.encode(x) for x in texts], pa.list_(pa.int32()))
            starts = pa.array([[a for a, _ in codec.offsets(x)] for x in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, starts], names=[*batch.schema.names, "ids", "starts"])

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(released(run), schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns and ``decoded`` binary: the joined bytes of the tokens; null ids give null."""
    model = _setup(encoded.sparkSession, ranks_path)
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model.value, pattern)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            out = pa.array([None if r is None else codec.decode(r) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(released(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode the ids, and keep counts and digests only.

    Ids and bytes stay in the worker: the rows out are small whatever the texts
    are.  Null texts count as empty (0 tokens, digests of nothing).  Repeated
    rows each give a row.
    """
    model = _setup(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model.value, pattern)
        for batch in slices(batches, text):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n, ids, decoded = zip(*codec.digest(texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(released(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
