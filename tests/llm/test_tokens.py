"""Counting, encoding and packing against the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as tokens
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe_codec, packing, token_counts

MULTI, WORDS, BYTES = (tokens.path(f) for f in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json"))
PARTS = ["the", " quick", "Éé", "ß", "  ", "\n\n", "\t", "123", "'ll", "'S", "!!", "日本語", "한글", "😀", "́", "ﬁ", "Σας", "İ", "<|endoftext|>", "<|", "\x85", " ", "\x00", "ՙ", "\U0001f1e9", "aaaa", "՘", "\U00011b0a"]
SPECIAL = "<|endoftext|>"
text = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=20).map("".join))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "Hello, World! it's"), (4, "Hello, World! it's"), (5, f"a{SPECIAL}b <|startoftext|>"), (None, "x y"), (6, "word " * 30_000), (7, "é" * 5_000)]


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.ByteCodec(bpe_codec.model_json(bpe_codec.read_ranks(MULTI)), tokens.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=bpe_codec.read_ranks(MULTI), special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(WORDS)


@settings(max_examples=400, deadline=None)
@given(text)
def test_codec(codec, library, x):
    ids = codec.encode(x)
    assert ids == library.encode_ordinary(x)
    assert codec.decode(ids) == x.encode()
    spans = codec.offsets(x)
    assert [a for a, _ in spans] == [0, *(b for _, b in spans)][: len(spans)] and (not spans or spans[-1][1] == len(x.encode()))


def test_byte_table():
    shown = bpe_codec.byte_table()
    assert len(set(shown)) == 256 and shown[ord("a")] == "a" and shown[0] == "Ā"


def test_cache_is_emptied_and_refilled(codec):
    codec.digests.clear()
    codec.digests.most, before = 3, codec.digests.most
    try:
        for x in ("a b c", "d e f", "a b c d e f g"):
            assert next(codec.digest([x]))[0] == len(codec.encode(x))
    finally:
        codec.digests.most = before


LIBRARY = Tokenizer.from_file(WORDS)


@settings(max_examples=400, deadline=None)
@given(text)
def test_counter(counter, x):
    want = len(LIBRARY.encode(x, add_special_tokens=False).ids)
    assert counter.count(x) == want and counter.counts([x, x]) == [want, want]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join))
def test_chunk_maps(counter, x):
    before, token_counts.CHUNK = token_counts.CHUNK, 7
    try:
        want = len(LIBRARY.encode(x, add_special_tokens=False).ids)
        assert counter.count(x) == want
    finally:
        token_counts.CHUNK = before


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["un", "token", "iz", "ation", "s", "x", "qq", "e", "é", "ß", "the", "ing"]), min_size=1, max_size=40).map("".join), st.integers(1, 9), st.integers(0, 4))
def test_state_maps(counter, word, segment, before):
    t, data = counter.transducer, word.encode()
    want = t.count(data)
    assert want == len(LIBRARY.encode(word, add_special_tokens=False).ids)
    kept = token_counts.SEGMENT, token_counts.BEFORE
    token_counts.SEGMENT, token_counts.BEFORE = segment, before
    try:
        assert t.count(data) == want
        maps = [t.map_of(data, i) for i in range(0, len(data), segment)]
        ends = [t.run(0, data[: i + segment]) for i in range(0, len(data), segment)]
        assert [m(0) for m in token_counts.prefix_scan(maps, token_counts.StateMap.then)] == ends
    finally:
        token_counts.SEGMENT, token_counts.BEFORE = kept


def test_a_long_word(counter):
    word = "".join(map(chr, np.random.default_rng(2).integers(97, 123, 60_000)))
    assert counter.count(word) == len(LIBRARY.encode(word, add_special_tokens=False).ids)


def test_scan_is_associative():
    then = lambda a, b: a + b
    parts = list("abcdefghijk")
    assert token_counts.prefix_scan(parts, then) == ["".join(parts[: i + 1]) for i in range(len(parts))]
    assert token_counts.reduced(parts, then) == "".join(parts) and token_counts.prefix_scan([], then) == []


def test_transitions_are_rebuilt_when_full(counter):
    words = [w.encode() for w in ("tokenization", "untokenized", "internationalization", "x")]
    want = [counter.transducer.count(w) for w in words]
    counter.transducer.most, before = 2, counter.transducer.most
    try:
        assert [counter.transducer.count(w) for w in words] == want
    finally:
        counter.transducer.most = before


def test_count_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_tokens", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(-1))
    got = sorted(map(tuple, token_counts.count_tokens(docs, WORDS, 2048).collect()), key=repr)
    want = [(i, len((x or "").encode()), n := len(LIBRARY.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in ROWS]
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(docs.limit(0), WORDS, 1).collect() == []


def test_digest_rows(spark, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted(map(tuple, bpe_codec.digests(docs, MULTI, tokens.PATTERN).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := library.encode_ordinary(x or "")), sha(",".join(map(str, ids)).encode()), sha((x or "").encode())) for i, x in ROWS]
    assert got == sorted(want, key=repr)


def test_encode_and_decode_rows(spark, library):
    docs = spark.createDataFrame([(1, "日本 ok", 7), (2, None, 8)], "doc_id long, text string, ids int")
    encoded = bpe_codec.encode(docs, MULTI, tokens.PATTERN)
    back = {r.doc_id: r for r in bpe_codec.decode(encoded, MULTI, tokens.PATTERN).collect()}
    assert back[1].ids == library.encode_ordinary("日本 ok") and bytes(back[1].decoded).decode() == "日本 ok"
    assert back[2].ids == [] and back[2].starts == [] and bytes(back[2].decoded) == b""


def best_fit_decreasing(lengths: list[int], most: int) -> int:
    left: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=left.__getitem__)] -= n
        else:
            left.append(most - n)
    return len(left)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan(rule):
    rng = random.Random(4)
    for _ in range(60):
        most, per = rng.choice([10, 40]), rng.choice([None, 3])
        lengths = [rng.randint(1, most) for _ in range(rng.randint(0, 150))]
        capacities = packing.Capacities(most, documents=per, attention=rng.choice([None, most * most]), rule=rule)
        bins: dict[int, list[tuple[int, int]]] = {}
        placed: dict[int, int] = {}
        for n, first, items, each, at, offset in packing.plan({n: lengths.count(n) for n in set(lengths)}, capacities).tolist():
            assert first == placed.get(n, 0)
            placed[n] = first + items
            for k in range(items):
                bins.setdefault(at + k // each, []).append((offset + k % each * n, n))
        assert placed == {n: lengths.count(n) for n in set(lengths)}
        for found in bins.values():
            found.sort()
            assert [o for o, _ in found] == np.cumsum([0, *(n for _, n in found)])[:-1].tolist()
            assert sum(n for _, n in found) <= most and (per is None or len(found) <= per)
        if rule == "norm" and per is None:
            assert len(bins) == best_fit_decreasing(lengths, most)


def test_plan_rejects_what_fits_nowhere():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, packing.Capacities(10))


def test_pack_documents(spark):
    library = Tokenizer.from_file(BYTES)
    rows = [*ROWS, *((100 + i, "some words " * (i % 40)) for i in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = packing.pack_documents(docs, BYTES, tokens.PATTERN, 2, 64, with_ids=True).collect()
    by: dict[object, list] = {}
    bins: dict[int, list] = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 64
    for key, x in rows:
        if key == 4:
            continue  # repeated: two rows of each piece
        ids = [*library.encode(x or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by[key], key=lambda r: r.piece)
        assert [i for p in pieces for i in p.ids] == ids
        assert [p.piece for p in pieces] == list(range(len(pieces))) and all(p.length == 64 for p in pieces[1:])
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
    assert len(by[4]) == 2
    for members in bins.values():
        members.sort(key=lambda r: r.offset)
        assert [r.offset for r in members] == np.cumsum([0, *(r.length for r in members)])[:-1].tolist() and sum(r.length for r in members) <= 64
    assert len(bins) == best_fit_decreasing([r.length for r in found], 64)
    assert packing.pack_documents(docs.limit(0), BYTES, tokens.PATTERN, 2, 64).collect() == []
