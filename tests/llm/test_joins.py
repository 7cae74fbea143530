"""Near copies, sharding, search and audio against brute force."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chroma, jaccard_join, sharding, topk_search
from tidemark.llm.common import text_bytes, word_hashes
from tidemark.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, n: int) -> frozenset:
    words = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows: list[tuple[int, str | None]], n: int, percent: int) -> list[tuple[int, int, int]]:
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key)
    return sorted((key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows))


def test_word_hashes():
    texts = ["The  the\tTHE", None, "", "\x0b", "é É the", "x" * 70_000]
    hashes, offsets = word_hashes(*text_bytes(pa.array(texts)))
    assert np.diff(offsets).tolist() == [len(WORD.findall((t or "").encode())) for t in texts]
    assert len({*hashes[:3].tolist(), int(hashes[5])}) == 1 and hashes[3] != hashes[4]
    sliced, cut = word_hashes(*text_bytes(pa.array(texts).slice(4, 1)))
    assert sliced.tolist() == hashes[3:6].tolist() and cut.tolist() == [0, 3]


def test_words_of_one_kind_do_not_collide():
    """Thue-Morse words, which any polynomial modulo 2**64 confuses, and words that differ in one byte or in length only."""
    left, right = "a", "b"
    while len(left) < 2048:
        left, right = left + right, right + left
        found, _ = word_hashes(*text_bytes(pa.array([left, right])))
        assert found[0] != found[1]
    words = [*("x" * n for n in range(1, 70)), *("x" * k + "y" + "x" * (40 - k) for k in range(41)), "ab\x00", "ab", "\x00"]
    assert len({*word_hashes(*text_bytes(pa.array(words)))[0].tolist()}) == len(words)
    assert word_hashes(*text_bytes(pa.array([" ".join(words)])))[0].tolist() == word_hashes(*text_bytes(pa.array(words)))[0].tolist()


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 100)])
def test_jaccard_components(spark, n, percent):
    rng = random.Random(n)
    vocabulary = "ab cd ef gh ij kl mn op qr st uv wx".split()
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 5, 30, 60]))) for _ in range(30)]
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t"), (3, "one"), (4, "ONE"), (5, "long " * 5000)]
    for key in range(6, 260):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice([*vocabulary, "Zz"])
        rows.append((key, " ".join(words)))
    rows += [(500 + i, "common start of all " + base[7] + f" tail{i}") for i in range(40)] + [(501, rows[6][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n", F.lit("other")).withColumn("c", F.lit(1))
    got = sorted(map(tuple, jaccard_join.jaccard_components(docs, n, percent).collect()))
    want = brute([r for r in rows if r[0] != 501], n, percent)
    assert [r for r in got if r[0] < 500] == [r for r in want if r[0] < 500]
    assert len(got) == len(rows)


def test_jaccard_in_blocks(spark, monkeypatch):
    """Long lists, cut into blocks of few classes: near copies of one text, of which only a part is linked directly."""
    monkeypatch.setattr(jaccard_join, "LONG", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "_CELLS", 64)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for key in range(120):
        words = base[: rng.choice([150, 155, 160])]
        for _ in range(rng.choice([0, 1, 3, 4, 5, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((key, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()))
    assert got == brute(rows, 4, 85) and 10 < len({r[2] for r in got}) < 110


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 3000):
        for _ in range(30):
            a = rng.integers(0, 2**64, n, np.uint64)
            b = np.unique(np.concatenate([a[rng.random(n) < rng.choice([0.8, 0.9, 1.0])], rng.integers(0, 2**64, rng.integers(0, max(2, n // 10)), np.uint64)]))
            if not len(b):
                continue
            common = len(np.intersect1d(a, b))
            close = jaccard_join._close([jaccard_join.sketch(a).tobytes()], [jaccard_join.sketch(b).tobytes()], np.array([n + len(b)]), 85)[0]
            assert close or 100 * common < 85 * (n + len(b) - common)


def test_jaccard_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(empty).collect() == []
    lone = spark.createDataFrame([(3, None), (2, ""), (1, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(lone).collect())) == [(1, 1, 1), (2, 0, 2), (3, 0, 3)]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 20), (20, 1), (5, 5), (30, 31), (31, 30)]
    found = components(spark.createDataFrame(links, "u long, v long"))
    assert dict(map(tuple, found.collect())) == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 1, 30: 30, 31: 30}
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {r.root for r in components(path).collect()} == {0}


def test_sharding(spark):
    rows = [(None, None), (1, "same"), (1, "same"), (2, ""), (3, "x" * 10_000)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("shard", F.lit("old"))
    found = sharding.shard(docs, 8, seed=1, bucket_bytes=3000).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in found))) == sorted(map(repr, rows))
    by: dict[int, list[int]] = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.shard(docs.limit(0), 8).collect() == []
    assert sorted(r.shard for r in sharding.shard(docs.limit(3), 8).collect()) == [0, 2, 5]


def test_fisher_yates_is_uniform():
    counts: dict[tuple, int] = {}
    for seed in range(6000):
        key = tuple(sharding.fisher_yates(3, (seed,)).tolist())
        counts[key] = counts.get(key, 0) + 1
    assert len(counts) == 6 and min(counts.values()) > 850
    assert sharding.fisher_yates(0, (1,)).tolist() == [] and sharding.fisher_yates(1, (1,)).tolist() == [0]


@pytest.mark.parametrize("shape", ["spread", "unit", "positive"])
def test_top_k(spark, monkeypatch, shape):
    for name, value in (("BUCKET", 16), ("QUERIES", 8), ("RUN", 2)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    x = x * rng.lognormal(size=(300, 1)) if shape == "spread" else x / np.linalg.norm(x, axis=1)[:, None]
    x = (np.abs(x) + [5, 0, 0, 0, 0, 0] if shape == "positive" else x).astype(np.float32)
    x[40:140] = x[40]  # ties
    x[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 6), (None, [1.0] * 6), (1060, [float("inf")] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("id", F.lit("other"))
    got = sorted(map(tuple, topk_search.top_k(vectors, F.col("vec_id") % 20 == 0, 5).collect()))
    whole = np.floor(256.0 * x.astype(float)).astype(int)
    want = []
    for q in range(0, 300, 20):
        scores = whole @ whole[q]
        best = [j for j in np.lexsort((np.arange(300), -scores)) if j != q][:5]
        want += [(q, r + 1, int(j), int(scores[j])) for r, j in enumerate(best)]
    assert got == sorted(want)
    assert topk_search.top_k(vectors.limit(0), F.lit(True), 5).collect() == []


def test_products_are_exact():
    a = np.array([[1 << 40, 3]], np.int64)
    assert topk_search.products(a, np.array([[1 << 20, 1]], np.int64))[0, 0] == (1 << 60) + 3
    with pytest.raises(OverflowError):
        topk_search.products(a, a)


def test_scores_that_no_long_holds(spark):
    great, least = (1 << 63) - 1, -(1 << 63)
    a = np.array([[1 << 40, 3]], np.int64)
    assert topk_search.scores(a, np.concatenate([a, -a, a // a])).tolist() == [[great, least, (1 << 40) + 3]]
    rows = [(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e15, 0.0]), (3, [1e15, 0.0]), (4, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk_search.top_k(vectors, F.col("vec_id") == 0, 4).orderBy("rank").collect()]
    assert got == [(1, great), (3, great), (4, 65536), (2, least)]


def test_blocks_of_queries_share_a_run(spark, monkeypatch):
    for name, value in (("BUCKET", 8), ("QUERIES", 4), ("RUN", 2), ("GROUP", 3)):
        monkeypatch.setattr(topk_search, name, value)
    x = np.random.default_rng(5).integers(-9, 9, size=(120, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<int>")
    got = sorted(map(tuple, topk_search.top_k(vectors, F.col("vec_id") % 2 == 0, 3, scale=1.0).collect()))
    want = []
    for q in range(0, 120, 2):
        found = x @ x[q]
        best = [j for j in np.lexsort((np.arange(120), -found)) if j != q][:3]
        want += [(q, r + 1, int(j), int(found[j])) for r, j in enumerate(best)]
    assert got == sorted(want)


def test_chroma():
    rng = np.random.default_rng(0)
    notes = rng.normal(size=150) * 0.12
    sound, rate = chroma.played(list(notes))
    whole = chroma.pack(chroma.chroma(sound, rate))
    image = chroma.chroma(sound)
    sums = chroma.integral(image)
    assert np.isclose(sums[9, 7] - sums[3, 7] - sums[9, 2] + sums[3, 2], image[3:9, 2:7].sum())
    part = chroma.pack(chroma.chroma(sound[chroma.HOP * 12 :] + rng.normal(size=len(sound) - chroma.HOP * 12) * 0.02))
    offset, errors = chroma.align(whole, part)
    assert offset == 12 and errors < 0.05 and chroma.align(part, whole)[0] == -12
    other = chroma.pack(chroma.chroma(chroma.played(list(rng.normal(size=150) * 0.12))[0]))
    assert chroma.align(whole, other) is None and chroma.align(whole, whole[:0]) is None
    assert len(chroma.pack(chroma.chroma(np.zeros(100)))) == 0
    value = (np.clip(sound, -1, 1) * 32767).astype("<i2").tobytes() + b"\0"
    assert chroma.align(whole, chroma.pack(chroma.chroma(*chroma.pcm16(value))))[0] == 0


def test_fingerprint_rows(spark):
    value = (np.sin(np.arange(60_000) / 9) * 30_000).astype("<i2").tobytes()
    rows = [(1, value), (2, None), (3, b""), (4, value), (None, value)]
    found = {r.id: r for r in chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary"), chroma.pcm16, "id", "audio").collect()}
    assert found[2].ints == found[3].ints == b"" and found[1].ints == found[4].ints == found[None].ints and len(found[1].ints) > 0
    pairs = spark.createDataFrame([(found[1].ints, found[4].ints), (found[1].ints, None)], "a binary, b binary")
    assert [(r.offset, r.bit_error) for r in chroma.align_pairs(pairs, "a", "b").collect()] == [(0, 0.0), (None, None)]




@pytest.mark.parametrize("hot", [0.001, 0.2])
def test_chroma_aligns_queries_with_all(spark, tmp_path, monkeypatch, hot):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64) * 0.12]) for i in range(45)]
    rows += [(900, rows[2][1][8:] + rows[30][1][:8]), (901, rows[7][1]), (902, None), (903, []), (905, rows[20][1][5:]), (906, rows[20][1][4:] + rows[3][1][:6]), (920, None)]
    rows += [(i, rows[9][1]) for i in (*range(950, 970), 980)] + [(None, rows[9][1]), (None, None), (40, rows[40][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(chroma, "BLOCK", 2000)
    monkeypatch.setattr(chroma, "HOT", hot)
    got = chroma.op3_chroma(spark, str(tmp_path)).collect()
    assert sorted(-1 if r.vec_id is None else r.vec_id for r in got) == sorted(-1 if i is None else i for i, _ in rows)
    found = {r.vec_id: r for r in got}
    ints = {i: chroma.pack(chroma.chroma(*chroma.played(np.float32(v).tolist()))) for i, v in rows if v and i is not None}
    first = {}
    for i in sorted(ints):
        first.setdefault(ints[i].tobytes(), i)
    asked = {}
    for i in sorted(ints):
        if i % 20 == 0:
            asked.setdefault(ints[i].tobytes(), i)
    for i in found:
        if i is None:
            continue
        assert found[i].copy_of == (first[ints[i].tobytes()] if i in ints and len(ints[i]) else i)
        if i not in ints or asked.get(ints[i].tobytes()) != i:
            assert found[i].aligned is None
            continue
        others = {j: chroma.align(ints[i], ints[j]) for j in first.values() if j != first[ints[i].tobytes()]}
        assert [(x.copy_of, x.offset, x.bit_error) for x in found[i].aligned] == sorted((j, *f) for j, f in others.items() if f)
    assert {905, 906} <= {x.copy_of for x in found[20].aligned} and found[901].copy_of == 7
    assert found[960].copy_of == 9 and found[960].aligned is not None and found[980].aligned is None
    assert [r.copy_of for r in got if r.vec_id is None and r.n_ints] == [9]
    ahead = {i: chroma.align(ints[i], ints[i + 1]) for i in range(44)}
    assert all((found[i].offset, found[i].bit_error) == (ahead[i] or (None, None)) for i in range(40))


def test_chroma_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, copy_of string").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert chroma.op3_chroma(spark, str(tmp_path)).collect() == []


def test_align_blocks_is_align_over_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    sides = [[(rng.integers(0, 6, rng.integers(0, 30)) << 12).astype(np.uint32) for _ in range(25)] for _ in range(2)]
    plain = sorted((a, b) for a, x in enumerate(sides[0]) for b, y in enumerate(sides[1]) if chroma.align(x, y))
    for most in (1, 500, 4_000_000):
        monkeypatch.setattr(chroma, "MATCHES", most)
        assert sorted(chroma.align_blocks(*sides)) == plain
