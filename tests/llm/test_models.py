"""Trained operators: exact parts against brute force, the rest by held-out accuracy; and the pipeline."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import context_mixing, language_id, packing, toxicity
from tidemark.llm.common import fold, table
from tidemark.llm.queries import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ODD = [(1, None), (2, ""), (3, " \n "), (4, "123 !!"), (5, "word " * 40_000), (6, "ok then"), (6, "ok then"), (None, "hello there")]


def plain_grams(text: str) -> Counter:
    words = [[]]
    for c in text.lower():
        words[-1].append(ord(c) + 2) if c.isalpha() else words.append([])
    out: Counter = Counter()
    for w in filter(None, words):
        padded = [1, *w, 1]
        for n in range(1, 5):
            for i in range(len(padded) - n + 1):
                if padded[i : i + n] != [1]:
                    out[sum(c * int(m) for c, m in zip(padded[i : i + n], language_id._PLACES)) % 2**64 >> 12] += 1
    return out


def test_grams():
    texts = ["Hello, wörld! it's", None, "", " x ", "123", "aa  bb\n\ncc", "I", "Ça İ ß", "日本語の文 漢字", "\U0001f600 𝔄b"]
    text, gram, count = language_id._grams(*language_id._points(texts))
    for i, t in enumerate(texts):
        assert dict(zip(gram[text == i].tolist(), count[text == i].tolist(), strict=True)) == plain_grams(t or "")


def test_out_of_place():
    x, y = (next(g for g, n in plain_grams(c).items() if g == (ord(c) + 2) * int(language_id._PLACES[0]) % 2**64 >> 12) for c in "xy")
    order = np.argsort([x, y])
    profiles = language_id.Profiles(["aa", "bb"], np.array([x, y], np.uint64)[order], np.array([[0, -1], [-1, 0]], np.int32)[order])
    names, score = language_id.classify(["x", "y", "", None], profiles)
    assert names[2:] == ["und", "und"] and score[2] == score[3] == 0
    assert names[0] == "aa" and names[1] == "bb" and (score[:2] > 0).all()


def test_languages_with_thousands_of_letters(spark):
    """Two languages whose letters are all of one script and all rare, told apart by which follow which."""
    rng = random.Random(5)
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    rng.shuffle(han)
    kinds = {"left": han[:1500], "right": han[1500:]}
    rows = [(i, "".join(rng.choices(kinds[k], [1 / (j + 1) for j in range(1500)], k=60)) + " 。", k) for i, k in enumerate(["left", "right"] * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(docs.where("doc_id >= 200"), language_id.learn(docs.where("doc_id < 200"))).collect()
    assert len(found) == 100 and all(r.lang_pred == r.lang for r in found)


def test_language_of_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = language_id.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 100 and np.mean([r.lang == r.lang_pred for r in found]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)


def test_language_of_odd_rows(spark):
    rows = spark.createDataFrame([(*r, "en", 1.0) for r in ODD], "doc_id long, text string, lang string, score double")
    found = language_id.identify(rows, language_id.learn(rows)).collect()
    assert [(r.doc_id, r.lang_pred) for r in found[:4]] == [(1, "und"), (2, "und"), (3, "und"), (4, "und")] and len(found) == len(ODD)
    assert all(r.lang_pred == "en" for r in found[4:])
    nothing = language_id.learn(rows.limit(0))
    assert {r.lang_pred for r in language_id.identify(rows, nothing).collect()} == {"und"}
    assert language_id.identify(rows.limit(0), nothing).collect() == []


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    raw = toxicity.grow(x[:2000], y[:2000]).raw(x[2000:])
    assert ((raw > 0) == y[2000:]).mean() > 0.95
    at, value = toxicity.isotonic(raw, y[2000:])
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all() and 0 < value[0] < value[-1] < 1
    flat = toxicity.grow(x, np.zeros(3000))
    assert len(set(flat.raw(x).tolist())) == 1
    assert [a.tolist() for a in toxicity.isotonic(np.zeros(0), np.zeros(0))] == [[0.0], [0.0]]


def test_features():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "^blar": 3.0})
    named = lambda t: dict(zip(toxicity.NAMES, toxicity.features(t, lexicon), strict=True))
    rude = named("YOU are an Idiot!! blargh, 1d10t")
    assert rude["distinct"] == 2 and rude["strongest"] == 5 and rude["near_you"] == 1 and rude["hidden_hits"] > 0 and rude["shouted"] > 0 and rude["runs"] > 0
    assert set(named("").values()) == {0.0} and named("fine words")["hits"] == 0


def test_toxicity_of_held_out(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    model = toxicity.learn(table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels").where(fold("doc_id", 4) != 2))
    docs = table(spark, "/root/testdata/sf0.1", "documents").where(fold("doc_id", 4) == 2)
    found = [(labels[r.doc_id], r.predicted) for r in toxicity.score(docs, model).collect() if r.doc_id in labels]
    hits = sum(a and b for a, b in found)
    assert hits / sum(a for a, _ in found) > 0.85 and hits / sum(b for _, b in found) > 0.9
    odd = spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, score string")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (6, 1), (6, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        assert len(toxicity.score(docs, toxicity.learn(docs, known)).collect()) == len(ODD)


def test_mixing_of_one_text_is_the_plain_loop():
    rng = np.random.default_rng(2)
    n = 2 * context_mixing.SEGMENT + 100
    x, bits, gates = rng.normal(size=(n, 5, 3)).astype(np.float32), rng.integers(0, 2, (n, 5)), rng.integers(0, context_mixing.GATES, n)
    got = context_mixing.mixed_cost(x, bits, gates, np.array([n]), np.array([0]))
    for t in range(n):
        if t % context_mixing.SEGMENT == 0:
            w = np.full((context_mixing.GATES, 5, 3), context_mixing.START, np.float32)
        p = 1 / (1 + np.exp(-(w[gates[t]] * x[t]).sum(axis=1)))
        assert math.isclose(got[t], np.log(np.where(bits[t] == 1, p, 1 - p)).sum(), rel_tol=1e-4)
        w[gates[t]] += context_mixing.RATE * (bits[t] - p)[:, None] * x[t]


def test_predictions_are_those_of_plain_counts():
    rng = random.Random(6)
    seen = Counter((rng.randrange(4), rng.randrange(19)) for _ in range(60))
    asked = sorted({*seen, *((k, c) for k in range(5) for c in (0, 7, 18))})
    odds, totals = context_mixing.predictions(np.array([k << 5 | c for k, c in asked], np.uint64), np.array([seen[x] for x in asked]))
    for i, (key, c) in enumerate(asked):
        assert totals[i] == sum(n for (k, _), n in seen.items() if k == key)
        for d in range(5):
            one, zero = (sum(n for (k, x), n in seen.items() if k == key and x >> (5 - d) == c >> (5 - d) and x >> (4 - d) & 1 == bit) for bit in (1, 0))
            assert abs(odds[d, i] * context_mixing._STEP - math.log((one + 0.4) / (zero + 0.4))) <= 0.051


def test_scores(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "never seen zzz")], "doc_id long, text string"))
    found = context_mixing.score(docs, fold("doc_id", 10) != 0).collect()
    tokens = {r.doc_id: [*WORD.findall((r.text or "").encode().translate(LOWER)), b""] for r in docs.collect()}
    counts: Counter = Counter()
    for key, words in tokens.items():
        if zlib.crc32(str(key).encode()) % 10:
            counts.update(words)
    total, types = sum(counts.values()), len(counts)
    for r in found:
        words = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        assert (r.bits_per_byte is None) == (r.doc_id in (-1, -2))
    held = [r for r in found if r.held_out]
    assert len(held) > 50 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_are_a_distribution(spark):
    """All texts of up to five words, with one unknown, have probabilities that sum to one but for those of longer texts."""
    rng = random.Random(0)
    train = [(i, " ".join(rng.choices("abcd", (5, 3, 2, 1), k=rng.choice((0, 1, 1, 2, 2, 2))))) for i in range(1, 400)]
    texts = [" ".join(t) for k in range(6) for t in itertools.product(["a", "b", "c", "d", "unknown"], repeat=k)]
    docs = spark.createDataFrame([*train, *((1000 + i, t) for i, t in enumerate(texts))], "doc_id long, text string")
    found = {r.doc_id: r.score for r in context_mixing.score(docs, F.col("doc_id") < 1000).collect()}
    assert 0.99 < sum(10 ** found[1000 + i] for i in range(len(texts))) < 1 + 1e-4
    assert sum(10 ** found[1000 + i] for i, t in enumerate(texts) if len(t.split()) < 2) < 0.9


def test_best_codes_are_those_of_plain_counts():
    rng = random.Random(5)
    seen = {(rng.randrange(40) << 5 | rng.randrange(3), rng.randrange(context_mixing.CODES)): rng.choice((0, 0, 1, 1, 2, 9)) for _ in range(300)}
    asked = sorted(seen)
    odds, best = context_mixing.best_codes(np.array([k << context_mixing.CODE | c for k, c in asked], np.uint64), np.array([seen[x] for x in asked]))
    for i, (key, _) in enumerate(asked):
        mine = {c: n for (k, c), n in seen.items() if k == key}
        top, total = max(mine.values()), sum(mine.values())
        if not total:
            assert odds[i] == context_mixing._NONE
            continue
        assert best[i] == min(c for c, n in mine.items() if n == top)
        assert abs(odds[i] * context_mixing._STEP - math.log((top + 0.4) / (total - top + 0.4))) <= 0.051
    assert [len(x) for x in context_mixing.best_codes(np.zeros(0, np.uint64), np.zeros(0, np.int64))] == [0, 0]


def test_words_are_predicted_by_the_two_before(spark):
    """Of words of one class with equal counts, the one that followed the two previous words is likelier."""
    words = [f"w{i}" for i in range(60)]
    train = [(-1, f"x{i % 6} y{i // 6 % 10} {w}") for i, w in enumerate(words)] * 8
    docs = spark.createDataFrame([*train, *((i, f"x{i % 6} y{i // 6 % 10} {w}") for i, w in enumerate(words)), *((100 + i, f"x{i % 6} y{i // 6 % 10} {words[(i + 7) % 60]}") for i in range(60))], "doc_id long, text string")
    found = {r.doc_id: r.score for r in context_mixing.score(docs, F.col("doc_id") < 0).where("held_out").collect()}
    assert min(found[i] - found[100 + i] for i in range(60)) > 0.5


def test_contexts_of_a_large_vocabulary_stay_apart(spark):
    """30,000 words of two kinds: one always ends its text, the other is always followed by a word."""
    words = spark.range(30_000).select(F.col("id"), F.concat(F.lit("w"), "id").alias("w"), (F.col("id") % 2 == 0).alias("ends"))
    train = words.select(F.lit(-1).cast("long").alias("doc_id"), F.when(F.col("ends"), F.col("w")).otherwise(F.concat("w", F.lit(" then"))).alias("text"))
    held = words.select("id", F.col("w").alias("text")).unionByName(words.select(F.col("id") + 100_000, F.concat("w", F.lit(" then")).alias("text")).toDF("id", "text"))
    docs = train.unionByName(train).unionByName(held.withColumnRenamed("id", "doc_id"))
    found = {r.doc_id: r.score for r in context_mixing.score(docs, F.col("doc_id") < 0).where("held_out").collect()}
    ends = [found[i] - found[100_000 + i] for i in range(30_000)]
    assert min(ends[::2]) > max(ends[1::2])


def test_scores_without_training(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    rows = context_mixing.score(docs, F.lit(False)).collect()
    assert len(rows) == len(ODD) and all(r.n_known == 0 and r.train_tokens == 0 and r.held_out for r in rows)
    assert context_mixing.score(docs.limit(0), F.lit(True)).collect() == []


def test_queries_run_over_whole_tables(spark):
    assert sorted(n.split("_")[0] for n in queries()) == sorted(f"op{n}" for n in range(1, 11))
    n = table(spark, SF, "documents").count()
    for name in ("op2_sharding", "op4_token_counts"):
        assert queries()[name](spark, SF).count() == n


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "n-gram Jaccard join", "best-fit packing"]
    columns = table(spark, SF, "documents").columns
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    profiles = language_id.learn(table(spark, SF, "documents").where(fold("doc_id", 5) != 0))
    names, score = language_id.classify([r.text for r in docs.values()], profiles)
    kept = [r for r, name, s in zip(docs.values(), names, score, strict=True) if name != "und" and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    model = toxicity.learn(spark.createDataFrame(kept, table(spark, SF, "documents").schema), table(spark, SF, "labels").where(fold("doc_id", 4) != 2))
    kept = [r for r, s in zip(kept, model.score([r.text for r in kept]), strict=True) if s < toxicity.THRESHOLD]
    from tests.llm.test_joins import brute

    first = {key for key, _, least in brute([(r.doc_id, r.text) for r in kept], 5, 80) if key == least}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in found} == first and len(kept) < len(docs)
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)
    stage = corpus_pipeline.STAGES[0][1](spark, table(spark, SF, "documents"), SF)
    assert stage.columns == columns


def test_near_copies_of_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (1, b), (2, a + " more"), (None, c), (None, d), (None, b), (3, d), (4, ""), (None, None), (None, None), (5, c[:60]), (1, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(found, key=order) == sorted([(1, a), (1, b), (None, c), (3, d), (4, ""), (None, None), (None, None), (5, c[:60])], key=order)


def test_stages_hand_columns_on_unchanged(spark):
    docs = table(spark, SF, "documents").withColumns({"score": F.lit(7.5), "lang_pred": F.lit("mine"), "Predicted": F.lit("own"), "_identity": F.lit(1)})
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_toxic, corpus_pipeline.one_of_each_group):
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        rows = found.select("score", "lang_pred", "Predicted", "_identity").distinct().collect()
        assert [tuple(r) for r in rows] == [(7.5, "mine", "own", 1)]


@pytest.mark.parametrize("tokens", [1, 64])
def test_capacities(tokens):
    assert packing.Capacities(tokens).vector().tolist() == [tokens, tokens, tokens**2]
