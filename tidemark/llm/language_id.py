"""Language identification by rank order of n-grams.

A language's profile lists its most frequent n-grams of letters (one to four
characters, with a mark for a word's edge) by falling frequency.  A document's
n-grams are ranked likewise.  For each of the document's best n-grams the
out-of-place measure adds the difference of the two ranks, or the profile's
length if the profile lacks it; the language with the smallest sum wins.

N-grams are known by 52-bit hashes of their characters, so every letter of
every script counts as itself; two n-grams share a hash about once in 2**52
pairs.  Windows of a batch are counted together by sorting, with no loop over
characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fold, plus, released, slices, table

#: n-grams in a profile, and n-grams of a document that are compared.
PROFILE = 400
#: Labelled documents of a language, about, that profiles are learned from (the bound of the training sample).
SAMPLE = 4000
UNKNOWN = "und"
#: Bytes of text whose windows are sorted together (that takes some hundred times that), and texts.
_SLICE, _TEXTS = 1 << 19, 1 << 12
#: A word's edge; the longest n-gram; bits of an n-gram's hash, which leave room for ``_TEXTS``.
_EDGE, _N, _GRAM = 1, 4, 52
#: An odd number for each place in an n-gram.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Profiles:
    """``grams``: hashes of n-grams, sorted; ``ranks``: of each gram in each language, -1 for none."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray


def _letters(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    seen = np.flatnonzero(np.bincount(points)) if len(points) else np.zeros(0, np.int64)
    table_ = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, bool)
    table_[[c for c in seen.tolist() if chr(c).isalpha()]] = True
    return table_[points]


def _parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text, _SLICE):
        for start in range(0, batch.num_rows, _TEXTS):
            yield batch.slice(start, _TEXTS)


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts end to end, and the number of the text of each."""
    lower = [x.lower() if x else "" for x in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.repeat(np.arange(len(lower), dtype=np.uint64), [len(x) for x in lower])


def _grams(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct n-grams: text, n-gram, count; ordered by text and n-gram.

    An n-gram is known by the upper 52 bits of a sum of its characters' code
    points, each times an odd number of its place; the text's number stands above.
    """
    letter = _letters(points)
    edge = ~letter
    new = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    keep = ~edge | ~np.concatenate([[True], edge[:-1]]) & ~new  # the first of a run of non-letters
    code, owner = np.where(letter, points + np.uint32(2), np.uint32(_EDGE))[keep], owner[keep]
    # Texts stand apart by two marks, one for the end of the last word and one for the start of the first.
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    at = np.repeat(cuts, 2)
    who = np.repeat(owner[cuts], 2)
    who[::2] = np.concatenate([[0], owner[cuts[1:] - 1]]) if len(cuts) else who[::2]
    code, owner = np.insert(code, at, _EDGE), np.insert(owner, at, who)
    code, owner = np.append(code, _EDGE).astype(np.uint64), np.append(owner, owner[-1:] if len(owner) else np.zeros(1, np.uint64))
    edge = code == _EDGE
    above, low = owner << np.uint64(_GRAM), np.uint64(64 - _GRAM)
    with np.errstate(over="ignore"):
        gram = code * _PLACES[0]
        found = [above[~edge] | gram[~edge] >> low]
        inner = np.zeros(len(code), bool)
        for n in range(2, _N + 1):
            if len(code) < n:
                break
            # A window may begin or end with an edge; none may stand inside, and two edges alone are nothing.
            inner = (inner[:-1] | edge[n - 2 : -1]) if n > 2 else np.zeros(len(code) - 1, bool)
            gram = gram[:-1] + code[n - 1 :] * _PLACES[n - 1]
            fine = ~inner & (owner[: len(gram)] == owner[n - 1 :])
            if n == 2:
                fine &= ~(edge[:-1] & edge[1:])
            found.append(above[: len(gram)][fine] | gram[fine] >> low)
    keys = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys >> np.uint64(_GRAM), keys & np.uint64((1 << _GRAM) - 1), counts


def _ranked(text: np.ndarray, gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of each text by falling count, ties by code, at most ``PROFILE`` each: text, n-gram, rank."""
    order = np.lexsort((gram, -count, text))
    text, gram = text[order], gram[order]
    first = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
    rank = np.arange(len(text)) - np.maximum.accumulate(np.where(first, np.arange(len(text)), 0))
    keep = rank < PROFILE
    return text[keep], gram[keep], rank[keep]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Profiles:
    """Profiles from about ``sample`` documents, or all if fewer, of each language: those with the smallest hashes.

    Rows with a null language or text take no part.  Counting runs on the
    executors; the driver gets each language's most frequent n-grams, never
    documents.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    # A hash threshold for each language takes about ``sample`` rows in one pass, with no sort; hashes don't depend on order.
    span = 1 << 30
    part = F.lit(0)
    for name, n in sizes.items():
        part = F.when(F.col(lang) == name, F.lit(min(span, int(span * sample / n) + 1))).otherwise(part)
    rows = rows.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(span)) < part).select(lang, text)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in _parts(batches, text):
            names = batch.column(0).to_pylist()
            which = sorted(set(names))
            points, owner = _points(batch.column(1).to_pylist())
            text_, gram, count = _grams(points, owner)
            language = np.array([which.index(x) for x in names])[text_.astype(np.int64)]
            for k, name in enumerate(which):
                mine = language == k
                unique, back = np.unique(gram[mine], return_inverse=True)
                sums = np.bincount(back, count[mine], len(unique)).astype(np.int64)
                into = total.setdefault(name, {})
                for g, c in zip(unique.tolist(), sums.tolist(), strict=True):
                    into[g] = into.get(g, 0) + c
        for name, into in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(into)), pa.array(into.keys(), pa.int64()), pa.array(into.values(), pa.int64())], names=["lang", "gram", "n"])

    counted = rows.mapInArrow(released(grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A rank limit, which Spark also applies before the shuffle.
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    found: dict[str, list[int]] = {}
    for row in sorted(ranked.where(F.col("place") <= PROFILE).collect(), key=lambda r: (r["lang"], r["place"])):
        found.setdefault(row["lang"], []).append(row["gram"])
    languages = sorted(found)
    union = np.array(sorted({g for x in found.values() for g in x}), np.uint64)
    ranks = np.full((len(union), len(languages)), -1, np.int32)
    for k, name in enumerate(languages):
        ranks[np.searchsorted(union, np.array(found[name], np.uint64)), k] = np.arange(len(found[name]))
    return Profiles(languages, union, ranks)


def classify(texts: list[str | None], profiles: Profiles) -> tuple[list[str], np.ndarray]:
    """Language and score of each text.

    The score is 1 less the winner's distance as a share of the largest
    distance that the document could have.
    """
    n, languages = len(texts), profiles.languages
    text, gram, rank = _ranked(*_grams(*_points(texts)))
    distance = np.zeros((n, max(len(languages), 1)))
    possible = np.bincount(text.astype(np.int64), minlength=n) * float(PROFILE)
    if len(languages) and len(text):
        at = np.minimum(np.searchsorted(profiles.grams, gram), len(profiles.grams) - 1)
        there = profiles.grams[at] == gram
        theirs = np.where(there[:, None], profiles.ranks[at], -1)
        away = np.where(theirs < 0, PROFILE, np.abs(theirs - rank[:, None]))
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        distance[text[first].astype(np.int64)] = np.add.reduceat(away, first, axis=0)
    best = distance.argmin(axis=1)  # ties: the first by name
    known = (possible > 0) & bool(languages)
    score = np.where(known, 1 - distance[np.arange(n), best] / np.maximum(possible, 1), 0.0)
    return [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred string, score double.

    ``lang_pred`` is ``und`` with score 0 for a null text, a text without a
    letter, or if no language was learned.  Columns of ``docs`` with these
    names are replaced.  Profiles have a few hundred n-grams a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, text):
            languages, score = classify(batch.column(batch.schema.get_field_index(text)).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(released(run), plus(docs, lang_pred="string", score="double"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those whose id's crc32 mod 5 isn't 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    profiles = learn(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
