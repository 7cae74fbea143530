"""Token counts by a compiled finite-state transducer.

A BPE vocabulary with word ends is compiled into a deterministic transducer
over bytes.  Each transition carries the number of tokens that it adds (it can
be negative, as a merge takes tokens back), so a text's count is a sum along a
path and no token is ever made.

States.  The encoding of a prefix extends the encoding of a shorter one by one
token, and a token may follow another only if the two, encoded together, stay
as they are.  So what the future depends on is, for each place where a token
that is still open may have begun: the vocabulary's trie node reached from
there, the last token before it, and the count up to it less the count now.
That tuple is a state.  The last byte of a pre-token is a symbol of its own
(it carries the word end) and has its own transitions, which end in the start
state.  States and transitions are made when a text first needs them.

Chunks of bytes.  A long pre-token is cut into segments.  A segment's map takes
a state to the state after it and the tokens added; the entries first made are
for the state that the bytes just before lead to from the start, which is nearly
always the right one, others when asked for.  Maps compose associatively, in
pairs, in any grouping.

Chunks of text.  Normalization and the pre-tokens' pattern look across bytes, so
texts are cut as characters: white space always brings the transducer to its
start state, and a chunk's map is known but for what stands before its first and
after its last white space: (head, count, tail), or the chunk itself if it holds
none.  These maps go through the same scan.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import released, slices, table, text_bytes
from tidemark.llm.pretokens import Cache, PreTokens, lower_words_narrow

#: Characters of a text beyond which it is counted in chunks, and characters of a chunk.
CHUNK = 1 << 15
#: Bytes of a segment of a pre-token, and bytes before it that foretell its entering state.
SEGMENT, BEFORE = 1 << 12, 32
ROOT = START = 0


class StateMap:
    """Entering state to (leaving state, tokens added); entries beyond ``known`` are made by ``make``."""

    def __init__(self, known: dict[int, tuple[int, int]], make: Callable[[int], tuple[int, int]]) -> None:
        self.known, self.make = known, make

    def __call__(self, state: int) -> tuple[int, int]:
        found = self.known.get(state)
        if found is None:
            found = self.known[state] = self.make(state)
        return found

    def then(self, other: StateMap) -> StateMap:
        def make(state: int) -> tuple[int, int]:
            between, first = self(state)
            last, second = other(between)
            return last, first + second

        return StateMap({state: make(state) for state in self.known}, make)


class Transducer:
    """The compiled vocabulary; ``most`` transitions are kept, then all are made anew."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, most: int = 2_000_000) -> None:
        from tidemark.llm.bpe_codec import byte_table

        self.suffix, self.most = suffix, most
        self.rank = {tuple(pair): i for i, pair in reversed(list(enumerate(merges)))}
        self.shown = byte_table()
        #: Trie of the tokens' bytes; ``inner``, ``final``: the token that ends at a node, without and with the word end.
        self.child: list[dict[int, int]] = [{}]
        self.inner: list[str | None] = [None]
        self.final: list[str | None] = [None]
        back = {c: b for b, c in enumerate(self.shown)}
        for token in vocab:
            body = token.removesuffix(suffix)
            if not body or any(c not in back for c in body):
                continue  # a special token
            node = ROOT
            for c in body:
                if back[c] not in self.child[node]:
                    self.child[node][back[c]] = len(self.child)
                    self.child.append({})
                    self.inner.append(None)
                    self.final.append(None)
                node = self.child[node][back[c]]
            (self.inner if body == token else self.final)[node] = token
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self._clear()

    def _clear(self) -> None:
        start = ((ROOT, None, 0),)
        self.states, self.numbers = [start], {start: 0}
        self.step: dict[int, tuple[int, int]] = {}
        self.end: dict[int, int] = {}

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.suffix)
        return [*body[:-1], body[-1] + token[len(body) :]]

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge the leftmost pair of the lowest rank until none is left."""
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if tuple(symbols[i : i + 2]) == best:
                    out.append(best[0] + best[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def may_follow(self, last: str | None, token: str) -> bool:
        """Whether the two stay as they are when encoded together; no last token: whether the token is its own encoding."""
        known = self.pairs.get((last, token))
        if known is None:
            if len(self.pairs) > self.most:
                self.pairs.clear()
            whole = [last, token] if last is not None else [token]
            known = self.pairs[last, token] = self.merged([s for t in whole for s in self.symbols(t)]) == whole
        return known

    def _make_step(self, state: int, byte: int) -> tuple[int, int]:
        open_, chosen = [], None
        for node, last, ahead in self.states[state]:
            node = self.child[node].get(byte)
            if node is None:
                continue
            token = self.inner[node]
            if chosen is None and token is not None and self.may_follow(last, token):
                chosen = token, ahead + 1
            open_.append((node, last, ahead))
        if chosen is None:
            raise ValueError("the vocabulary can't express a byte")
        token, added = chosen
        new = (*((n, l, a - added) for n, l, a in open_ if self.child[n]), (ROOT, token, 0))
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
        self.step[state << 8 | byte] = number, added
        return number, added

    def _make_end(self, state: int, byte: int) -> int:
        for node, last, ahead in self.states[state]:
            node = self.child[node].get(byte)
            if node is not None and (token := self.final[node]) is not None and self.may_follow(last, token):
                self.end[state << 8 | byte] = ahead + 1
                return ahead + 1
        raise ValueError("the vocabulary can't express a last byte")

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token: the sum along its path."""
        if len(self.step) > self.most:
            self._clear()
        body = word[:-1]
        if len(body) <= SEGMENT:
            state, total = self.run(START, body)
        else:
            state, total = reduced([self.map_of(body, i) for i in range(0, len(body), SEGMENT)], StateMap.then)(START)
        last = self.end.get(state << 8 | word[-1])
        return total + (last if last is not None else self._make_end(state, word[-1]))

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """The state after ``data`` and the tokens that it adds."""
        total, step = 0, self.step
        for byte in data:
            found = step.get(state << 8 | byte)
            state, added = found if found is not None else self._make_step(state, byte)
            total += added
        return state, total

    def map_of(self, word: bytes, start: int) -> StateMap:
        """The map of the segment of ``word`` that begins at ``start``."""
        data = word[start : start + SEGMENT]
        likely = self.run(START, word[max(0, start - BEFORE) : start])[0]
        return StateMap({likely: self.run(likely, data)}, lambda state: self.run(state, data))


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to the transducer's state: (head, count, tail), or only ``head`` if it has no white space."""

    head: str
    count: int = 0
    tail: str | None = None

    @classmethod
    def of(cls, chunk: str, count: Callable[[str], int]) -> ChunkMap:
        spaces = [m.start() for m in (re.search(r"\s", chunk),) if m]
        if not spaces:
            return cls(chunk)
        last = max(i for i, c in enumerate(chunk) if c.isspace()) if len(chunk) < 256 else _last_space(chunk)
        return cls(chunk[: spaces[0]], count(chunk[spaces[0] : last + 1]), chunk[last + 1 :])

    def then(self, other: ChunkMap, count: Callable[[str], int]) -> ChunkMap:
        if self.tail is None and other.tail is None:
            return ChunkMap(self.head + other.head)
        if self.tail is None:
            return ChunkMap(self.head + other.head, other.count, other.tail)
        if other.tail is None:
            return ChunkMap(self.head, self.count, self.tail + other.head)
        return ChunkMap(self.head, self.count + count(self.tail + other.head) + other.count, other.tail)

    def total(self, count: Callable[[str], int]) -> int:
        """The whole text's count, from the start state."""
        return count(self.head) + self.count + (count(self.tail) if self.tail else 0)


def _last_space(chunk: str) -> int:
    at = len(chunk)
    while not chunk[at - 1].isspace():
        at -= 1
    return at - 1


def prefix_scan(maps: list, then: Callable) -> list:
    """All prefixes' compositions by recursive doubling; ``then`` must be associative."""
    out, reach = list(maps), 1
    while reach < len(out):
        out = [then(out[i - reach], x) if i >= reach else x for i, x in enumerate(out)]
        reach *= 2
    return out


def reduced(maps: list, then: Callable):
    """The last prefix of the scan alone: the up-sweep, in pairs."""
    while len(maps) > 1:
        maps = [then(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class Counter:
    """Counts as the tokenizers library does for a BPE file with word ends; one per worker process."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or (split["behavior"], split["invert"]) != ("Removed", True) or not model["end_of_word_suffix"]:
            raise ValueError("only vocabularies with word ends, lower case and dropped white space are compiled")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges, model["end_of_word_suffix"])
        self.cutter = PreTokens(lower_words_narrow(), split["pattern"]["Regex"])
        if not all(t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError("a special token is expected to begin with <|")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.library = Tokenizer.from_file(path)
        count = self.transducer.count
        self.words = Cache(lambda new: [count(w.encode()) for w in new])

    def _words(self, text: str) -> list[str] | None:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character by itself: no final sigma
        return self.cutter.cut(text.lower())

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        words = self._words(text)
        if words is None:  # characters on whose class or case the engines differ
            return len(self.library.encode(text, add_special_tokens=False).ids)
        self.words.fill(words)
        return sum(map(self.words.__getitem__, words))

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string is one token, as is the library's default."""
        parts = self.special.split(text)
        return sum(map(self.part, parts)) + len(parts) - 1

    def part(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.plain(text)
        maps = [ChunkMap.of(text[i : i + CHUNK], self.plain) for i in range(0, len(text), CHUNK)]
        return reduced(maps, lambda a, b: a.then(b, self.plain)).total(self.plain)

    def counts(self, texts: list[str]) -> list[int]:
        """Counts of many texts; the short ones' new pre-tokens are counted together first."""
        short: list[tuple[int, list[str]]] = []
        out = [0] * len(texts)
        for i, text in enumerate(texts):
            if text and len(text) <= CHUNK and "<|" not in text and (words := self._words(text)) is not None:
                short.append((i, words))
            elif text:
                out[i] = self.count(text)
        self.words.fill(set().union(*(words for _, words in short)))
        get = self.words.__getitem__
        for i, words in short:
            out[i] = sum(map(get, words))
        return out

    def running(self, text: str) -> list[int]:
        """Counts of the prefixes that end with each chunk; a special string doesn't split chunks here."""
        maps = [ChunkMap.of(text[i : i + CHUNK], self.count) for i in range(0, len(text), CHUNK)]
        return [m.total(self.count) for m in prefix_scan(maps, lambda a, b: a.then(b, self.count))]


_COUNTERS: dict[str, Counter] = {}


def worker_counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) for each row of ``docs``.

    ``path`` names a tokenizers file that every worker can read.  No special
    token is added; texts are neither cut nor padded; a null text counts as
    empty.  Repeated rows each give a row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path)
        for batch in slices(batches, text):
            _, offsets = text_bytes(batch.column(1))
            n = counter.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(released(run), f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than 2048 tokens) of every document."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
