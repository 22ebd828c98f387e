"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The corpus's frequent words are compiled, with their token ids, into a deterministic
automaton whose equal suffixes are shared. Its transitions carry numbers that add up to
a word's place in the table of ids. The automaton is one block of bytes, memory-mapped by
each worker. Words that it doesn't hold are merged exactly, pair of least rank and leftmost
first, so that the lexicon changes the speed and never a result.

Defined cases: a null text is an empty text, with no tokens; special tokens' strings in a
text are their ids, as the tokenizers library has it by default; repeated rows each give
their row; an empty table gives none; other columns are ignored. Characters newer than
Python's Unicode tables may split otherwise than in the library.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices, trimmed

#: Frequent words in the automaton, at most.
LEXICON_WORDS = 131_072
#: Words that a task counts before it hands on the most frequent of them.
COUNTED_WORDS = 400_000
#: Encoded words that a worker remembers between texts.
REMEMBERED_WORDS = 300_000
#: Texts that are encoded side by side: their characters and rows.
CHUNK_CHARS, CHUNK_ROWS = 1_000_000, 256
#: Words beyond so many symbols are merged one by one with a heap.
LONG_WORD = 48
END = "</w>"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


@dataclass
class Tokenizer:
    """Merges and tokens of a word-level BPE file with an end-of-word suffix, and its split pattern."""

    tokens: list[str]
    special: dict[str, int]
    pattern: str
    inner: np.ndarray  # id of a byte inside a word
    final: np.ndarray  # id of a byte that ends a word
    keys: np.ndarray  # left id << 32 | right id, sorted
    ranks: np.ndarray
    made: np.ndarray

    @staticmethod
    def load(path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]], spec["decoder"], model["end_of_word_suffix"]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None, END):
            raise ValueError(f"unsupported tokenizer: {kinds}")
        vocab = model["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in [*vocab.items(), *special.items()]:
            tokens[i] = t
        chars = byte_characters()
        pairs = [(vocab[a] << 32 | vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(model["merges"])]
        pairs.sort()
        keys, ranks, made = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        return Tokenizer(tokens, special, pattern, np.array([vocab[c] for c in chars]), np.array([vocab[c + END] for c in chars]), keys, ranks, made)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (beyond all ranks: none) and merged id of pairs."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], 1 << 40), np.where(hit, self.made[at], -1)

    @functools.cached_property
    def merges(self) -> dict[int, tuple[int, int]]:
        return {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.made.tolist(), strict=True)}

    def merge_long(self, word: bytes) -> list[int]:
        ids = [*self.inner[list(word[:-1])].tolist(), int(self.final[word[-1]])]
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap: list = []

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (got := self.merges.get(ids[i] << 32 | ids[after[i]])):
                heapq.heappush(heap, (got[0], i, ids[i], ids[after[i]], got[1]))

        for i in range(len(ids)):
            push(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            if ids[i] != left or after[i] < 0 or ids[after[i]] != right:
                continue
            gone = after[i]
            ids[i], ids[gone] = new, -1
            after[i] = after[gone]
            if after[gone] >= 0:
                before[after[gone]] = i
            after[gone] = -1
            push(before[i])
            push(i)
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of words: those of about one length are merged side by side, very long ones by themselves."""
        out: list = [None] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self.merge_long(w)
            else:
                groups.setdefault(-(-len(w) // 4), []).append(i)
        for at in groups.values():
            for i, got in zip(at, self._merge_grid([words[i] for i in at]), strict=True):
                out[i] = got
        return out

    def _merge_grid(self, words: list[bytes]) -> list[list[int]]:
        """In each round every word takes its best pair: the least rank, leftmost first."""
        none, nothing = 1 << 40, (1 << 31) - 1
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(sizes)
        width = int(sizes.max()) + 1
        grid = np.full((len(words), width), nothing, dtype=np.int64)
        ids = self.inner[data]
        ids[ends - 1] = self.final[data[ends - 1]]
        grid[np.arange(width) < sizes[:, None]] = ids
        rank, made = np.full(grid.shape, none), np.full(grid.shape, -1)
        rank[:, :-1], made[:, :-1] = self.pair(grid[:, :-1], grid[:, 1:])
        done, rows = [np.zeros((0, width), np.int64)], [np.zeros(0, np.int64)]
        live = np.arange(len(words))
        # Each round closes the gap that the merge leaves, so that neighbours stay side by side.
        while True:
            best = rank.argmin(axis=1)
            r = np.arange(len(live))
            go = rank[r, best] < none
            done.append(np.pad(grid[~go], ((0, 0), (0, width - grid.shape[1])), constant_values=nothing))
            rows.append(live[~go])
            if not go.any():
                break
            live, best, grid, rank, made = live[go], best[go], grid[go], rank[go], made[go]
            r = np.arange(len(live))
            grid[r, best] = made[r, best]
            keep = np.arange(grid.shape[1] - 1)
            keep = keep + (keep > best[:, None])
            grid, rank, made = (np.take_along_axis(x, keep, 1) for x in (grid, rank, made))
            if grid.shape[1] == 1:
                grid, rank, made = (np.pad(x, ((0, 0), (0, 1)), constant_values=v) for x, v in ((grid, nothing), (rank, none), (made, -1)))
            last = grid.shape[1] - 1
            for at, ok in ((best - 1, best > 0), (best, best < last)):
                i, j = r[ok], at[ok]
                rank[i, j], made[i, j] = self.pair(grid[i, j], grid[i, j + 1])
        ended, place = np.concatenate(done), np.concatenate(rows)
        out: list = [None] * len(words)
        for i, row in zip(place.tolist(), ended.tolist(), strict=True):
            out[i] = [x for x in row if x != nothing]
        return out


class Lexicon:
    """A minimal acyclic automaton in one buffer: transitions by state and byte, with additive outputs, then the ids."""

    def __init__(self, buffer: bytes | mmap.mmap):
        n, words, ids = np.frombuffer(buffer, dtype=np.int64, count=3).tolist()
        at, parts = 24, []
        for count in (n, n, n, n, words + 1, ids):
            parts.append(np.frombuffer(buffer, dtype=np.int64, count=count, offset=at))
            at += 8 * count
        self.keys, self.target, self.add, self.final, self.offsets, self.ids = parts

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> bytes:
        """Add the words in order; once a state's last child is complete, an equal registered state replaces it."""
        order = sorted(words)
        register: dict = {}
        path: list[tuple[bool, list]] = [(False, [])]
        nodes: list[tuple[bool, tuple]] = []

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                key = (final, tuple(edges))
                if key not in register:
                    register[key] = len(nodes)
                    nodes.append(key)
                parent = path[-1][1]
                parent[-1] = (parent[-1][0], register[key])

        last = b""
        for w in order:
            same = next((i for i, (a, b) in enumerate(zip(w, last, strict=False)) if a != b), min(len(w), len(last)))
            close(same)
            for byte in w[same:]:
                path[-1][1].append((byte, -1))
                path.append((False, []))
            path[-1] = (True, path[-1][1])
            last = w
        close(0)
        nodes.append((path[0][0], tuple(path[0][1])))
        below = [0] * len(nodes)
        for i, (final, edges) in enumerate(nodes):  # children stand before their parents
            below[i] = final + sum(below[t] for _, t in edges)
        rename = {len(nodes) - 1: 0} | {i: i + 1 for i in range(len(nodes) - 1)}
        rows = []
        for i, (final, edges) in enumerate(nodes):
            add = int(final)
            for byte, t in edges:
                rows.append((rename[i] << 8 | byte, rename[t], add, int(nodes[t][0])))
                add += below[t]
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 4)
        offsets = np.concatenate([[0], np.cumsum([len(words[w]) for w in order])]).astype(np.int64)
        ids = np.array([x for w in order for x in words[w]], dtype=np.int64)
        head = np.array([len(rows), len(order), len(ids)], dtype=np.int64)
        return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, *table.T, offsets, ids))

    @staticmethod
    def mapped(buffer: bytes) -> Lexicon:
        """The automaton in a file without a name, mapped into memory."""
        with tempfile.TemporaryFile() as f:
            f.write(buffer)
            f.flush()
            return Lexicon(mmap.mmap(f.fileno(), len(buffer), access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the lexicon, or -1; all words walk side by side."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(words) or not len(self.keys):
            return out
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        start = np.cumsum(sizes) - sizes
        live, state, total, final = np.flatnonzero(sizes > 0), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            key = state[live] << 8 | data[start[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            state[live], final[live] = self.target[at], self.final[at]
            total[live] += self.add[at]
            step += 1
            done = live[(sizes[live] == step) & (final[live] == 1)]
            out[done] = total[done]
            live = live[sizes[live] > step]
        return out


#: Characters that the split of the basic plane doesn't know.
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def basic_split(pattern: str) -> re.Pattern | None:
    """The pattern with the classes in its brackets written out for the basic plane, which the plain engine runs twice as fast; None where more is escaped."""
    every = "".join(map(chr, range(0x10000)))
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        spans = [(m.start(), m.end() - 1) for m in regex.finditer(f"{name}+", every, flags=regex.V0)]
        written = "".join(f"\0{a:04x}-\0{b:04x}" for a, b in spans)
        pattern = re.sub(r"\[[^\]]*\]", lambda m, n=name, w=written: m[0].replace(n, w), pattern)
    return None if "\\" in pattern else re.compile(pattern.replace("\0", "\\u"))


class Encoder:
    """Splits texts into words and encodes them through a lexicon, merging those it doesn't hold."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon | None = None):
        self.tokenizer, self.lexicon = tokenizer, lexicon
        self.split_any = regex.compile(tokenizer.pattern, flags=regex.V0).findall
        basic = basic_split(tokenizer.pattern)
        self.split = basic.findall if basic else self.split_any
        self.special = regex.compile("|".join(map(regex.escape, tokenizer.special))) if tokenizer.special else None
        self.names, self.numbers = pa.array(tokenizer.tokens, pa.string()), pa.array(map(str, range(len(tokenizer.tokens))), pa.string())
        #: What words encode to: ids, and tokens, as text.
        self.seen: dict[str, str] = {}
        self.shown: dict[str, str] = {}

    def words(self, text: str) -> list[str]:
        """Words of a text; a special token's string is a word of its own, marked by a null character before it."""
        if self.special is not None and "<|" in text and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += [*self.words_of_part(text[at : m.start()]), "\0" + m[0]]
                at = m.end()
            return out + self.words_of_part(text[at:])
        return self.words_of_part(text)

    def words_of_part(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Each character by itself: no rule for a sigma at a word's end.
            text = "σ".join(x.lower() for x in text.split("Σ"))
            return (self.split_any if _BEYOND.search(text) else self.split)(text)
        return self.split(text.lower())

    def flat_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids of all words one after the other."""
        data = [w.encode() for w in words]
        at = self.lexicon.find(data) if self.lexicon is not None else np.full(len(words), -1, dtype=np.int64)
        held, rest = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        merged = self.tokenizer.merge([data[i] for i in rest.tolist()])
        sizes, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[rest] = [len(x) for x in merged]
        start[rest] = np.cumsum(sizes[rest]) - sizes[rest]
        ids = np.fromiter(chain.from_iterable(merged), np.int64)
        if len(held):
            offsets = self.lexicon.offsets
            start[held] = offsets[at[held]]
            sizes[held] = offsets[at[held] + 1] - start[held]
            start[rest] += len(self.lexicon.ids)
        place = np.arange(sizes.sum()) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
        if not len(held):
            return sizes, ids[place]
        out, own = np.empty(len(place), np.int64), place < len(self.lexicon.ids)
        out[own], out[~own] = self.lexicon.ids[place[own]], ids[place[~own] - len(self.lexicon.ids)]
        return sizes, out

    def ids_of(self, words: list[str]) -> list[list[int]]:
        sizes, ids = self.flat_ids(words)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(words) else []

    def learn(self, words: set[str]) -> None:
        """Remember what new words encode to, ids and tokens as text."""
        new = words.difference(self.seen)
        if len(self.seen) + len(new) > REMEMBERED_WORDS:
            self.seen.clear()
            self.shown.clear()
            new = words
        special = [w for w in new if w[0] == "\0" and w[1:] in self.tokenizer.special]
        plain = list(new.difference(special) if special else new)
        for a in range(0, len(plain), 20_000):
            part = plain[a : a + 20_000]
            sizes, ids = self.flat_ids(part)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            for kept, texts in ((self.seen, self.numbers), (self.shown, self.names)):
                kept.update(zip(part, pc.binary_join(pa.ListArray.from_arrays(offsets, texts.take(pa.array(ids))), " ").to_pylist(), strict=True))
        for w in special:
            self.seen[w], self.shown[w] = str(self.tokenizer.special[w[1:]]), w[1:]

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of ids, the ids and the decoded text, ids and tokens joined by a space."""
        for a in range(0, len(texts), 256):
            split = [self.words(t or "") for t in texts[a : a + 256]]
            self.learn(set().union(*split))
            for words in split:
                ids = " ".join(map(self.seen.__getitem__, words))
                yield (ids.count(" ") + 1 if ids else 0), ids, " ".join(map(self.shown.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in next(self.encode_batch([text]))[1].split()]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.tokenizer.tokens[i] for i in ids)


def frequent_words(docs: DataFrame, tokenizer: Tokenizer, most: int = LEXICON_WORDS) -> list[str]:
    """About the most frequent words: each task hands on the most frequent of every bounded table of counts that it fills."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        encoder, held = Encoder(shared.value), Counter()

        def part():
            top = held.most_common(most)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(encoder.words(text.as_py() or ""))
                if len(held) > COUNTED_WORDS:
                    yield part()
        yield part()

    top = docs.select("text").mapInArrow(trimmed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(most)
    return [r.word for r in top.select("word").collect()]


def compile_lexicon(tokenizer: Tokenizer, words: list[str]) -> bytes:
    plain = [w for w in dict.fromkeys(words) if w and not w.startswith("\0")]
    ids = Encoder(tokenizer).ids_of(plain)
    return Lexicon.build({w.encode(): i for w, i in zip(plain, ids, strict=True)})


def encode(docs: DataFrame, tokenizer: Tokenizer, lexicon: bytes, columns: list[str], with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to ``columns``; with ``with_ids`` also ids, with ``with_text`` the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, lexicon))
    taken = docs.select(*columns, F.col("text").alias("_text"))
    schema = taken.drop("_text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    for name, shown in (("ids", with_ids), ("decoded", with_text)):
        schema = schema.add(name, "string") if shown else schema

    def run(batches):
        encoder = Encoder(shared.value[0], Lexicon.mapped(shared.value[1]))
        for batch in batches:
            for part in text_slices(batch, batch.num_columns - 1, CHUNK_CHARS, CHUNK_ROWS):
                n, hashes, shown = [], ([], []), ([], [])
                for k, *both in encoder.encode_batch(part.column(part.num_columns - 1).to_pylist()):
                    n.append(k)
                    for i, x in enumerate(both):
                        hashes[i].append(hashlib.sha256(x.encode()).hexdigest())
                        if (with_ids, with_text)[i]:
                            shown[i].append(x)
                arrays = [*part.columns[:-1], pa.array(n, pa.int64()), *[pa.array(x, pa.string()) for x in hashes], *[pa.array(x, pa.string()) for x, asked in zip(shown, (with_ids, with_text), strict=True) if asked]]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return taken.mapInArrow(trimmed(run), schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, columns: list[str], path: str | None = None, with_ids: bool = False) -> DataFrame:
    tokenizer = Tokenizer.load(path or tokenizer_path())
    return encode(docs, tokenizer, compile_lexicon(tokenizer, frequent_words(docs, tokenizer)), columns, with_ids)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op6_bpe": op6}
ORACLES: dict[str, str] = {}
