"""Encoding a whole corpus with a public byte-level BPE: a minimal acyclic transducer lexicon.

The corpus is counted once; its most frequent pre-tokens (a stated number) are encoded and
compiled into a minimal acyclic automaton with shared suffixes. Word counts on the edges make
it a perfect hash, whose number selects the ids. The automaton is one file in the shared
folder that the Python workers memory-map. Pre-tokens outside it are merged exactly by rank;
results are therefore those of the tokenizer, whatever the lexicon holds.

Defined results for odd input: null and empty texts give an empty list; very long texts are
encoded whole; strings of special tokens are ordinary text; repeated rows are encoded each;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import base64
import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the tokenizer's split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _plane_split():
    """The split pattern for texts of the basic plane alone, as a standard-library pattern.

    Its letter, number and blank classes are read off the pattern's own engine, so that both
    agree; character bitmaps make it about three times as fast.
    """
    plane = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    letters, numbers, blanks = ("".join(f"{re.escape(m[0])}-{re.escape(m[-1])}" for m in regex.findall(kind + "+", plane)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    own = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]").replace(r"\S", f"[^{blanks}]").replace(r"\s", f"[{blanks}]")
    return re.compile(own.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")).findall


def pretokens(text: str) -> list[str]:
    if text.isascii() or not _ASTRAL.search(text):
        return _plane_split()(text)
    return _SPLIT.findall(text)


class Merges:
    """The exact merge of one pre-token by the ranks of a vocabulary file."""

    _loaded: dict[str, Merges] = {}

    def __init__(self, path: str):
        lines = Path(path).read_bytes().split(b"\n")
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}

    @classmethod
    def at(cls, path: str) -> Merges:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, word: bytes) -> list[int]:
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > 500:
            return self._encode_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _encode_long(self, word: bytes) -> list[int]:
        """The same merge with a heap, for runs without a blank of any length."""
        import heapq

        ranks, size = self.ranks, len(word)
        part = [word[i : i + 1] for i in range(size)]
        left, right = list(range(-1, size - 1)), [*range(1, size), -1]
        alive = [True] * size
        heap = [(r, i, i + 1, 2) for i in range(size - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, length = heapq.heappop(heap)
            if not alive[i] or not alive[j] or right[i] != j or len(part[i]) + len(part[j]) != length:
                continue
            part[i] += part[j]
            alive[j] = False
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, b, len(part[a]) + len(part[b])))
        return [ranks[p] for p, ok in zip(part, alive) if ok]


class Automaton:
    """A minimal acyclic automaton over byte strings that numbers its words."""

    NAMES = ("keys", "targets", "skips", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = (arrays[n] for n in self.NAMES)

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Automaton:
        words = sorted(entries)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        counts: list[int] = []

        def fixed(final: bool, edges: tuple) -> int:
            key = (final, edges)
            if key not in register:
                register[key] = len(states)
                states.append(key)
                counts.append(final + sum(counts[t] for _, t in edges))
            return register[key]

        # The open path: [final, edges so far] per depth; a state is fixed once no later word can change it.
        path: list[list] = [[False, []]]
        before = b""
        for word in [*words, None]:
            common = 0
            if word is not None:
                while common < min(len(word), len(before)) and word[common] == before[common]:
                    common += 1
            for depth in range(len(before), common, -1):
                final, edges = path.pop()
                path[-1][1].append((before[depth - 1], fixed(final, tuple(edges))))
            if word is None:
                break
            path += [[False, []] for _ in range(len(word) - common)]
            path[-1][0] = True
            before = word
        start = fixed(path[0][0], tuple(path[0][1]))
        last = len(states) - 1
        swap = {start: last, last: start}  # the start state is the last one already, unless two states are equal
        keys, targets, skips = [], [], []
        for s, (final, edges) in enumerate(states):
            skip = int(final)
            for byte, t in edges:
                keys.append(swap.get(s, s) * 256 + byte)
                targets.append(swap.get(t, t))
                skips.append(skip)
                skip += counts[t]
        finals = np.array([f for f, _ in states], np.int8)
        finals[[start, last]] = finals[[last, start]]
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        flat = [i for w in words for i in entries[w]]
        arrays = {
            "keys": np.array(keys, np.int64)[order],
            "targets": np.array(targets, np.int32)[order],
            "skips": np.array(skips, np.int32)[order],
            "final": finals,
            "offsets": np.concatenate([[0], np.cumsum([len(entries[w]) for w in words])]).astype(np.int32),
            "ids": np.array(flat, np.int32),
        }
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those not in the lexicon; all words walk at once."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, number = np.full(n, len(self.final) - 1, np.int64), np.zeros(n, np.int64)
        live, depth = np.flatnonzero(lengths > 0), 0
        while len(live):
            key = state[live] * 256 + flat[starts[live] + depth]
            at = np.searchsorted(self.keys, key)
            ok = self.keys[np.minimum(at, len(self.keys) - 1)] == key
            live, at = live[ok], at[ok]
            number[live] += self.skips[at]
            state[live] = self.targets[at]
            depth += 1
            done = lengths[live] == depth
            ended = live[done]
            good = self.final[state[ended]] == 1
            out[ended[good]] = number[ended[good]]
            live = live[~done]
        return out

    def outputs(self, number: int) -> tuple[int, ...]:
        return tuple(self.ids[self.offsets[number] : self.offsets[number + 1]].tolist())

    def to_bytes(self) -> bytes:
        parts = [getattr(self, n) for n in self.NAMES]
        head = np.array([x for p in parts for x in (p.dtype.itemsize, len(p))], np.int64).tobytes()
        body = b"".join(p.tobytes().ljust(-(-p.nbytes // 8) * 8, b"\0") for p in parts)
        return head + body

    @classmethod
    def mapped(cls, path: str) -> Automaton:
        raw = np.memmap(path, np.uint8, "r")
        head = np.frombuffer(raw[: 16 * len(cls.NAMES)].tobytes(), np.int64).reshape(-1, 2).tolist()
        at, arrays = 16 * len(cls.NAMES), {}
        for name, (width, count) in zip(cls.NAMES, head):
            kind = {1: np.int8, 4: np.int32, 8: np.int64}[width]
            arrays[name] = raw[at : at + width * count].view(kind)
            at += -(-width * count // 8) * 8
        return cls(arrays)


def _publish(spark, data: bytes) -> tuple[str, bool]:
    """Write data into the shared folder; (path, whether workers reach it as a file)."""
    uri = f"{runtime.shared_folder(spark)}/lexicon-{uuid.uuid4().hex}.bin"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(data)
    stream.close()
    runtime.register(uri)
    if uri.startswith("file:") or "://" not in uri:
        return "/" + uri.split(":", 1)[-1].lstrip("/"), True
    spark.sparkContext.addFile(uri)
    return uri.rsplit("/", 1)[1], False


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out():
        keys = [w.encode("utf-8", "surrogatepass") for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(pretokens(text))
        if len(counts) > 100_000:
            yield out()
            counts.clear()
    yield out()


def lexicon(texts: DataFrame, text_col: str, vocabulary: str, words: int) -> Automaton:
    """The automaton of the corpus's most frequent pre-tokens, counted over all texts.

    A histogram of the counts (eight steps to the doubling) sets the least count to keep, so
    that the final ranking receives a bounded number of words.
    """
    counts = texts.select(F.col(text_col)).mapInArrow(_counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = runtime.written(counts.where("length(word) <= 64"), "pretoken-counts")
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)  # a few hundred rows
    taken, least = 0, 0
    for r in sizes:
        taken, least = taken + r.k, r.level
        if taken >= words:
            break
    if taken > 4 * words:  # one level with very many equal counts: all above it
        least += 1
    frequent = counts.where(level >= least).orderBy(F.desc("n"), "word").limit(words).select("word").toArrow().column(0).to_pylist()
    merges = Merges.at(vocabulary)
    return Automaton.build({bytes(w): merges.encode(bytes(w)) for w in frequent})


class Encoder:
    """Encodes batches of texts: automaton first, exact merges for the rest, a bounded memo."""

    def __init__(self, place: tuple[str, bool], vocabulary: str, memo_words: int = 300_000):
        from pyspark import SparkFiles

        path, shared = place
        self.automaton = Automaton.mapped(path if shared else SparkFiles.get(path))
        self.merges = Merges.at(vocabulary)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.memo_words = memo_words

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        split = [pretokens(t) if t else [] for t in texts]
        memo = self.memo
        if len(memo) > self.memo_words:
            memo.clear()
        new = [w for w in set().union(*split) if w not in memo] if split else []
        raw = [w.encode() for w in new]
        for w, b, number in zip(new, raw, self.automaton.numbers(raw).tolist()):
            memo[w] = self.automaton.outputs(number) if number >= 0 else tuple(self.merges.encode(b))
        parts = [np.fromiter(chain.from_iterable(map(memo.__getitem__, words)), np.int32) for words in split]
        offsets = np.cumsum([0, *map(len, parts)], dtype=np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), offsets


def _encoded(place: tuple[str, bool], vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(place, vocabulary)
        for batch in batches:
            flat, offsets = encoder.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    return run


def published(rows: DataFrame, text_col: str, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k", lexicon_words: int = 50_000) -> tuple[tuple[str, bool], str]:
    """(place of the automaton, path of the vocabulary) for Encoder."""
    vocabulary = f"{tokenizers}/{name}.tiktoken"
    return _publish(rows.sparkSession, lexicon(rows, text_col, vocabulary, lexicon_words).to_bytes()), vocabulary


def encode(rows: DataFrame, id_col: str, text_col: str, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k", lexicon_words: int = 50_000) -> DataFrame:
    """id, ids ARRAY<INT>: the ids of every text, without special tokens."""
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_encoded(*published(base, "text", tokenizers, name, lexicon_words)), "id bigint, ids array<int>")
