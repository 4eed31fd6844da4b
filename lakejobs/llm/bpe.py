"""Byte-level BPE encoding and decoding with a lexicon of the corpus's frequent words.

A first pass counts the words of all documents; the most frequent ones, with their ids, are compiled
into a minimal automaton (:mod:`lakejobs.llm.lexicon`) that each worker memory-maps. A word that is
not in it is merged exactly by the tokenizer's ranks, so ids never depend on which words are in it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.lexicon import Lexicon, compile_lexicon
from lakejobs.llm.tables import kept, lean, with_field
from lakejobs.llm.textbytes import slices, text_bytes

LEXICON_WORDS = 200_000  # words in the lexicon at most
COUNTER_WORDS = 300_000  # distinct words a task counts before it hands them on
MEMO_WORDS = 300_000  # words a worker remembers at most, next to those of the texts at hand

# The word pattern of byte-level BPE over characters up to U+00FF; others are mapped to one of the same class.
_L, _N, _S = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc\xbd\xbe", rb"\t-\r \x85\xa0"
_WORD = re.compile(
    rb" ?[" + _L + rb"]+|'(?:[stmd]|re|ve|ll)| ?[" + _N + rb"]+| ?[^" + _L + _N + _S + rb"]+|[" + _S + rb"]+(?![^" + _S + rb"])|[" + _S + rb"]+"
)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and bytes of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        byte = {letter: i for i, letter in enumerate(_byte_letters())}
        raw = lambda token: bytes(byte[c] for c in token)
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ids = ids
        self.ranks = {(raw(a), raw(b)): rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.letters = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        known = sorted((ids[a] << 32 | ids[b], rank, ids[a + b]) for (a, b), rank in self.ranks.items())
        self.pairs = tuple(np.array(column, np.int64) for column in zip(*known, (1 << 62, _NONE, 0)))  # the last is no pair
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.split = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or "(?!)")

    def merge(self, word: bytes) -> list[int]:
        """The ids of ``word``: the pair of lowest rank, leftmost first, is merged as long as there is one."""
        ranks = self.ranks
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 64:
            return self._merge_long(parts)
        order = [ranks.get(p, _NONE) for p in zip(parts, parts[1:])]
        while order and (best := min(order)) != _NONE:
            at = order.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = ranks.get((parts[at - 1], parts[at]), _NONE)
            if at < len(order):
                order[at] = ranks.get((parts[at], parts[at + 1]), _NONE)
        return [self.ids[p] for p in parts]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of many words of at most 64 bytes, each as packed little-endian integers, merged side by side as :meth:`merge` does."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {8: [], 16: [], 32: [], 64: []}
        for i, word in enumerate(words):
            by_width[max(8, 1 << (len(word) - 1).bit_length())].append(i)
        for width, places in by_width.items():
            for a in range(0, len(places), _SIDE_BY_SIDE):
                some = places[a : a + _SIDE_BY_SIDE]
                if len(some) < width:  # not worth the rounds
                    found = [np.array(self.merge(words[i]), "<u4").tobytes() for i in some]
                else:
                    found = self._merged([words[i] for i in some], width)
                for i, ids in zip(some, found):
                    out[i] = ids
        return out

    def _merged(self, words: list[bytes], width: int) -> list[bytes]:
        """In each round every word that has a pair left merges its pair of lowest rank, the leftmost of equal ones."""
        pairs, ranks, results = self.pairs
        live = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        parts = np.where(np.arange(width + 1) < live[:, None], np.pad(self.letters[data], ((0, 0), (0, 1))), -1)  # -1 fills up

        def look_up(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            wanted = left << 32 | right
            at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
            return np.where(pairs[at] == wanted, ranks[at], _NONE), results[at]

        rank, result = look_up(parts[:, :-1], parts[:, 1:])
        done, row = [b""] * len(words), np.arange(len(words))
        while True:
            every, best = np.arange(len(row)), rank.argmin(1)
            more = rank[every, best] != _NONE
            if not more.all():
                ended = ~more
                for i, ids, n in zip(row[ended].tolist(), parts[ended].astype("<u4"), live[ended].tolist()):
                    done[i] = ids[:n].tobytes()
                if not more.any():
                    return done
                parts, rank, result, row, live, best = (x[more] for x in (parts, rank, result, row, live, best))
                every = np.arange(len(row))
            merged = result[every, best]
            # What follows the pair moves one place to the left.
            for table, start in ((parts, best + 1), (rank, best), (result, best)):
                after = np.arange(table.shape[1] - 1) >= start[:, None]
                np.copyto(table[:, :-1], table[:, 1:].copy(), where=after)
            rank[:, -1], parts[every, best] = _NONE, merged
            live -= 1
            parts[every, live] = -1
            for left in (np.maximum(best - 1, 0), best):
                rank[every, left], result[every, left] = look_up(parts[every, left], parts[every, left + 1])

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap over linked parts, for words of any length."""
        ranks, live = self.ranks, list(parts)
        after = [*range(1, len(live)), -1]
        before = [-1, *range(len(live) - 1)]
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(live, live[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] == a else -1
            if j < 0 or live[j] != b:
                continue
            live[i], live[j] = a + b, b""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := (live[x], live[y])) in ranks:
                    heapq.heappush(heap, (ranks[p], x, *p))
        return [self.ids[p] for p in live if p]


_NONE = 1 << 60
_SIDE_BY_SIDE = 2_000  # words that are merged side by side


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    """One per worker, kept for its next task."""
    return Vocabulary(path)


class Splitter:
    """Words of a text. Characters above U+00FF take their class from the tokenizer's own tables."""

    def __init__(self, path: str):
        self.path, self.probe, self.classes = path, None, {}

    def _class(self, char: str) -> str:
        if self.probe is None:
            from tokenizers import Tokenizer

            self.probe = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        joins = lambda sample: len(self.probe(sample + char)) == 1
        return "a" if joins("a") else "0" if joins("1") else "!" if joins("!") else "\t"

    def latin(self, text: str) -> list[bytes] | None:
        """The words in Latin-1, or None if the text has other characters."""
        try:
            return _WORD.findall(text.encode("latin-1"))
        except UnicodeEncodeError:
            return None

    def other(self, text: str) -> list[str]:
        for char in set(text):
            if char > "\xff" and char not in self.classes:
                self.classes[char] = self._class(char)
        shape = text.translate({ord(c): k for c, k in self.classes.items()}).encode("latin-1")
        return [text[m.start() : m.end()] for m in _WORD.finditer(shape)]


class Encoder:
    """Ids of texts as packed little-endian integers; what it remembers is bounded."""

    def __init__(self, path: str, block: bytes | None):
        self.vocabulary, self.splitter = _vocabulary(path), Splitter(path)
        self.lexicon = Lexicon.mapped(block) if block else None
        self.latin, self.other = _Memo(self, "latin-1"), _Memo(self, None)

    def word(self, word: bytes) -> bytes:
        ids = self.lexicon.get(word) if self.lexicon else None
        return ids if ids is not None else np.array(self.vocabulary.merge(word), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words that are not remembered are looked up and merged together."""
        split = [self._split(text) for text in texts]
        for memo in (self.latin, self.other):
            memo.learn(set().union(*[found for parts in split for kind, found in parts if kind is memo]))
        ids = [b"".join([found if memo is None else b"".join(map(memo.__getitem__, found)) for memo, found in parts]) for parts in split]
        self.latin.forget()
        self.other.forget()
        return ids

    def _split(self, text: str) -> list[tuple["_Memo | None", list | bytes]]:
        """Words with the memo they belong to, and ids of special tokens."""
        out, at = [], 0
        for special in self.vocabulary.split.finditer(text):
            out.append(self._plain(text[at : special.start()]))
            out.append((None, self.vocabulary.special[special.group()].to_bytes(4, "little")))
            at = special.end()
        out.append(self._plain(text[at:] if at else text))
        return out

    def _plain(self, text: str) -> tuple["_Memo", list]:
        found = self.splitter.latin(text)
        return (self.latin, found) if found is not None else (self.other, self.splitter.other(text))


class _Memo(dict):
    """Ids of words. When there are too many, only those of the lexicon stay."""

    def __init__(self, encoder: Encoder, charset: str | None):
        super().__init__()
        self.encoder, self.charset, self.rare, self.long = encoder, charset, [], []

    def learn(self, words: set) -> None:
        new = list(words.difference(self))
        raw = [w.decode(self.charset).encode() if self.charset else w.encode() for w in new]
        merge = []
        for word, letters, ids in zip(new, raw, self.encoder.lexicon.get_all(raw) if self.encoder.lexicon else [None] * len(new)):
            if ids is not None:
                self[word] = ids
            elif len(letters) > 64:
                self[word] = self.encoder.word(letters)
                self.long.append(word)
            else:
                merge.append((word, letters))
        self.update(zip([w for w, _ in merge], self.encoder.vocabulary.merge_all([raw for _, raw in merge])))
        self.rare += [w for w, _ in merge]

    def forget(self) -> None:
        """What is too long or too much to be remembered."""
        for word in self.long:
            del self[word]
        self.long = []
        if len(self) > MEMO_WORDS:
            for word in self.rare:
                del self[word]
            self.rare = []
        if len(self) > MEMO_WORDS:
            self.clear()


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; a task adds up its own words before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, vocabulary = Splitter(tokenizer), _vocabulary(tokenizer)
        latin, other = Counter(), Counter()

        def drain():
            words = [w.decode("latin-1") for w in latin] + list(other)
            counts = [*latin.values(), *other.values()]
            latin.clear()
            other.clear()
            for i in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 20_000], pa.string()), pa.array(counts[i : i + 20_000], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for part in vocabulary.split.split(text.as_py() or ""):
                    found = splitter.latin(part)
                    latin.update(found) if found is not None else other.update(splitter.other(part))
                if len(latin) + len(other) > COUNTER_WORDS:
                    yield from drain()
        yield from drain()

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, words: int = LEXICON_WORDS) -> list[str]:
    """The words above the least count that at most ``words`` words reach; at most that many come to the driver.

    Words that occur once are of no use and left out.
    """
    counts = kept(counts.where("n > 1"))
    least = F.floor(F.log2("n") * 8)  # counts in steps of an eighth of a power of two: a few hundred rows
    steps = counts.groupBy(least.alias("step")).count().orderBy(F.desc("step")).collect()
    total, floor = 0, None
    for row in steps:
        total += row["count"]
        if total > words:
            break
        floor = row["step"]
    if floor is None:
        return []
    return counts.where(least >= floor).select("word").toArrow().column("word").to_pylist()


def corpus_lexicon(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS, text_col: str = "text") -> bytes:
    """The compiled lexicon of the corpus's frequent words; its size is bounded by ``words``."""
    vocabulary = Vocabulary(tokenizer)
    chosen = [w.encode() for w in frequent_words(word_counts(docs, tokenizer, text_col), words)]
    return compile_lexicon({w: vocabulary.merge(w) for w in chosen if len(w) <= 64})


_ENCODERS: dict = {}


def encode(docs: DataFrame, tokenizer: str, lexicon: bytes | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with their ids packed as little-endian unsigned 32-bit integers in ``ids_col``.

    Whole texts; null is empty and has no ids. Special tokens' strings in a text are those tokens, none
    are added. All columns pass through; a column that is called like ``ids_col`` is replaced.
    """
    docs = docs.drop(ids_col)
    return docs.mapInArrow(lean(_encoding(docs, tokenizer, lexicon, text_col, ids_col)), with_field(docs, ids_col, "binary"))


def _encoding(docs: DataFrame, tokenizer: str, lexicon: bytes | None, text_col: str, ids_col: str):
    block = docs.sparkSession.sparkContext.broadcast(lexicon) if lexicon else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = block.value if block else b""
        key = (tokenizer, len(lexicon), hash(lexicon))
        encoder = _ENCODERS.get(key)
        if encoder is None:  # one per worker, kept for its next task
            _ENCODERS.clear()
            encoder = _ENCODERS[key] = Encoder(tokenizer, lexicon)
        for batch in batches:
            texts = batch.column(text_col)
            _, offsets = text_bytes(texts)
            for a, b in slices(offsets):
                ids = encoder.encode_all([t or "" for t in texts.slice(a, b - a).to_pylist()])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*part.schema.names, ids_col])

    return run


def _decoded(ids: pa.Array, tokens: pa.Array) -> pa.Array:
    """The texts of packed ids: the bytes of all their tokens one after the other, cut where a text ends."""
    flat = pa.concat_arrays([ids.fill_null(b"")])
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    numbers = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u4")
    taken = tokens.take(pa.array(numbers))
    starts = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
    cuts = starts[(ends - ends[0]) // 4].astype(np.int32)
    joined = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(cuts), taken.buffers()[2] or pa.py_buffer(b"")])
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:  # broken UTF-8 in one of them
        return pa.array([t.as_py().decode("utf-8", "replace") for t in joined], pa.string())


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``text_col``; null ids give empty text, broken UTF-8 U+FFFD."""
    encoded = encoded.drop(text_col)
    return encoded.mapInArrow(lean(_decoding(tokenizer, ids_col, text_col)), with_field(encoded, text_col, "string"))


def encode_and_decode(
    docs: DataFrame, tokenizer: str, lexicon: bytes | None = None, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded"
) -> DataFrame:
    """``docs`` as :func:`encode` and then :func:`decode` give them, by one worker per task instead of two."""
    docs = docs.drop(ids_col, decoded_col)
    encoded, decoded = _encoding(docs, tokenizer, lexicon, text_col, ids_col), _decoding(tokenizer, ids_col, decoded_col)
    schema = with_field(docs, ids_col, "binary").add(decoded_col, "string")
    return docs.mapInArrow(lean(lambda batches: decoded(encoded(batches))), schema)


def _decoding(tokenizer: str, ids_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(_vocabulary(tokenizer).bytes, pa.binary())
        for batch in batches:
            ids = batch.column(ids_col)
            offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
            for a, b in slices(offsets.astype(np.int64)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column(ids_col), tokens)], [*part.schema.names, text_col])

    return run
