"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens. It begins as one state with a loop for every base symbol, which accepts
every spelling of a word. The merges are applied in order; the gadget of the merge (a, b) -> c

* adds an arc c beside every path a b: from where a leaves to where b arrives, and
* sends all arcs a to a copy of their target that has lost its arc b, so that a b is not read any more.

Each word keeps exactly one accepted path, its BPE tokenization. All arcs with one label share a
target, so a state is named by a token, and every copy differs from its original by one lost
arc. The tables are therefore: the lost arc of each gadget with its time, the label whose arcs c copied
(``left``, as c leaves wherever a left at that time) and the label whose target c took over
(``right``). Whether a state has an arc follows from these by walking back over the copies.

Encoding is a forward pass over the arcs that spell the word: each position is reached by at
most one accepted path. All new words of a batch are passed at once. Decoding emits the labels of
the arcs.

Defined cases: null text counts as empty and gives no ids; special tokens written out in a
text become their ids; rows are independent, so repeated rows and empty tables need no care.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from copy import copy
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildup.llm.common import make_room, prepare, worker_cache
from buildup.llm.lattice import HashTable, Pieces, by_step, spread

CACHE_WORDS = 200_000  # in each of two generations
CACHED_LENGTH = 48  # longer words are not kept between batches
WORDS_AT_ONCE = 32_768  # passed through the automaton together; bounds a worker's memory
LONG = 128  # bytes; longer words are read one by one
SPAN = 1 << 15  # bytes of a long word whose arcs are looked up at once
NEVER = 1 << 40
ASKED = 1 << 18  # slots for answers about arcs, a power of two

# what bytes are to the split; a word with a byte of the last kind is left whole
SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""  # what the split on bytes does
ENDS_1 = [ord(c) for c in "stmd"]
ENDS_2 = [256 * ord(c) + ord(d) for c, d in ("re", "ve", "ll")]
MARK = b"\xff"  # no byte of any text
# white space beyond ASCII by its length in bytes, as little-endian integers, and the bytes it begins with
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
WIDE = {width: [int.from_bytes(c, "little") for c in _WIDE if len(c) == width] for width in (2, 3)}
WIDE_LEAD = np.isin(np.arange(256), [c[0] for c in _WIDE])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class Automaton:
    """Token automaton of a BPE vocabulary with word ends."""

    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"]:
            raise ValueError("expected a BPE vocabulary with word ends and no decoder")
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split":
            raise ValueError("expected NFC, white space and lower case, then a split")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.size = 1 + max([*vocab.values(), *[t["id"] for t in spec["added_tokens"]]])
        self.labels = [""] * self.size
        for token, i in vocab.items():
            self.labels[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.labels[i] = token
        self.pattern = split["pattern"]["Regex"]
        codes: dict[int, tuple[int, ...]] = {}
        for b, letter in enumerate(byte_letters()):
            codes[vocab[letter]] = (b,)
            codes[vocab[letter + suffix]] = (256 + b,)
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.born = np.full(self.size, NEVER, np.int64)
        lost = np.empty((len(model["merges"]), 2), np.int64)
        for time, (x, y) in enumerate(model["merges"]):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            # the gadget: c leaves with a, arrives with b; the new target of a lacks b
            self.left[c], self.right[c], self.born[c] = a, b, time
            lost[time] = a, b
            codes[c] = codes[a] + codes[b]
        self.lost = HashTable(lost[:, 0] * self.size + lost[:, 1], np.arange(len(lost)))
        # a merge whose own path was cut before its time adds no arc
        c = np.flatnonzero(self.born < NEVER)
        dead = dict.fromkeys(c[~self.has_arc(self.left[c], self.right[c], self.born[c])].tolist())
        for i in sorted(c.tolist(), key=lambda i: self.born[i]):
            if int(self.left[i]) in dead or int(self.right[i]) in dead:
                dead[i] = None
        self.asked: np.ndarray | None = None
        self.pieces = Pieces({i: s for i, s in codes.items() if i not in dead}, 512)

    def has_arc(self, state: np.ndarray, token: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether the state reached by ``state`` has an arc ``token`` (before the merge ``until``)."""
        out = np.ones(len(state), bool)
        row = np.arange(len(state))
        own = np.full(len(state), NEVER) if until is None else until
        own = own.copy()
        while len(row):
            r, u, limit = row, token[row], np.full(len(row), NEVER)
            s, before = state, own
            while len(r):
                time = self.lost.get(s * self.size + u, NEVER)
                # lost by a copy made before this state was taken over and before that arc was copied
                cut = (time < before) & (time <= limit) & (time < NEVER)
                out[r[cut]] = False
                limit, u = np.minimum(limit, self.born[u]), self.left[u]
                on = (u >= 0) & ~cut
                r, u, limit, s, before = r[on], u[on], limit[on], s[on], before[on]
            own, state = np.minimum(own, self.born[state]), self.right[state]
            on = (state >= 0) & out[row]
            row, state, own = row[on], state[on], own[on]
        return out

    def arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``has_arc`` for pairs of which most were asked before; a slot keeps its last pair and the answer."""
        if self.asked is None:
            self.asked = np.full(ASKED, -1, np.int64)
        pair = state * self.size + token
        slot = spread(pair, 64 - ASKED.bit_length() + 1)
        kept = self.asked[slot]
        out = (kept & 1).astype(bool)
        rest = np.flatnonzero(kept >> 1 != pair)
        if len(rest):
            each, back = np.unique(pair[rest], return_inverse=True)
            found = self.has_arc(each // self.size, each % self.size)
            out[rest] = found[back]
            self.asked[slot[rest]] = 2 * pair[rest] + out[rest]
        return out

    def tokenize(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after another, and the number of ids of each word.

        ``words`` holds the bytes of all words, ``sizes`` their positive lengths.
        """
        long = sizes > LONG
        if not long.any():
            return self._together(words, sizes)
        starts = np.cumsum(sizes) - sizes
        short, counts = np.repeat(~long, sizes), np.zeros(len(sizes), np.int64)
        ids, counts[~long] = self._together(words[short], sizes[~long]) if short.any() else ([], [])
        own = {i: self._alone(words[starts[i] : starts[i] + sizes[i]]) for i in np.flatnonzero(long).tolist()}
        for i, found in own.items():
            counts[i] = len(found)
        out = np.empty(int(counts.sum()), np.int64)
        out[np.repeat(~long, counts)] = ids
        stops = np.cumsum(counts)
        for i, found in own.items():
            out[stops[i] - counts[i] : stops[i]] = found
        return out, counts

    def _alone(self, word: np.ndarray) -> list[int]:
        """Token ids of one long word: the arcs between all neighbouring pieces first, then one walk over them."""
        codes = word.astype(np.int64)
        codes[-1] += 256
        n = len(codes)
        start, end, token = self.pieces.match(codes, np.full(n, n))
        order = np.argsort(start, kind="stable")
        start, end, token = start[order], end[order], token[order]
        first = np.searchsorted(start, np.arange(n + 1))
        by_end = np.argsort(end, kind="stable")
        ends_at = np.searchsorted(end[by_end], np.arange(n + 2))
        firsts, tokens, ends = first.tolist(), token.tolist(), end.tolist()
        reached = [-1] * (n + 1)  # the piece whose arc ends there on the accepted path
        origin = [-1] * len(tokens)
        for piece in range(firsts[0], firsts[1]):
            reached[ends[piece]] = piece
        for low in range(1, n, SPAN):
            high = min(n, low + SPAN)
            before = by_end[ends_at[low] : ends_at[high]]  # pieces that end at a place of the span
            width = first[end[before] + 1] - first[end[before]]
            base = np.cumsum(width) - width
            after = np.repeat(first[end[before]] - base, width) + np.arange(int(width.sum()))
            arc = self.arcs(np.repeat(token[before], width), token[after]).tolist()
            at = dict(zip(before.tolist(), base.tolist()))
            for place in range(low, high):
                piece = reached[place]
                if piece >= 0:
                    lo = firsts[place]
                    for k in range(firsts[place + 1] - lo):
                        if arc[at[piece] + k]:
                            reached[ends[lo + k]], origin[lo + k] = lo + k, piece
        out, piece = [], reached[n]
        while piece >= 0:
            out.append(tokens[piece])
            piece = origin[piece]
        return out[::-1]

    def _together(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``tokenize`` for many short words, which all take a step at a time."""
        last = np.cumsum(sizes)
        codes = words.astype(np.int64)
        codes[last - 1] += 256
        first = last - sizes
        offset = np.arange(len(codes)) - np.repeat(first, sizes)
        start, end, token = self.pieces.match(codes, np.repeat(last, sizes))
        order, begins = by_step(start, offset)
        start, end, token = start[order], end[order], token[order]
        reached = np.full(len(codes), -1, np.int64)  # token whose arc ends after this letter
        origin = np.full(len(codes), -1, np.int64)
        for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist()):
            s, e, t = start[lo:hi], end[lo:hi], token[lo:hi]
            if lo:
                state = reached[s - 1]
                on = state >= 0
                s, e, t, state = s[on], e[on], t[on], state[on]
                on = self.arcs(state, t)
                s, e, t = s[on], e[on], t[on]
            reached[e - 1], origin[e - 1] = t, s
        steps, at, row = [], last - 1, np.arange(len(sizes))
        counts = np.zeros(len(sizes), np.int64)
        while len(row):
            steps.append((row, reached[at], counts[row]))
            counts[row] += 1
            at = origin[at]
            on = at > first[row]
            row, at = row[on], at[on] - 1
        out = np.empty(int(counts.sum()), np.int64)
        stops = np.cumsum(counts)
        for row, token, behind in steps:
            out[stops[row] - 1 - behind] = token
        return out, counts


def load(path: str) -> Automaton:
    """Compile the vocabulary file at ``path``, which only the driver reads."""
    with open(path, encoding="utf-8") as file:
        return Automaton(json.load(file))


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Values that lie one after another in ``data``."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _values(array: pa.Array) -> list[bytes]:
    if not len(array):
        return []
    offsets = np.frombuffer(array.buffers()[1], np.int32)[: len(array) + 1].tolist()
    data = array.buffers()[2].to_pybytes()
    return [data[i:j] for i, j in zip(offsets, offsets[1:])]


class Encoder:
    """Text to ids with a bounded cache of the parts that texts are split into.

    The texts of a batch are split together, on their bytes. Words with bytes beyond ASCII, or of a vocabulary with
    another pattern, are one part here, which is split by the pattern itself when it is met first.
    """

    def __init__(self, automaton: Automaton):
        # answers about arcs go with the encoder, not with the tables, which a worker keeps for other encoders
        self.automaton = copy(automaton)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts = regex.compile(automaton.pattern + "|\n")
        self.special = re.compile("(" + "|".join(map(re.escape, automaton.special)) + ")")
        self.marked = {MARK + t.encode(): int(i).to_bytes(4, "little") for t, i in automaton.special.items()}
        self.plain = automaton.pattern == PATTERN
        self.kinds = np.full(256, WHOLE, np.uint8)
        self.kinds[[*range(9, 14), 32]] = SPACE
        for kind, letter in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (OTHER, r"[^\s\p{L}\p{N}]")):
            if self.plain:
                self.kinds[[b for b in range(128) if self.kinds[b] == WHOLE and regex.match(letter, chr(b))]] = kind

    def _normal(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower().encode()

    def _spelled(self, text: str | None) -> bytes:
        """The text as it is split; a special token is a word of its own with a mark before it."""
        if not text:
            return b""
        if not any(token in text for token in self.automaton.special):
            return self._normal(text)
        pieces = enumerate(self.special.split(text))
        return b"".join(b" " + MARK + piece.encode() + b" " if i % 2 else self._normal(piece) for i, piece in pieces)

    def _split(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all parts one after another, where each begins, and how many begin before the end of each text."""
        spelled = list(map(self._spelled, texts))
        data = np.frombuffer(b"\n".join([*spelled, b""]), np.uint8)
        kind = self.kinds[data]
        strange = np.flatnonzero(kind == WHOLE)
        if len(strange):
            lead = strange[WIDE_LEAD[data[strange]]]
            for width in (2, 3):
                # a text is followed by a line end, so that no place lies beyond the data
                own = lead[np.isin(sum(data[lead + i].astype(np.int64) << 8 * i for i in range(width)), WIDE[width])]
                for i in range(width):
                    kind[own + i] = SPACE
            strange = strange[kind[strange] == WHOLE]
        solid = kind != SPACE
        begins = np.concatenate(([True], kind[1:] != kind[:-1])) if len(data) else np.empty(0, bool)
        begins |= kind == DIGIT
        # an apostrophe after anything but punctuation takes these letters with it
        quote = np.flatnonzero(data == 39)
        quote = quote[(kind[quote] == OTHER) & (kind[quote - 1] != OTHER)]
        one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        width = 2 * np.isin(one, ENDS_1) + 3 * np.isin(one.astype(np.int64) * 256 + two, ENDS_2)
        quote, width = quote[width > 0], width[width > 0]
        begins[quote + 1] = False
        begins[quote + width] = True
        begins &= solid
        at = np.flatnonzero(begins)
        if len(strange):
            first = ~solid[at - 1]  # the first byte comes after the last, a line end
            whole = np.zeros(np.count_nonzero(first), bool)
            whole[np.searchsorted(at[first], strange, "right") - 1] = True
            inner = ~first & whole[np.cumsum(first) - 1]
            begins[at[inner]] = False
            at = at[~inner]
        ends = np.searchsorted(at, np.cumsum([0, *(len(text) + 1 for text in spelled)]))
        return data[solid], np.flatnonzero(begins[solid]), ends

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct parts, all passed through the automaton together."""
        ready = list(map(bytes.isascii, words)) if self.plain else [False] * len(words)
        whole = [w for w, own in zip(words, ready) if not own]
        words = list(compress(words, ready))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, owner = np.frombuffer(b"".join(words), np.uint8), np.arange(len(words))
        if whole:
            parts = self.parts.findall(b"\n".join(whole).decode())
            letters = np.fromiter(map(len, parts), np.int64, len(parts))
            rest = np.frombuffer("".join(parts).encode(), np.uint8)
            # where each part begins in bytes: the first byte of its first letter
            lead = np.append(np.flatnonzero((rest & 0xC0) != 0x80), len(rest))
            begin = lead[np.concatenate(([0], np.cumsum(letters)))]
            between = rest[begin[:-1]] == 10
            sizes = np.concatenate((sizes, np.diff(begin)[~between]))
            data = np.concatenate((data, rest[rest != 10]))
            owner = np.concatenate((owner, len(words) + np.cumsum(between)[~between]))
            words += whole
        ids, counts = self.automaton.tokenize(data, sizes)
        per_word = np.bincount(owner, counts, len(words)).astype(np.int64)
        stops = (4 * np.concatenate(([0], np.cumsum(per_word)))).tolist()
        packed = ids.astype("<u4").tobytes()
        return dict(zip(words, [packed[i:j] for i, j in zip(stops, stops[1:])]))

    def encode(self, texts, width: int = 4) -> list[bytes]:
        """Ids of each text as little-endian integers of ``width`` bytes."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        data, begin, ends = self._split(texts)
        # a part is looked up once for all texts
        coded = _binary(data, np.append(begin, len(data))).dictionary_encode()
        words = _values(coded.dictionary)
        ids = list(map(cache.get, words))
        missing = [w for w, own in zip(words, ids) if own is None]
        if missing:
            new = dict(self.marked)
            new.update((w, own) for w, own in zip(missing, map(older.get, missing)) if own is not None)
            unknown = [w for w in missing if w not in new]
            for i in range(0, len(unknown), WORDS_AT_ONCE):
                new.update(self._learn(unknown[i : i + WORDS_AT_ONCE]))
            ids = [new[w] if own is None else own for w, own in zip(words, ids)]
            cache |= new
            for w in [w for w in missing if len(w) > CACHED_LENGTH]:
                del cache[w]
        # the ids of all parts of all texts, gathered from those of the distinct parts
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        each = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}")
        stops = np.concatenate(([0], np.cumsum(sizes // 4 * width)))
        found = _binary(each, stops).take(coded.indices)
        stops = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1][ends].tolist()
        found = found.buffers()[2].to_pybytes() if len(found) else b""
        return [found[i:j] for i, j in zip(stops, stops[1:])]

    def decode(self, ids: bytes) -> str:
        """The arc labels of packed ids; without a decoder these are joined by spaces."""
        return " ".join(map(self.automaton.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = worker_cache()


def _encoder(shared, path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        make_room(_encoders)
        _encoders[path] = Encoder(shared.value)
    return _encoders[path]


class Tokenizer:
    """Columns of token ids and of decoded text; the compiled vocabulary is broadcast (a few MB)."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.shared = prepare(spark).sparkContext.broadcast(load(path))

    def encode(self, text: Column, width: int = 4) -> Column:
        """Packed ids (little-endian unsigned, ``width`` bytes) of a text column; null gives no ids."""
        shared, path = self.shared, self.path
        if shared.value.size > 256**width:
            raise ValueError(f"{shared.value.size} ids do not fit {width} bytes")

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = _encoder(shared, path)
            for batch in batches:
                yield pd.Series(encoder.encode(batch.tolist(), width), dtype=object)

        return F.pandas_udf(run, T.BinaryType())(text)

    def encode_and_decode(self, text: Column) -> Column:
        """Struct ``(ids, decoded)`` of a text column, from one worker a task, with one vocabulary in memory."""
        shared, path = self.shared, self.path

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encoder = _encoder(shared, path)
            for batch in batches:
                ids = encoder.encode(batch.tolist())
                yield pd.DataFrame({"ids": ids, "decoded": [encoder.decode(own) for own in ids]}, dtype=object)

        return F.pandas_udf(run, "ids binary, decoded string")(text)

    def decode(self, ids: Column) -> Column:
        """Text of a column of packed ids."""
        shared, path = self.shared, self.path

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = _encoder(shared, path)
            for batch in batches:
                yield pd.Series([encoder.decode(ids) for ids in batch], dtype=object)

        return F.pandas_udf(run, T.StringType())(ids)


def encode_documents(
    df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of every row."""
    tokenizer = Tokenizer(df.sparkSession, path)
    both = tokenizer.encode_and_decode(F.col(f"`{text}`")).alias("_both")
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), both).select("doc_id", "_both.*")
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "decoded")
