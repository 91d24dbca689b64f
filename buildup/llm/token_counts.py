"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers read a text; their transitions carry what they emit.

* The *splitter* reads classes of code points and emits word starts, at the place read or one before it. It has
  eleven states, so the map from the state before a chunk to the state behind it is a short row. All chunks of a window
  get their map together, the maps are composed by a parallel prefix scan, and a second pass that knows
  where each chunk begins emits the starts.
* The *counter* reads the bytes of a word. Its state after a prefix is, for every suffix that may still grow into a
  token, the place in the trie of tokens, the last token before that suffix, and how many tokens fewer the prefix up
  to there has. Reading a byte emits the change of the number of tokens, which may be negative. A token may follow
  another if no merge of lower rank spans their border; exactly one of the tokens that end at a place may follow.
  Transitions are compiled when first met and kept in a hash table that is read for many words at a time. A word start
  resets the counter, so a word maps every state before it to one count. Words of more than ``SEGMENT`` bytes are cut:
  a segment's map is kept for the states it is entered with, first a guess from the bytes before it, and the maps are
  composed from left to right.

Classes of code points come from the library's own regular expressions, so that both know the same letters.

Defined cases: null and empty texts have no bytes and no tokens; a special token written out in a text counts as one and
cuts the text, as in the library; rows are independent, so ties, repeated rows and empty tables need no care; a text is
read in windows, so a very long one needs memory for its longest word only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildup.llm.bpe import byte_letters
from buildup.llm.common import make_room, prepare, worker_cache

WINDOW = 1 << 18  # code points read at a time
CHUNK = 64  # code points of a splitter chunk
SEGMENT = 64  # bytes of a long word read as one segment
WARM = 32  # bytes before a segment that its first entry state is guessed from
MAX_STATES = 400_000  # compiled states kept between windows
NEVER = 1 << 40

# ---- splitter

CLASSES = "letter s r v l e number space blank quote other end".split()
LETTER, S, R, V, L, E, NUMBER, SPACE, BLANK, QUOTE, OTHER, END = range(12)
STATES = "start word digits signs space blank spaces blanks quote quote_e quote_l".split()
_STARTS, _WORD, _DIGITS, _SIGNS, _SPACE, _BLANK, _SPACES, _BLANKS, _QUOTE, _QUOTE_E, _QUOTE_L = range(11)
HERE, BEFORE = 1, 2  # a word starts at the place read, or one before
MARK = "\ud800"  # stands between texts; no valid text holds it


def _kind(c: int) -> int:
    """State of a run that class ``c`` belongs to."""
    if c <= E:
        return _WORD
    return {NUMBER: _DIGITS, SPACE: _SPACE, BLANK: _BLANK, QUOTE: _SIGNS, OTHER: _SIGNS, END: _STARTS}[c]


def _transition(state: int, c: int) -> tuple[int, int]:
    """Next state and emission. Contractions, runs with one space before them, white space short of its last."""
    kind = _kind(c)
    fresh = (_QUOTE if c == QUOTE else kind, HERE)
    white = c in (SPACE, BLANK)
    if c == END or state == _STARTS:
        return fresh[0], HERE | (BEFORE if state in (_QUOTE_E, _QUOTE_L) else 0)
    if state in (_WORD, _DIGITS, _SIGNS):
        return (state, 0) if kind == state else fresh
    if state in (_SPACE, _BLANK, _SPACES, _BLANKS):
        if white:
            return (_SPACES if c == SPACE else _BLANKS), 0
        last = BEFORE if state in (_SPACES, _BLANKS) else 0
        return (kind, last) if state in (_SPACE, _SPACES) else (fresh[0], last | HERE)
    if state == _QUOTE:
        if c in (S, R, V, L):
            return {S: _STARTS, R: _QUOTE_E, V: _QUOTE_E, L: _QUOTE_L}[c], 0
        return (_SIGNS, 0) if kind == _SIGNS else fresh
    if c == (E if state == _QUOTE_E else L):
        return _STARTS, 0
    return (_WORD, BEFORE) if kind == _WORD else (fresh[0], BEFORE | HERE)


_TABLE = [[_transition(s, c) for s in range(len(STATES))] for c in range(len(CLASSES))]
NEXT = np.array([[t[0] for t in row] for row in _TABLE], np.intp)  # by class, then state
EMIT = np.array([[t[1] for t in row] for row in _TABLE], np.uint8)


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps, one a row, applied one after the other."""
    return np.take_along_axis(then, first, axis=1)


def scan(maps: np.ndarray) -> np.ndarray:
    """Row i becomes the composition of the maps 0 to i, in a logarithmic number of steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step], out[step:])
        step *= 2
    return out


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a word starts at each place of a stream of classes that begins with a word."""
    n = len(classes)
    lanes = np.full((-(-n // CHUNK), CHUNK), END, np.intp)
    lanes.ravel()[:n] = classes
    width = len(STATES)
    flat = NEXT.ravel()
    maps = np.broadcast_to(np.arange(width), (len(lanes), width))
    by_place = np.ascontiguousarray((lanes * width).T)
    for place in by_place:
        maps = flat[place[:, None] + maps]
    state = np.concatenate(([_STARTS], scan(maps)[:-1, _STARTS]))
    emitted = np.empty((CHUNK, len(lanes)), np.uint8)
    emits = EMIT.ravel()
    for i, place in enumerate(by_place):
        at = place + state
        emitted[i], state = emits[at], flat[at]
    emitted = emitted.T.ravel()[:n]
    starts = (emitted & HERE).astype(bool)
    starts[:-1] |= (emitted[1:] & BEFORE).astype(bool)
    return starts


def code_point_classes() -> np.ndarray:
    """Class of every code point, asked from the library where code points are assigned."""
    from tokenizers import Regex, pre_tokenizers

    table = np.full(0x110000, OTHER, np.uint8)
    spans = [(0, 0xD800), (0xE000, 0x40000), (0xE0000, 0xE1000)]
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        split = pre_tokenizers.Split(Regex(pattern), "removed")
        for low, high in spans:
            left = np.ones(high - low, bool)
            for _, (a, b) in split.pre_tokenize_str("".join(map(chr, range(low, high)))):
                left[a:b] = False
            table[low:high][left] = c
    for letters, c in (("stmd", S), ("r", R), ("v", V), ("l", L), ("e", E), (" ", SPACE), ("'", QUOTE), (MARK, END)):
        for letter in letters:
            table[ord(letter)] = c
    return table


# ---- counter


@dataclass
class Compiled:
    """What the driver reads from the vocabulary; broadcast (a few MB)."""

    size: int
    left: np.ndarray  # parts of a token, -1 for single bytes
    right: np.ndarray
    born: np.ndarray  # rank of a token's merge, -1 for single bytes
    steps: dict[int, int]  # trie: node * 256 + byte
    piece: list[int]  # token of a node, or -1
    grows: list[bool]  # whether a node has children
    classes: np.ndarray
    special: list[str] = field(default_factory=list)
    ranks: dict[int, int] = field(default_factory=dict)  # left * size + right: rank


def load(path: str) -> Compiled:
    """Compile the vocabulary file at ``path``, which only the driver reads."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"]
    plain = not (model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or spec["normalizer"])
    if model["type"] != "BPE" or not plain or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("expected a plain BPE vocabulary without a normalizer")
    if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        raise ValueError("expected words split at byte level by the usual pattern")
    vocab = model["vocab"]
    size = 1 + max(vocab.values())
    left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    born = np.full(size, -1, np.int64)
    spelt = {vocab[letter]: bytes([b]) for b, letter in enumerate(byte_letters())}
    out = Compiled(size, left, right, born, {}, [], [], code_point_classes())
    out.special = [t["content"] for t in spec["added_tokens"]]
    border = Border(out)
    for rank, merge in enumerate(model["merges"]):
        x, y = merge if isinstance(merge, (list, tuple)) else merge.split(" ")
        a, b, c = vocab[x], vocab[y], vocab[x + y]
        out.ranks[a * size + b] = rank
        # a token that its own letters never become is not a token of the trie
        if a in spelt and b in spelt and c not in spelt:
            left[c], right[c], born[c] = a, b, rank
            if border.stands(a, b, rank):
                spelt[c] = spelt[a] + spelt[b]
    ends = {}
    for token, letters in spelt.items():
        node = 0
        for b in letters:
            node = out.steps.setdefault(node * 256 + b, len(out.steps) + 1)
        ends[node] = token
    out.piece = [ends.get(node, -1) for node in range(len(out.steps) + 1)]
    inner = {key >> 8 for key in out.steps}
    out.grows = [node in inner for node in range(len(out.steps) + 1)]
    return out


class Border:
    """Whether one token may follow another."""

    def __init__(self, compiled: Compiled):
        self.size, self.ranks = compiled.size, compiled.ranks
        self.compiled = compiled

    def stands(self, a: int, b: int, until: int = NEVER) -> bool:
        """No merge before ``until`` joins letters across the border of ``a`` and ``b``.

        Going back in time, the neighbours of the border are the right ends of ``a`` and the left ends of ``b``. Two
        of them met until one went into the next larger token; a merge of both with a lower rank came first. Of equal
        rank, as in a run of one letter, the merge further left came first.
        """
        left, right, born = self.compiled.left, self.compiled.right, self.compiled.born
        a_until = b_until = until
        while True:
            rank = self.ranks.get(a * self.size + b)
            if rank is not None and rank < a_until and rank < b_until + (b_until < until):
                return False
            a_born, b_born = int(born[a]), int(born[b])
            if a_born < 0 and b_born < 0:
                return True
            if a_born > b_born:
                a, a_until = int(right[a]), a_born
            else:
                b, b_until = int(left[b]), b_born


class Counter:
    """The transducer of words, with the transitions compiled so far."""

    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, compiled: Compiled):
        self.compiled = compiled
        self.border = Border(compiled)
        self.may: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.may.clear()
        # a state is its suffixes, each packed: node, last token before it, tokens there less tokens here
        self.states: list[tuple[int, ...]] = [(self._packed(0, self.compiled.size, 0),)]
        self.number = {self.states[0]: 0}
        self._empty(1 << 16)

    @staticmethod
    def _packed(node: int, before: int, less: int) -> int:
        return node << 36 | before << 12 | less + 2048

    def _empty(self, slots: int) -> None:
        self.keys, self.values = np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
        self.shift, self.mask, self.filled = np.uint64(65 - slots.bit_length()), slots - 1, 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.SPREAD) >> self.shift).astype(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are distinct and new; the table stays at least two thirds empty."""
        if 3 * (self.filled + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys = np.concatenate((self.keys[old], keys))
            values = np.concatenate((self.values[old], values))
            self._empty(1 << (4 * len(keys)).bit_length())
        self.filled += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & self.mask

    def _compile(self, key: int) -> int:
        """The transition of ``state * 256 + byte``, as next state * 4096 + change of the count + 2048."""
        byte = key & 255
        c, may, none = self.compiled, self.may, self.compiled.size
        going, token, change = [], none, 0
        for suffix in self.states[key >> 8]:
            node = c.steps.get(suffix >> 36 << 8 | byte)
            if node is None:
                continue
            if token == none and c.piece[node] >= 0:
                found, before = c.piece[node], suffix >> 12 & 0xFFFFFF
                pair = before << 24 | found
                if before != none and pair not in may:
                    may[pair] = self.border.stands(before, found)
                if before == none or may[pair]:
                    token, change = found, (suffix & 4095) - 2047
            if c.grows[node]:
                going.append(node << 36 | suffix & 0xFFFFFFFFF)
        behind = tuple([suffix - change for suffix in going]) + (self._packed(0, token, 0),)
        number = self.number.get(behind)
        if number is None:
            number = self.number[behind] = len(self.states)
            self.states.append(behind)
        return number << 12 | change + 2048

    def _step(self, key: np.ndarray) -> np.ndarray:
        """Transitions of many keys; those not met before are compiled."""
        slot = self._slot(key)
        found = self.keys[slot]
        out = self.values[slot]
        wrong = np.flatnonzero(found != key)
        if not len(wrong):
            return out
        missing, left, at = [], wrong, slot[wrong]
        while len(left):
            here = self.keys[at]
            hit = here == key[left]
            out[left[hit]] = self.values[at[hit]]
            empty = here < 0
            missing.append(left[empty])
            go = ~hit & ~empty
            left, at = left[go], (at[go] + 1) & self.mask
        missing = np.concatenate(missing)
        if len(missing):
            each, back = np.unique(key[missing], return_inverse=True)
            new = np.array([self._compile(k) for k in each.tolist()])
            self._put(each, new)
            out[missing] = new[back]
        return out

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple:
        """State behind and tokens emitted by each of many byte spans, which all take a step at a time."""
        order = np.argsort(-size, kind="stable")
        at, state = start[order], state[order].astype(np.int64)
        total = np.zeros(len(order), np.int64)
        longest = int(size.max()) if len(size) else 0
        # spans that still have a byte to read at each step
        reading = len(size) - np.searchsorted(size[order][::-1], np.arange(longest), side="right")
        for i, k in enumerate(reading.tolist()):
            value = self._step(state[:k] << 8 | data[at[:k] + i])
            state[:k] = value >> 12
            total[:k] += (value & 4095) - 2048
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def counts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each word ``data[start : start + size]``."""
        if len(self.states) > MAX_STATES:
            self.reset()
        long = np.flatnonzero(size > SEGMENT)
        out = np.zeros(len(size), np.int64)
        short = np.flatnonzero(size <= SEGMENT)
        out[short] = self.run(data, start[short], size[short], np.zeros(len(short), np.int64))[1]
        if len(long):
            out[long] = self._long(data, start[long], size[long])
        return out

    def _long(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of long words from the maps of their segments."""
        parts = -(-size // SEGMENT)
        word = np.repeat(np.arange(len(size)), parts)
        place = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = start[word] + place * SEGMENT
        length = np.minimum(SEGMENT, start[word] + size[word] - at)
        warm = np.where(place > 0, WARM, 0)
        entry = self.run(data, at - warm, warm, np.zeros(len(at), np.int64))[0]
        behind, emitted = self.run(data, at, length, entry)
        text = [data[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist())]
        maps = dict(zip(zip(text, entry.tolist()), zip(behind.tolist(), emitted.tolist())))
        first = np.cumsum(parts) - parts
        state, total, reached = [0] * len(size), [0] * len(size), first.tolist()
        stop, open_ = (first + parts).tolist(), list(range(len(size)))
        while open_:
            asked = {}
            for w in open_:
                while reached[w] < stop[w]:
                    key = (text[reached[w]], state[w])
                    if key not in maps:
                        asked[key] = reached[w]
                        break
                    state[w], count = maps[key]
                    total[w] += count
                    reached[w] += 1
            open_ = [w for w in open_ if reached[w] < stop[w]]
            if asked:
                rows = np.array(list(asked.values()))
                entered = np.array([s for _, s in asked])
                behind, emitted = self.run(data, at[rows], length[rows], entered)
                maps.update(zip(asked, zip(behind.tolist(), emitted.tolist())))
        return np.array(total)


class Reader:
    """Counts of texts, read in windows."""

    def __init__(self, compiled: Compiled):
        self.compiled = compiled
        self.counter = Counter(compiled)

    def _window(self, texts: list[str], last_open: bool) -> tuple[list[int], int]:
        """Tokens of each text; if the last goes on, its last word is left and where that begins is returned."""
        stream = (MARK.join(texts) + MARK).encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(stream, np.uint32)
        classes = self.compiled.classes[points]
        begins = np.flatnonzero(word_starts(classes))
        mark = classes == END
        width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
        width[mark] = 0
        offset = np.concatenate(([0], np.cumsum(width)))
        data = np.frombuffer("".join(texts).encode(), np.uint8).astype(np.int64)
        words = begins[~mark[begins]]
        ends = np.append(begins[1:], len(points))[~mark[begins]]
        text = np.cumsum(mark)[words]
        rest = 0
        if last_open:
            # the last two code points may still change where a word starts
            own = words[(text == len(texts) - 1) & (words < len(points) - 3)]
            first = len(points) - 1 - len(texts[-1])
            rest = int(own[-1]) - first if len(own) else 0
            keep = (text < len(texts) - 1) | (words < first + rest)
            words, ends, text = words[keep], ends[keep], text[keep]
        counts = self.counter.counts(data, offset[words], offset[ends] - offset[words])
        return np.bincount(text, counts, len(texts)).astype(np.int64).tolist(), rest

    def _pieces(self, text: str) -> tuple[list[str], int]:
        """``text`` between its special tokens, and their number."""
        pieces, found = [text], 0
        for token in self.compiled.special:
            if token in text:
                pieces = [p for piece in pieces for p in piece.split(token)]
        found = len(pieces) - 1
        return pieces, found

    def counts(self, texts) -> list[int]:
        out, waiting, owner, size = [], [], [], 0

        def flush() -> None:
            nonlocal waiting, owner, size
            if waiting:
                for row, n in zip(owner, self._window(waiting, False)[0]):
                    out[row] += n
            waiting, owner, size = [], [], 0

        for row, text in enumerate(texts):
            pieces, special = self._pieces(text or "")
            out.append(special)
            for piece in pieces:
                low, reach = 0, WINDOW
                while len(piece) - low > reach:
                    (n,), rest = self._window([piece[low : low + reach]], True)
                    out[row] += n
                    low, reach = low + rest, WINDOW if rest else 2 * reach
                waiting.append(piece[low:])
                owner.append(row)
                size += len(piece) - low
                if size > WINDOW:
                    flush()
        flush()
        return out


_readers: dict[str, Reader] = worker_cache()


def _reader(shared, path: str) -> Reader:
    """One reader for each worker process and vocabulary."""
    if path not in _readers:
        make_room(_readers)
        _readers[path] = Reader(shared.value)
    return _readers[path]


def token_count(spark: SparkSession, path: str, text: Column) -> Column:
    """Column with the number of tokens of a text column, by the vocabulary file at ``path``."""
    shared = prepare(spark).sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = _reader(shared, path)
        for batch in batches:
            yield pa.array(reader.counts(batch.to_pylist()), pa.int64())

    return F.arrow_udf(run, T.LongType())(text)


def count_tokens(
    df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row; ``over_limit`` means more than ``limit`` tokens."""
    source = F.col(f"`{text}`")
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.octet_length(source), F.lit(0)).cast("bigint").alias("n_bytes"),
        token_count(df.sparkSession, path, source).alias("n_tokens"),
    )
    return rows.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
