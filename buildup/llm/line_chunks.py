"""Removal of repeated passages.

Two kinds of repeats go, except for their first occurrence, by the smallest document id, then text hash, then place:

* Content-defined chunks of two or more lines. A line ends a chunk where a rolling hash over its own and the previous
  line's hash is zero modulo ``MEAN``, so the same passage is cut alike wherever it stands.
* Passages of more than ``WORDS`` words, whatever surrounds them. Lines are the pieces of a text, and a line of more
  than ``WORDS`` words is cut into its sentences. A pair of neighbouring pieces with what separates them is a seed
  where it occurred before. Seeds of a text that first occurred side by side in one earlier text make a stretch; it is
  grown to both sides over further seeds as long as that same earlier text goes on with the same pieces,
  whether these first occurred there or not: by two pairs beyond its own seeds, and if it then has up to ``WORDS``
  words, by up to sixteen (where two shorter repeats meet, the pair across them is a seed again). A stretch of more than ``WORDS`` words goes, and so does a
  piece that alone has as many and occurred before. What is stitched together from several places stays, unless
  one of the parts is that long.

Hashes only name candidates: their bytes are compared before anything is removed, and where different bytes share a
hash, equal bytes decide. The first occurrence of a piece stays, unless it lies in a chunk that goes.

Defined cases: null texts stay null and empty texts empty; a text that loses all lines is empty; null ids come
last; rows equal in id and text are one document, so they keep or lose the same lines; a repeat within a document
stays at its first place, and of a piece that follows itself one stays; texts of up to ``WORDS`` words have no
passages. Repeats of up to ``WORDS`` words go only as chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildup.llm.common import prepare, text_hash, whole_rows
from buildup.session import stage

MEAN = 3  # lines in a chunk, on average
WORDS = 50  # a passage has more
GROW = (2, 16)  # pairs beyond each end of a stretch's seeds that are looked up first, and in all
BLOCK = 32  # neighbouring pairs of a text that are looked up in one row
TOGETHER = 1 << 16  # candidates that are packed at a time
_TURN = np.uint64(0x9E3779B97F4A7C15)
_MANY = 0x7FFF  # words of a piece are counted up to here


def chunks(text: str | None) -> list[tuple[int, int, int]]:
    """``(first line, lines, hash)`` of every chunk of two or more lines."""
    if not text or "\n" not in text:
        return []
    lines = [line.encode("utf-8", "surrogatepass") for line in text.split("\n")]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
    rolled = hashes * _TURN
    rolled[1:] ^= (hashes[:-1] << np.uint64(1)) | (hashes[:-1] >> np.uint64(63))
    ends = np.flatnonzero((rolled * _TURN >> np.uint64(32)) % np.uint64(MEAN) == 0) + 1
    cuts = [0, *ends.tolist()]
    if cuts[-1] < len(lines):
        cuts.append(len(lines))
    digest = xxhash.xxh64_intdigest
    return [
        (a, b - a, digest(b"\n".join(lines[a:b])) - 2**63) for a, b in zip(cuts, cuts[1:]) if b - a > 1
    ]


# a plain character class in front lets the search skip ahead
_SENTENCE = re.compile(r"([.!?。！？][.!?。！？]*(?:(?<=[。！？])|[\"'”’»)\]]*(?=\s)))\s*")


def _long(text: str) -> bool:
    return len(text) > 2 * WORDS and len(text.split(None, WORDS)) > WORDS


def pieces(text: str) -> list[tuple[int, int, int]]:
    """``(from, to, line)`` of every line, or of the sentences of a long line, without what separates them."""
    out, at = [], 0
    for i, line in enumerate(text.split("\n")):
        a = 0
        if len(line) > 2 * WORDS and _long(line):
            for found in _SENTENCE.finditer(line):
                (_, end), (_, stop) = found.span(), found.span(1)
                if end < len(line):
                    out.append((at + a, at + stop, i))
                    a = end
        out.append((at + a, at + len(line), i))
        at += len(line) + 1
    return out


def candidates(text: str | None) -> tuple[list[tuple[int, int, int]], list[int], list[int], list[int]]:
    """The chunks, and of all pieces their hash, the hash of what follows until the next piece, and their words."""
    if not text or not _long(text):
        return chunks(text), [], [], []
    digest, apart = xxhash.xxh64_intdigest, {}
    parts, between, words, last = [], [], [], None
    for a, b, _ in pieces(text):
        if last is not None:
            gap = text[last:a]
            if gap not in apart:
                apart[gap] = digest(gap)
            between.append(apart[gap])
        piece, last = text[a:b], b
        parts.append(digest(piece.encode("utf-8", "surrogatepass")))
        words.append(len(piece.split()))
    return chunks(text), parts, [*between, 0], words


def without(text: str, cuts: list[tuple[int, int, bool]]) -> str:
    """``text`` without the repeats ``(first, number, chunk)``: chunks in lines, long stretches in pieces."""
    gone = {i for s, n, chunk in cuts if chunk for i in range(s, s + n)}
    stretches = [(s, s + n) for s, n, chunk in cuts if not chunk]
    if not stretches:
        return "\n".join([line for i, line in enumerate(text.split("\n")) if i not in gone])
    cut = pieces(text)

    def many(some: list[tuple[int, int, int]]) -> bool:
        # read as one, pieces have no more words than one by one
        as_one = text[some[0][0] : some[-1][1]].split(None, WORDS)
        return len(as_one) > WORDS or sum(len(text[a:b].split()) for a, b, _ in some) > WORDS

    lost = {i for a, b in stretches if many(cut[a:b]) for i in range(a, b)}
    out, last = [], None
    for k, (a, b, line) in enumerate(cut):
        if line in gone or k in lost:
            continue
        if line != last:
            out.append(text[a:b])
        else:
            # what stood before the piece in its line stays between them
            out[-1] += text[cut[k - 1][1] : b]
        last = line
    return "\n".join(out)


_PLACE = "no_id boolean, id bigint, text_hash bigint"
_FOUND = f"{_PLACE}, start int, lines int, h bigint, chunk boolean, words int"


def _candidates(hash_bits: int):
    """Rows ``(key, first, number, hash, chunk, words)``: the chunks in lines, then pairs of neighbouring pieces and
    long ones in pieces. ``words`` are those of the first piece, and of the next in the upper half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, parts, between, words = zip(*map(candidates, batch.column("text").to_pylist())) if len(batch) else [()] * 4
            every = np.arange(len(batch))
            cut = np.array([c for own in found for c in own], np.int64).reshape(-1, 3)
            size = np.array([len(own) for own in parts], np.int64)
            alone = np.array([h for own in parts for h in own], np.uint64)
            gap = np.array([h for own in between for h in own], np.uint64)
            count = np.array([n for own in words for n in own], np.int64)
            doc, k = np.repeat(every, size), np.arange(len(alone)) - np.repeat(np.cumsum(size) - size, size)
            two = np.flatnonzero(doc[1:] == doc[:-1])
            long = np.flatnonzero(count > WORDS)
            pairs = (alone[two] * _TURN ^ alone[two + 1]) * _TURN + gap[two]
            pairs = (pairs ^ pairs >> np.uint64(29)) * _TURN
            some = np.minimum(count, _MANY)
            hashes = np.concatenate((cut[:, 2], pairs.view(np.int64), (alone[long] ^ np.uint64(1 << 63)).view(np.int64)))
            sizes = [len(cut), len(two), len(long)]
            source = np.concatenate((np.repeat(every, [len(own) for own in found]), doc[two], doc[long]))
            columns = [batch.column(c).take(pa.array(source)) for c in _KEY]
            columns.append(pa.array(np.concatenate((cut[:, 0], k[two], k[long])), pa.int32()))
            columns.append(pa.array(np.concatenate((cut[:, 1], np.repeat([2, 1], sizes[1:]))), pa.int32()))
            columns.append(pa.array(hashes >> np.int64(64 - hash_bits)))
            columns.append(pa.array(np.repeat([True, False, False], sizes)))
            columns.append(pa.array(np.concatenate((0 * cut[:, 0], some[two] | some[two + 1] << 16, some[long])), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=[*_KEY, "start", "lines", "h", "chunk", "words"])

    return run


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


# Lists of numbers travel packed in one binary value a row, which Spark does not take apart.
_FIRST = np.dtype([("start", "<i4"), ("id", "<i8"), ("text_hash", "<i8"), ("no_id", "?")])
_HIT = np.dtype([("k", "<i4"), ("lines", "<i4"), ("words", "<i4"), ("h", "<i8"), ("chunk", "?"), ("first", _FIRST)])
_ASK = np.dtype([("shift", "<i4"), ("at", "<i4"), ("first", _FIRST)])
_EQUAL = np.dtype([("shift", "<i4"), ("at", "<i4")])


def _packed(records: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Records of consecutive rows, ``sizes`` in each, as one binary value a row."""
    offsets = np.concatenate(([0], np.cumsum(sizes))) * records.itemsize
    data = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(records.tobytes())]
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), data)


def _records(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The row of each record, and all records of a column."""
    values = column.to_pylist()
    sizes = [len(v) // kind.itemsize for v in values]
    return np.repeat(np.arange(len(values)), sizes), np.frombuffer(b"".join(values), kind)


def _again(batch: pa.RecordBatch, doc: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Whether the first place of hits is another one."""
    own = [_numbers(batch.column(c))[doc] for c in _KEY]
    return np.any([hits["first"][c] != o for c, o in zip(_KEY, own)], axis=0) | (hits["first"]["start"] != hits["k"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text, from rows that are sorted by text; equal rows give theirs once."""

    def whole(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        key = [_numbers(rows.column(c).combine_chunks()) for c in _KEY]
        begin = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in key], axis=0)))
        stop = rows.num_rows if last else int(begin[-1])
        rest, begin = rows.slice(stop), begin[begin < stop]
        doc = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, stop)))
        hits = np.zeros(stop, _HIT)
        flat = {name: rows.column(name).combine_chunks().slice(0, stop) for name in rows.column_names}
        hits["k"] = flat["start"].to_numpy()
        for name in ("lines", "words", "h", "chunk"):
            hits[name] = flat[name].to_numpy(zero_copy_only=False)
        for name in _FIRST.names:
            hits["first"][name] = flat["first"].field(name).to_numpy(zero_copy_only=False)
        order = np.lexsort((hits["lines"], hits["chunk"], hits["k"], doc))
        doc, hits = doc[order], hits[order]
        new = np.ones(stop, bool)
        new[1:] = (doc[1:] != doc[:-1]) | np.any([hits[c][1:] != hits[c][:-1] for c in ("k", "chunk", "lines")], axis=0)
        columns = [flat[c].take(pa.array(begin)) for c in _KEY]
        columns.append(_packed(hits[new], np.bincount(doc[new], minlength=len(begin))))
        return pa.RecordBatch.from_arrays(columns, names=[*_KEY, "hits"]), rest

    held, count, enough = [], 0, TOGETHER
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= enough:
            out, rest = whole(pa.Table.from_batches(held), False)
            held, count = rest.to_batches(), rest.num_rows
            enough = max(TOGETHER, 2 * count)
            yield out
    if count:
        yield whole(pa.Table.from_batches(held), True)[0]


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, kind and text of the packed candidates of each text."""
    for batch in batches:
        doc, hits = _records(batch.column("hits"), _HIT)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hits["h"].copy()), pa.array(hits["chunk"].copy()), _texts(batch, doc, hits)], names=["h", "chunk", "bytes"]
        )


def _texts(batch: pa.RecordBatch, doc: np.ndarray, hits: np.ndarray) -> pa.Array:
    out, ends = [], np.searchsorted(doc, np.arange(len(batch) + 1)).tolist()
    starts, sizes, kinds = hits["k"].tolist(), hits["lines"].tolist(), hits["chunk"].tolist()
    for i, t in enumerate(batch.column("text").to_pylist()):
        own = slice(ends[i], ends[i + 1])
        lines = t.split("\n") if any(kinds[own]) else []
        cut = [] if all(kinds[own]) else pieces(t)
        out += [
            "\n".join(lines[s : s + k]) if c else t[cut[s][0] : cut[s + k - 1][1]]
            for s, k, c in zip(starts[own], sizes[own], kinds[own])
        ]
    return pa.array(out, pa.string())


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a candidate, with its text if there is a column ``text``."""
    for batch in batches:
        doc, hits = _records(batch.column("hits"), _HIT)
        columns = [batch.column(c).take(pa.array(doc)) for c in _KEY]
        columns += [pa.array(hits[c].copy()) for c in ("k", "lines", "words", "h", "chunk")]
        first = [pa.array(hits["first"][c].copy()) for c in (*_KEY, "start")]
        columns.append(pa.StructArray.from_arrays(first, names=[*_KEY, "start"]))
        names = [*_KEY, "start", "lines", "words", "h", "chunk", "first"]
        if "text" in batch.schema.names:
            columns.append(_texts(batch, doc, hits))
            names.append("bytes")
        yield pa.RecordBatch.from_arrays(columns, names=names)


@F.pandas_udf(T.StringType())
def _without(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Texts without the repeats at ``starts``; no starts change nothing."""
    for text, starts, sizes, kinds in batches:
        out = []
        for t, at, n, chunk in zip(text, starts, sizes, kinds):
            if at is not None and len(at):
                t = without(t, list(zip(at.tolist(), n.tolist(), chunk.tolist())))
            out.append(t)
        yield pd.Series(out, dtype=object)


_KEY = ["no_id", "id", "text_hash"]


def _key(doc_id, text) -> list:
    """Join columns without nulls for a row's id and text; they also order the rows."""
    zero = F.lit(0).cast("bigint")
    return [
        doc_id.isNull().alias("no_id"),
        F.coalesce(doc_id.cast("bigint"), zero).alias("id"),
        text_hash(text).alias("text_hash"),
    ]


def _listed(hits: DataFrame) -> DataFrame:
    """One staged row a text, with all its candidates that stand in several places; equal rows give theirs once."""
    hits = hits.select(*_KEY, "start", "lines", "words", "h", "chunk", "first")
    rows = hits.repartition(*_KEY).sortWithinPartitions("id", "text_hash", "no_id")
    spark = hits.sparkSession
    # these rows are short and hold no texts
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TOGETHER // 4))
    try:
        return stage(rows.mapInArrow(_pack, f"{_PLACE}, hits binary"), "hits")
    finally:
        prepare(spark)


def _candidates_again(rows: DataFrame, hash_bits: int) -> DataFrame:
    """Packed candidates of each text that stand in several places, with the first of these."""
    some = rows.where(f"instr(text, '\\n') > 0 or length(text) > {2 * WORDS}")
    found = stage(some.mapInArrow(_candidates(hash_bits), _FOUND), "chunks")
    place = F.struct(*_KEY, "start")
    same = ["h", "chunk"]
    groups = found.groupBy(*same).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    listed = _listed(found.join(groups.select(*same, "first"), same))
    # the lists grow with the documents: the same join at every size
    joined = rows.join(listed.hint("merge"), _KEY)
    # equal bytes throughout a hash, or not
    compared = joined.mapInArrow(_passages, "h bigint, chunk boolean, bytes string")
    compared = compared.groupBy(*same).agg(F.min("bytes").alias("a"), F.max("bytes").alias("b"))
    mixed = stage(compared.where("a <> b").select(*same), "mixed")
    if mixed.isEmpty():
        return listed
    unpacked = f"{_PLACE}, start int, lines int, words int, h bigint, chunk boolean, first struct<{_PLACE},start:int>"
    clean = listed.mapInArrow(_unpack, unpacked).join(mixed, same, "left_anti")
    alike = joined.mapInArrow(_unpack, f"{unpacked}, bytes string").join(mixed, same)
    first = alike.groupBy(*same, "bytes").agg(F.min(place).alias("first"))
    alike = alike.drop("first").join(first, [*same, "bytes"])
    return _listed(clean.unionByName(alike.select(clean.columns)))


_OTHER = f"other struct<{_PLACE}>, block int"
_GROWN = f"{_PLACE}, start int, lines int, chunk boolean, {_OTHER}, asks binary"


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first places of the repeated pairs of texts, in rows of ``BLOCK`` neighbouring pairs; -1 where a pair is no
    repeat. A text that holds no first place is never asked."""
    for batch in batches:
        doc, hits = _records(batch.column("hits"), _HIT)
        pair = ~hits["chunk"] & (hits["lines"] == 2)
        holds = np.zeros(len(batch), bool)
        holds[doc[pair & ~_again(batch, doc, hits)]] = True
        pair &= holds[doc]
        doc, hits = doc[pair], hits[pair]
        k = hits["k"].astype(np.int64)
        width = int(k.max(initial=0)) // BLOCK + 1
        each, row = np.unique(doc * width + k // BLOCK, return_inverse=True)
        places = np.zeros(len(each) * BLOCK, _FIRST)
        places["start"] = -1
        places[row * BLOCK + k % BLOCK] = hits["first"]
        other = [batch.column(c).take(pa.array(each // width)) for c in _KEY]
        columns = [pa.StructArray.from_arrays(other, names=_KEY), pa.array(each % width, pa.int32())]
        columns.append(_packed(places, np.full(len(each), BLOCK)))
        yield pa.RecordBatch.from_arrays(columns, names=["other", "block", "places"])


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of the asked places are equal: pairs are, if they first occurred at the same place."""
    for batch in batches:
        row, asks = _records(batch.column("asks"), _ASK)
        _, places = _records(batch.column("places"), _FIRST)
        at = asks["at"].astype(np.int64) + asks["shift"] - _numbers(batch.column("block"))[row] * BLOCK
        found = places[row * BLOCK + at]
        same = np.all([found[c] == asks["first"][c] for c in _FIRST.names], axis=0)
        equal = np.zeros(int(same.sum()), _EQUAL)
        for name in _EQUAL.names:
            equal[name] = asks[name][same]
        sizes = np.bincount(row[same], minlength=len(batch))
        columns = [*(batch.column(c) for c in [*_KEY, "other"]), _packed(equal, sizes)]
        yield pa.RecordBatch.from_arrays(columns, names=[*_KEY, "other", "equal"]).filter(pa.array(sizes > 0))


def stretches(asked: int, more: int):
    """Stretches of pairs of each text, and what has to be looked up to grow them further.

    Texts come with their ``hits`` and, if anything was asked, the ``answers`` so far: places that are
    equal in an earlier text at some shift. Beyond each end ``asked`` places have been looked up, and where all are
    equal and the stretch is still short, ``more`` will be. Rows with ``start`` are repeats: at first the chunks and long
    pieces, and always stretches of more than ``WORDS`` words, in pieces. The others are questions, one row for all
    that a text asks about a block of another one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, hits = _records(batch.column("hits"), _HIT)
            on = _again(batch, doc, hits)
            doc, hits = doc[on], hits[on]
            pair = ~hits["chunk"] & (hits["lines"] == 2)
            if not asked:
                yield rows(batch, doc[~pair], hits["k"][~pair], hits["lines"][~pair], hits["chunk"][~pair])
            if pair.any():
                yield one(batch, doc[pair], hits[pair])

    def rows(batch, doc, start, lines, chunk, asker=(), other=None, block=(), asks=None, sizes=()) -> pa.RecordBatch:
        """Repeats, then questions of ``sizes`` places to ``other`` texts."""
        n, m = len(doc), len(asker)
        none = lambda kind, count: pa.nulls(count, kind)
        source = pa.array(np.concatenate((doc, np.asarray(asker, np.int64))), pa.int64())
        columns = [batch.column(c).take(source) for c in _KEY]
        for values, kind in ((start, pa.int32()), (lines, pa.int32()), (chunk, pa.bool_())):
            columns.append(pa.concat_arrays([pa.array(np.ascontiguousarray(values), kind), none(kind, m)]))
        other = [pa.array(c) for c in other or (np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        asks = _packed(np.zeros(0, _ASK) if asks is None else asks, np.asarray(sizes, np.int64))
        for values in (pa.StructArray.from_arrays(other, names=_KEY), pa.array(block, pa.int32()), asks):
            columns.append(pa.concat_arrays([none(values.type, n), values]))
        return pa.RecordBatch.from_arrays(columns, names=[*_KEY, "start", "lines", "chunk", "other", "block", "asks"])

    def one(batch: pa.RecordBatch, doc: np.ndarray, seeds: np.ndarray) -> pa.RecordBatch:
        first, k = seeds["first"], seeds["k"].astype(np.int64)
        line = [[doc, *(first[n] for n in _KEY), first["start"] - k, k, np.ones(len(k))]]
        if asked:
            lists = batch.column("answers")
            to, found = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()
            row, equal = _records(found.field("equal"), _EQUAL)
            others = [_numbers(found.field("other").field(n))[row] for n in _KEY]
            line.append([to[row], *others, equal["shift"], equal["at"], np.zeros(len(row))])
        line = [np.concatenate(c).astype(np.int64) for c in zip(*line)]
        order = np.lexsort(line[5::-1])
        *line, place, own = [c[order] for c in line]
        # runs of consecutive places on one line: the same text, earlier text and shift
        new = np.ones(len(place), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in line], axis=0) | (place[1:] > place[:-1] + 1)
        begin = np.flatnonzero(new)
        low, high = place[begin], place[np.append(begin[1:], len(place)) - 1]
        least = np.minimum.reduceat(np.where(own > 0, place, 1 << 40), begin)
        most = np.maximum.reduceat(np.where(own > 0, place, -1), begin)
        line = [c[begin] for c in line]
        kept = most >= 0
        line, low, high, least, most = [c[kept] for c in line], low[kept], high[kept], least[kept], most[kept]
        # the runs of neighbouring seeds, on whatever lines, that each stretch lies in
        width = int(k.max()) + 2
        known, where = np.unique(doc * width + k, return_index=True)
        cut = np.append(True, known[1:] != known[:-1] + 1)
        group = np.cumsum(cut) - 1
        firsts = np.flatnonzero(cut)
        lasts = np.append(firsts[1:], len(known)) - 1
        at_low, at_high = (np.searchsorted(known, line[0] * width + at) for at in (low, high))
        counted = seeds["words"].astype(np.int64)[where]
        words = np.append(0, np.cumsum(counted & _MANY))
        # a run of seeds that is no passage as a whole cannot become one
        enough = words[lasts + 1] - words[firsts] + (counted[lasts] >> 16) > WORDS
        # the words of a stretch but for its last piece
        short = enough[group[at_high]] & (words[at_high + 1] - words[at_low] <= WORDS if asked else True)
        after = np.where(short & (high - most == asked), np.minimum(more, known[lasts[group[at_high]]] % width - high), 0)
        before = np.where(short & (least - low == asked), np.minimum(more, low - known[firsts[group[at_low]]] % width), 0)
        places = []
        for count, base in ((after, high + 1), (before, low - before)):
            of = np.repeat(np.arange(len(low)), count)
            places.append((of, np.repeat(base - np.cumsum(count) + count, count) + np.arange(len(of))))
        of, at = (np.concatenate(c) for c in zip(*places))
        inside = at + line[4][of] >= 0
        of, at = of[inside], at[inside]
        # all that a text asks about one block of another goes into one row
        new = np.ones(len(low), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in line[:4]], axis=0)
        block = (at + line[4][of]) // BLOCK
        key = np.cumsum(new)[of] * (int(block.max(initial=0)) + 1) + block
        order = np.argsort(key, kind="stable")
        of, at, block, key = of[order], at[order], block[order], key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        asks = np.zeros(len(of), _ASK)
        asks["shift"], asks["at"] = line[4][of], at
        asks["first"] = first[where[np.searchsorted(known, line[0][of] * width + at)]]
        # a stretch counts with its last piece
        whole = words[at_high + 1] - words[at_low] + (counted[at_high] >> 16) > WORDS
        other = [line[1][of[head]] > 0, line[2][of[head]], line[3][of[head]]]
        sizes = np.diff(np.append(head, len(of)))
        spans = line[0][whole], low[whole], (high - low + 2)[whole], np.zeros(int(whole.sum()), bool)
        return rows(batch, *spans, line[0][of[head]], other, block[head], asks, sizes)

    return run


def _grown(listed: DataFrame) -> DataFrame:
    """All repeats ``(key, start, lines, chunk)``; stretches, in pieces, are grown until the earlier text differs."""
    places = stage(listed.mapInArrow(blocks, f"{_OTHER}, places binary"), "places")
    rows, answered, spans = listed, None, None
    for asked, then in zip((0, *GROW), (*GROW, None)):
        found = stage(rows.mapInArrow(stretches(asked, then - asked if then else 0), _GROWN), "stretches")
        some = found.where("start is not null").select(*_KEY, "start", "lines", "chunk")
        spans = some if spans is None else spans.unionByName(some)
        asks = found.where("start is null").select(*_KEY, "other", "block", "asks").join(places, ["other", "block"])
        equal = stage(asks.mapInArrow(answers, f"{_PLACE}, other struct<{_PLACE}>, equal binary"), "answers")
        if equal.isEmpty():
            break
        answered = equal if answered is None else answered.unionByName(equal)
        # texts without an answer in this round do not change any more
        lists = answered.join(equal.select(*_KEY).distinct(), _KEY, "left_semi").groupBy(*_KEY)
        lists = lists.agg(F.collect_list(F.struct("other", "equal")).alias("answers"))
        rows = listed.join(lists, _KEY)
    return spans


def repeated(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", hash_bits: int = 64
) -> DataFrame:
    """``(no_id, id, text_hash, start, lines, chunk)`` of every repeat that goes: chunks in lines, stretches in pieces.

    Any ``hash_bits`` give the same.
    """
    prepare(df.sparkSession)
    rows = df.select(*_key(F.col(f"`{id_col}`"), F.col(f"`{text}`")), F.col(f"`{text}`").alias("text"))
    return _grown(_candidates_again(rows, hash_bits))


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", hash_bits: int = 64
) -> DataFrame:
    """``df`` with repeated passages cut out of ``text``, and ``n_chars`` kept true if it is a column."""
    span = F.struct("start", "lines", "chunk")
    cuts = repeated(df, id_col, text, hash_bits).groupBy(*_KEY).agg(
        F.sort_array(F.collect_set(span)).alias("cuts")
    )
    rows = df.select(whole_rows(df).alias("_row"))
    rows = rows.select("_row", *_key(rows["_row"][id_col], rows["_row"][text])).join(cuts.hint("merge"), _KEY, "left")
    # texts that stay as they are need not be handed to a worker
    cut = _without(F.when(F.col("cuts").isNotNull(), F.col("_row")[text]), "cuts.start", "cuts.lines", "cuts.chunk")
    rows = rows.withColumn("_cut", cut)
    rows = rows.withColumn("_text", F.when(F.col("cuts").isNull(), F.col("_row")[text]).otherwise(F.col("_cut")))
    out = []
    for name in df.columns:
        value = F.col("_row")[name]
        if name == text:
            value = F.col("_text")
        elif name == "n_chars":
            same = F.col("_text").eqNullSafe(F.col("_row")[text])
            value = F.when(same, value).otherwise(F.length("_text").cast(df.schema[name].dataType))
        out.append(value.alias(name))
    return rows.select(*out)
