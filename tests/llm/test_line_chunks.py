import hashlib
import itertools
from collections import defaultdict

import pytest

import __spark_entry__ as entry_module
from buildup.llm import line_chunks
from tests.llm.conftest import bag, rows


def order(place):
    return (place[0] is None, place[0] or 0, *place[1:])


def run(places, k):
    """Ends of the run of consecutive places around ``k``."""
    low = high = k
    while low - 1 in places:
        low -= 1
    while high + 1 in places:
        high += 1
    return low, high


def brute(data):
    """Texts without repeats, by comparing the texts of chunks, pairs and long pieces; equal rows are one document."""
    chunks, pairs, long = defaultdict(set), defaultdict(set), defaultdict(set)
    cut, joint = {}, {}
    for doc in {(r[0], r[1]) for r in data}:
        text = doc[1] or ""
        lines = text.split("\n")
        for start, n, _ in line_chunks.chunks(text):
            chunks["\n".join(lines[start : start + n])].add((*doc, start, n))
        cut[doc] = line_chunks.pieces(text) if len(text.split()) > 50 else []
        joint[doc] = [text[one[0] : two[1]] for one, two in zip(cut[doc], cut[doc][1:])]
        # where a pair is divided counts
        joint[doc] = [(p, one[1] - one[0], two[0] - one[1]) for p, one, two in zip(joint[doc], cut[doc], cut[doc][1:])]
        for k, p in enumerate(joint[doc]):
            pairs[p].add((*doc, k))
        for k, (a, b, _) in enumerate(cut[doc]):
            if len(text[a:b].split()) > 50:
                long[text[a:b]].add((*doc, k))
    gone_lines, gone_pieces = defaultdict(set), defaultdict(set)
    for found in chunks.values():
        for *doc, start, n in sorted(found, key=order)[1:]:
            gone_lines[tuple(doc)] |= set(range(start, start + n))
    for found in long.values():
        for *doc, k in sorted(found, key=order)[1:]:
            gone_pieces[tuple(doc)].add(k)
    for doc, own in joint.items():
        lines = defaultdict(set)
        for k, p in enumerate(own):
            *other, place = min(pairs[p], key=order)
            if (*other, place) != (*doc, k):
                lines[tuple(other), place - k].add(k)
        for (other, shift), seeds in lines.items():
            same = lambda i: 0 <= i < len(own) and 0 <= i + shift < len(joint[other]) and own[i] == joint[other][i + shift]
            words = lambda low, high: sum(len(doc[1][a:b].split()) for a, b, _ in cut[doc][low : high + 1])

            def grown(equal, reach):
                out = set(equal)
                for k in equal if reach == 2 else seeds:
                    for step in (1, -1):
                        way = list(itertools.takewhile(same, (k + step * i for i in range(1, reach + 1))))
                        if reach == 2:
                            out.update(way)
                            continue
                        # further only beyond two equal pairs after the last seed, from a stretch that is short
                        low, high = run(equal, k)
                        ends = [i for i in range(low, high + 1) if i in seeds]
                        edge = (ends[-1], high) if step == 1 else (ends[0], low)
                        if edge[0] == k and abs(edge[1] - k) == 2 and words(low, high) <= 50:
                            out.update(way)
                return out

            equal = grown(grown(seeds, 2), line_chunks.GROW[-1])
            for k in seeds:
                low, high = run(equal, k)
                if words(low, high + 1) > 50:
                    gone_pieces[doc] |= set(range(low, high + 2))
    out = []
    for doc in [(r[0], r[1]) for r in data]:
        text = doc[1]
        cuts = [(i, 1, True) for i in gone_lines[doc]]
        if gone_pieces[doc]:
            kept, last = [], None
            for k, (a, b, line) in enumerate(cut[doc]):
                if line not in gone_lines[doc] and k not in gone_pieces[doc]:
                    if line == last:
                        kept[-1] += text[cut[doc][k - 1][1] : b]
                    else:
                        kept.append(text[a:b])
                    last = line
            text = "\n".join(kept)
        elif cuts:
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone_lines[doc])
        out.append((doc[0], text))
    return sorted(out, key=repr)


def test_boundaries_do_not_shift():
    passage = "\n".join(f"passage line {i}" for i in range(40))
    alone = {h for _, _, h in line_chunks.chunks(passage)}
    for before in ("", "x\n", "x\ny\nz\n"):
        inside = {h for _, _, h in line_chunks.chunks(before + passage + "\nend")}
        assert len(alone - inside) <= 2
    assert len(alone) > 5


def test_chunks_cover_lines_once():
    text = "\n".join(str(i * i) for i in range(200))
    seen = [i for start, n, _ in line_chunks.chunks(text) for i in range(start, start + n)]
    assert len(seen) == len(set(seen))
    assert all(n > 1 for _, n, _ in line_chunks.chunks(text))
    assert line_chunks.chunks(None) == line_chunks.chunks("") == line_chunks.chunks("one") == []


@pytest.mark.parametrize("hash_bits", [64, 3])
def test_equals_brute_force(clashing, hash_bits):
    """With three hash bits nearly all chunks collide, and only equal bytes may go."""
    found = line_chunks.dedup_lines(clashing, hash_bits=hash_bits)
    assert found.schema == clashing.schema
    assert bag(found, "doc_id", "text") == brute(rows())
    texts = {r[0]: r[1] for r in rows()}
    for r in found.select("doc_id", "text", "n_chars").collect():
        if r["text"] is not None and r["text"] != texts[r["doc_id"]]:
            assert r["n_chars"] == len(r["text"])


def test_empty(empty):
    assert line_chunks.dedup_lines(empty).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in brute(data)}
    found = entry_module.queries()["op9_line_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["text_sha256"] for r in found} == expected


def planted():
    """Every passage of 1 to 10 lines and over 50 words in four documents, each time in other surroundings."""
    out, passages = [], {}
    for n in range(1, 11):
        size = 60 // n + 1
        passages[n] = [" ".join(f"p{n}l{i}w{j}" for j in range(size)) for i in range(n)]
        for copy in range(4):
            own = [[f"own {n} {copy} {side} {i}" for i in range(1 + copy)] for side in "ab"]
            out.append((100 * n + copy, "\n".join(own[0] + passages[n] + own[1])))
    return out, passages


def test_planted_passages_go_whole(spark):
    data, passages = planted()
    got = dict(bag(line_chunks.dedup_lines(spark.createDataFrame(data, "doc_id bigint, text string")), "doc_id", "text"))
    for doc_id, text in data:
        n, copy = divmod(doc_id, 100)
        kept = [x for x in text.split("\n") if not copy or x not in passages[n]]
        assert got[doc_id] == "\n".join(kept)


def test_passages_inside_a_line_and_in_copies(spark):
    sentences = " ".join(" ".join(f"s{i}w{j}" for j in range(20)) + "." for i in range(4))
    copy = "\n".join([f"line {i} " + " ".join(f"c{i}w{j}" for j in range(9)) for i in range(9)])
    data = [
        (1, f"Before it. {sentences} After it."),
        (2, f"Something else! {sentences} And the end.\nlast"),
        (3, sentences),
        (4, copy),
        (5, copy),
        (6, "too short\n" + copy.split("\n")[0] + "\nfor a passage"),
    ]
    got = dict(bag(line_chunks.dedup_lines(spark.createDataFrame(data, "doc_id bigint, text string")), "doc_id", "text"))
    assert got[2] == "Something else! And the end.\nlast"
    assert got[3] == got[5] == ""
    assert all(got[i] == t for i, t in data if i in (1, 4, 6))


@pytest.mark.parametrize("hash_bits", [64, 3])
def test_passages_do_not_depend_on_hashes(spark, hash_bits):
    data = planted()[0][::2] + rows()
    df = spark.createDataFrame([(r[0], r[1]) for r in data], "doc_id bigint, text string").repartition(3)
    assert bag(line_chunks.dedup_lines(df, hash_bits=hash_bits), "doc_id", "text") == brute(data)


def sentence(name, words=20):
    return " ".join(f"{name}w{j}" for j in range(words)) + "."


def test_stitched_text_stays(spark):
    """Forty words of one text and forty of another are no repeated passage."""
    own = [sentence(f"own{i}", 30) for i in range(3)]
    s = [sentence(f"s{i}") for i in range(4)]
    data = [(1, f"{own[0]} {s[0]} {s[1]}"), (2, f"{own[1]} {s[2]} {s[3]}"), (3, " ".join([own[2], *s]))]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert bag(line_chunks.dedup_lines(df), "doc_id", "text") == data == brute(data)


def test_grows_over_seeds_that_first_stood_elsewhere(spark):
    """A passage goes whole although parts of it stand in still earlier texts, however far they reach."""
    s = [sentence(f"s{i}", 10) for i in range(130)]
    data = [(i, " ".join([sentence(f"a{i}", 60), *s[3 * i : 3 * i + 3]])) for i in range(40) if i != 20]
    data += [(100, " ".join([sentence("b", 60), *s[:125]])), (101, " ".join([sentence("c", 60), *s, sentence("d", 9)]))]
    expected = brute(data)
    assert dict(expected)[101].split() == [*sentence("c", 60).split(), *" ".join(s[125:]).split(), *sentence("d", 9).split()]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    assert bag(line_chunks.dedup_lines(df), "doc_id", "text") == expected


def test_a_text_asks_once_about_a_block(spark, monkeypatch):
    """Stretches grow by one joined row for each text and block asked, not by one for each pair of pieces."""
    answers, real = [], line_chunks.stage

    def counted(df, name):
        out = real(df, name)
        if name == "answers":
            answers.append(out.count())
        return out

    monkeypatch.setattr(line_chunks, "stage", counted)
    short, long = (" ".join(f"{kind} {i}." for i in range(n)) for kind, n in (("p", 6), ("q", 60)))
    # pairs of the second part first occur elsewhere, so the first part is grown over them place by place
    data = [(0, long), (1, f"{short} {long}"), *((i, f"own {i}. {short} {long}") for i in range(2, 22))]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    assert bag(line_chunks.dedup_lines(df), "doc_id", "text") == brute(data)
    assert 0 < sum(answers) <= 4 * len(data)


@pytest.mark.parametrize("together", [1, 7, 1 << 16])
def test_lists_are_whole_however_rows_arrive(together, monkeypatch):
    import pyarrow as pa

    first = {"no_id": False, "id": 0, "text_hash": 1, "start": 0}
    hits = [
        {"no_id": False, "id": i, "text_hash": i, "start": k, "lines": 2, "words": 3, "h": k, "chunk": False, "first": first}
        for i in range(6)
        for k in range(5 * i)
        for _ in range(2)
    ]
    monkeypatch.setattr(line_chunks, "TOGETHER", together)
    batches = [pa.RecordBatch.from_pylist(hits[i : i + 4]) for i in range(0, len(hits), 4)]
    found = [row for batch in line_chunks._pack(iter(batches)) for row in batch.to_pylist()]
    assert [(row["id"], len(row["hits"]) // line_chunks._HIT.itemsize) for row in found] == [(i, 5 * i) for i in range(1, 6)]
