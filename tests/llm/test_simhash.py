import random

import numpy as np
import pytest
import xxhash

from buildup.llm import simhash
from buildup.llm.components import components
from tests.llm.conftest import bag, rows


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, distance):
    return [
        (i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance
    ]


def spread(seed, size):
    """Random fingerprints and clusters around some of them."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(size)]
    for centre in out[:6]:
        near = centre
        for _ in range(8):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                near ^= 1 << bit
            out.append(near)
    return sorted(set(out))


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5])
@pytest.mark.parametrize("parts", [1, 4])
def test_block_links_join_what_all_pairs_join(distance, parts):
    fps = spread(distance, 60)
    index = {f: i for i, f in enumerate(fps)}
    bits = (3, 17, 40)
    key = sum(1 << b for b in bits)
    found = []
    for block in {sum(1 << b for b in bits if n >> i & 1) for i, b in enumerate(bits) for n in range(8)} | {
        sum(1 << b for i, b in enumerate(bits) if n >> i & 1) for n in range(8)
    }:
        near = [f for f in fps if ((f ^ block) & key).bit_count() <= (distance + 1) // 2]
        for part in range(parts):
            a, b = simhash.block_links(np.array(near, np.uint64), block, bits, distance, part, parts)
            found += [(index[int(x)], index[int(y)]) for x, y in zip(a, b)]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 * distance for a, b in found)
    assert roots(len(fps), found) == roots(len(fps), linked(fps, distance))


@pytest.mark.parametrize("block_size", [4])
def test_links_over_spark(spark, block_size):
    fps = spread(11, 40) + [0, 1, 3, 7, 15, 31]
    frame = spark.createDataFrame([(simhash._signed(f),) for f in sorted(set(fps))], "fp bigint")
    links = simhash.fingerprint_links(frame, 4, block_size)
    found = {r["node"] % 2**64: r["root"] % 2**64 for r in components(links).collect()}
    fps = sorted(set(fps))
    expected = roots(len(fps), linked(fps, 4))
    groups = {}
    for f, r in zip(fps, expected):
        groups.setdefault(r, set()).add(f)
    got = {}
    for f in fps:
        got.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(201)}
    assert components(links.limit(0)).count() == 0


def test_equals_brute_force(clashing):
    data = rows()
    fps = [fingerprint(r[1]) for r in data]
    root = roots(len(data), linked(fps, 4))
    least = {}
    for r, row in zip(root, data):
        if row[0] is not None:
            least[r] = min(least.get(r, row[0]), row[0])
    expected = sorted(
        [(row[0], simhash._signed(f), least.get(r)) for row, f, r in zip(data, fps, root)], key=repr
    )
    assert bag(simhash.near_duplicates(clashing), "doc_id", "fp", "component_id") == expected


def test_keeps_one_row_of_each_group(clashing):
    data = rows()
    groups = set(roots(len(data), linked([fingerprint(r[1]) for r in data], 4)))
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(groups)
    assert ids.count(3) == 1 and 106 not in ids and 107 not in ids


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
