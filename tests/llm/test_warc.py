import base64
import gzip
import hashlib
import random

import pytest

import __spark_entry__ as entry_module
from buildup.llm import warc
from buildup.session import new_table_path

PAGE = "page_id bigint, url string, html string"


def pages():
    rng = random.Random(0)
    text = lambda n: "".join(chr(rng.randint(32, 1200)) for _ in range(n))
    out = [(i, f"http://a/{i}", text(rng.randint(0, 3000))) for i in range(60)]
    out += [(i, f"http://a/{i}", "same") for i in (70, 71, 72)]
    out += [(80, "u\r\nX: 1", None), (81, None, ""), (None, "n", "no id"), (90, "", "same \r\n\r\n WARC/1.1")]
    out += [(91, "http://big", "y" * 17_000_000), (72, "http://a/72", "same")]
    return out


def expected(rows, min_bytes=0):
    largest, out = {}, []
    for page_id, _, html in rows:
        body = (html or "").encode()
        if page_id is not None and len(body) >= min_bytes:
            largest[body] = max(largest.get(body, page_id), page_id)
    for page_id, _, html in rows:
        body = (html or "").encode()
        first = largest.get(body, page_id)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        again = len(body) >= min_bytes and first != page_id
        out.append((page_id, len(body), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


COLUMNS = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("split_bytes", [100_000, 1 << 24])
def test_round_trip(spark, split_bytes):
    data = pages()
    path = new_table_path(spark, "warc")
    warc.write(spark.createDataFrame(data, PAGE).repartition(2), path)
    found = warc.read(spark, path, split_bytes).collect()
    assert sorted([tuple(r[c] for c in COLUMNS) for r in found], key=repr) == expected(data)
    bodies = {r["record_id"]: r["payload"] for r in found if r["record_type"] == "response"}
    for page_id, _, html in data:
        if page_id in bodies:
            assert bodies[page_id] == (html or "").encode()
    assert {r["target_uri"] for r in found if r["record_id"] == 80} == {"u%0D%0AX: 1"}
    for r in found[:5]:
        archive = warc.Archive(r["path"]).file
        archive.seek(r["offset"])
        assert gzip.decompress(archive.read(r["size"])).startswith(b"WARC/1.1\r\n")


def test_small_payloads_are_not_compared(spark):
    data = pages()[60:]
    path = new_table_path(spark, "warc")
    warc.write(spark.createDataFrame(data, PAGE), path, min_bytes=5)
    found = warc.read(spark, path, payloads=False).collect()
    assert sorted([tuple(r[c] for c in COLUMNS) for r in found], key=repr) == expected(data, 5)


def test_false_magic_and_archives_inside_payloads(tmp_path):
    """A payload that does not compress holds an archive byte for byte; its records are not the file's."""
    inner = b"".join(
        warc.member(warc.record(i, "u", b"x%d" % i, hashlib.sha1(b"x%d" % i).hexdigest(), 2, None, "d")) for i in range(30)
    )
    noise = random.Random(1).randbytes(4000)
    body = noise + b"\x1f\x8b\x08\x00" + noise + inner
    sizes = []
    stored = lambda i: warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    out = b""
    for i in range(4):
        packer = stored(i)
        data = warc.record(100 + i, "u", body, hashlib.sha1(body).hexdigest(), len(body), None, "d")
        out += packer.compress(data) + packer.flush()
        sizes.append(len(out))
    file = tmp_path / "a.warc.gz"
    file.write_bytes(out)
    starts = [0, *sizes[:-1]]
    for step in (700, 5000, 10**6):
        found, behind = [], 0
        for start in range(0, len(out), step):
            own = list(warc.owned(f"file:{file}", start, min(len(out), start + step), behind))
            found += [at for at, _, _ in own]
            behind = max([behind, *[at + size for at, size, _ in own]])
        assert found == starts


def test_archives_inside_payloads_over_spark(spark, tmp_path):
    inner = b"".join(
        warc.member(warc.record(i, "u", b"x", hashlib.sha1(b"x").hexdigest(), 1, None, "d")) for i in range(30)
    )
    packer = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    data = warc.record(100, "u", inner, hashlib.sha1(inner).hexdigest(), len(inner), None, "d")
    (tmp_path / "a.warc.gz").write_bytes(packer.compress(data) + packer.flush())
    found = warc.read(spark, str(tmp_path), 1500).collect()
    assert [r["record_id"] for r in found] == [100]


def test_a_changed_payload_is_noticed():
    data = warc.record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), 3, None, "d")
    with pytest.raises(ValueError):
        warc.parse(data)


def test_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], PAGE)
    path = new_table_path(spark, "warc")
    warc.write(empty, path)
    assert warc.read(spark, path).count() == 0
    extra = spark.createDataFrame(pages()[60:64], PAGE).select("*", *[F.lit(1).alias(c) for c in ("id", "body", "key")])
    path = new_table_path(spark, "warc")
    warc.write(extra, path)
    assert warc.read(spark, path).count() == 4


def test_query(spark, sf_dir):
    found = entry_module.queries()["op8_warc"](spark, sf_dir).collect()
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted([tuple(r[c] for c in names) for r in found], key=repr) == expected(data)
