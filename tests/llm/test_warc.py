import base64
import gzip
import hashlib

import numpy as np

from gridloom.llm import queries, warc

SF = "/root/testdata/sf0.01"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows):
    first = {}
    for page, html in rows:
        data = (html or "").encode()
        if page is not None:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        known = page is not None and page > first[data]
        out.append((page, len(data), digest(data), "revisit" if known else "response", first[data] if known else None))
    return sorted(out, key=str)


def test_query_returns_every_page(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op1_warc_salvage(spark, SF).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_nulls_ties_repeats_and_empty_payloads(spark, tmp_path):
    rows = [(5, "u", "same"), (3, "u", "same"), (9, None, None), (7, "x\r\ny", ""), (None, "n", "same"), (4, "u", "é" * 70_000), (6, "v", "WARC/1.1\r\n\x1f\x8b\x08 in the text\r\n\r\n"), (5, "u", "same")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op1_warc_salvage(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute([(p, h) for p, _, h in rows])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op1_warc_salvage(spark, str(tmp_path)).count() == 0


def member(i, payload):
    return warc.record_bytes("response", f"urn:page:{i}", "http://a", payload)


def test_salvage_finds_records_after_damage_and_logs_the_gap(spark, tmp_path):
    parts = [member(i, b"payload %d " % i * 500) for i in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = b"".join([parts[0], parts[1], bytes(broken), parts[3], b"junk WARC/1.1 junk", parts[4], parts[5][:40]])
    (tmp_path / "a.warc.gz").write_bytes(data)
    found = warc.read_archives(spark, f"file://{tmp_path}/a.warc.gz")
    assert sorted(r.record_id for r in warc.records(found).collect()) == ["urn:page:0", "urn:page:1", "urn:page:3", "urn:page:4"]
    gaps = sorted((r.offset, r.length) for r in warc.gaps(found).collect())
    begin = len(parts[0]) + len(parts[1])
    junk = begin + len(broken) + len(parts[3])
    assert gaps == [(begin, len(broken)), (junk, 18), (junk + 18 + len(parts[4]), 40)]
    assert sum(length for _, length in gaps) + sum(len(parts[i]) for i in (0, 1, 3, 4)) == len(data)


def test_salvage_of_uncompressed_records(spark, tmp_path):
    import zlib

    plain = [zlib.decompress(member(i, b"x" * i), 31) for i in range(3)]
    data = plain[0] + plain[1].replace(b"WARC-Type", b"WARC-Tipe", 1)[:-3] + b"\n" + plain[2]
    records = [x.record_id for _, _, items in warc.salvage(data) for _, x, _ in items if not isinstance(x, str)]
    assert records == ["urn:page:0", "urn:page:2"]


def plain(i, payload=b"some text"):
    import zlib

    return zlib.decompress(member(i, payload), 31)


def ids(data):
    return [x.record_id for _, _, items in warc.salvage(data) for _, x, _ in items if not isinstance(x, str)]


def reasons(data):
    return [(at, length, inner, x) for at, length, items in warc.salvage(data) for inner, x, _ in items if isinstance(x, str)]


def test_uncompressed_record_right_after_a_truncated_one():
    cut = plain(1, b"y" * 300)[:-150]
    data = plain(0) + cut + plain(2)
    assert ids(data) == ["urn:page:0", "urn:page:2"]
    assert [r[:2] for r in reasons(data)] == [(len(plain(0)), len(cut))]


def test_first_record_of_a_gzip_member_is_damaged():
    import gzip

    first = plain(0).replace(b"some text", b"some tixt")
    data = gzip.compress(first + plain(1) + plain(2)) + member(3, b"x")
    assert ids(data) == ["urn:page:1", "urn:page:2", "urn:page:3"]
    assert [r[2:] for r in reasons(data)] == [(0, "block digest differs")]


def test_broken_member_keeps_what_is_before_the_damage():
    import gzip
    import random

    noise = lambda i: random.Random(i).randbytes(30_000)
    records = [plain(i, noise(i)) for i in range(4)]
    for level in (0, 6):
        whole = gzip.compress(b"".join(records), level)
        for data in (whole[: len(whole) * 5 // 8], whole[: len(whole) * 5 // 8] + member(9, b"later")):
            assert ids(data)[:2] == ["urn:page:0", "urn:page:1"]
            assert ids(data)[2:] == (["urn:page:9"] if data.endswith(member(9, b"later")) else [])
            assert len(records[0]) + len(records[1]) in [r[2] for r in reasons(data)]
    broken = bytearray(gzip.compress(b"".join(records), 6))
    broken[-6] ^= 0xFF
    assert ids(bytes(broken) + member(9, b"later")) == [*(f"urn:page:{i}" for i in range(4)), "urn:page:9"]
    bare = re_record(b"".join(records[:1]))
    assert ids(gzip.compress(bare)) == ["urn:page:0"]
    assert ids(gzip.compress(bare + noise(5))[:-20_000]) == []


def re_record(data):
    """The record without digests."""
    import re

    return re.sub(rb"WARC-(Block|Payload)-Digest: [^\r]*\r\n", b"", data)


def items_of(data):
    return [x for _, _, items in warc.salvage(data) for _, x, _ in items]


def test_odd_numbers_and_folded_lines_in_headers():
    good, odd = plain(1), []
    for value in (b"\xc2\xb2", b"9" * 5000, b"-1", b"1e3", b""):
        odd.append(plain(2).replace(b"Content-Length: ", b"Content-Length: " + value + b"x" if not value else b"Content-Length: " + value))
    for bad in odd:
        assert ids(bad + good) == ids(good)
    folded = plain(3).replace(b"WARC-Target-URI: ", b"WARC-Target-URI:\r\n ")
    assert ids(folded) == ids(plain(3))


def test_hex_and_other_digests():
    block = b"hello"
    for name in ("sha1", "sha256", "md5"):
        for good in (True, False):
            value = hashlib.new(name, block if good else b"other").hexdigest()
            record = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nWARC-Block-Digest: {name}:{value}\r\nContent-Length: 5\r\n\r\n".encode() + block + b"\r\n\r\n"
            assert [not isinstance(x, str) for x in items_of(record)] == [good]


def test_members_of_several_records_with_the_last_damaged():
    first, last = plain(1), bytearray(plain(2))
    last[-10] ^= 1
    assert ids(gzip.compress(first + bytes(last))) == ids(first)
    whole = gzip.compress(plain(1) + plain(2) + plain(3))
    broken = bytearray(whole)
    broken[-6] ^= 1  # the CRC
    assert ids(bytes(broken)) == ids(plain(1) + plain(2) + plain(3))


def test_no_flipped_bit_ends_the_reader():
    rng = np.random.default_rng(7)
    archives = [b"".join(member(i, b"payload %d " % i * 20) for i in range(3)), plain(1) + plain(2), gzip.compress(plain(1) + plain(2))]
    for turn in range(10_000):
        data = bytearray(archives[turn % 3])
        data[rng.integers(len(data))] ^= 1 << rng.integers(8)
        assert len(items_of(bytes(data))) >= 1


def test_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "same", "a", "b", "c"), (2, "u", "same", "a", "b", "c"), (3, "u", "own", None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, payload string, digest string, refers_to string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op1_warc_salvage(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute([r[:1] + r[2:3] for r in rows])
