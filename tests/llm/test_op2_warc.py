import base64
import hashlib

import pytest

from curatrix.llm import op2_warc_revisit as op
from curatrix.staging import shared_dir

SCHEMA = "page_id bigint, url string, html string, digest int"


def brute(rows):
    at = lambda i: -(2**63) if i is None else i
    first = {}
    for i, _, h, _ in rows:
        first[h or ""] = min(first.get(h or "", at(i)), at(i))
    out = []
    for i, _, h, _ in rows:
        p, f = (h or "").encode(), first[h or ""]
        own = at(i) == f
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if own else "revisit", None if own or f == -(2**63) else f))
    return sorted(out, key=str)


def test_archives_against_brute_force(spark):
    rows = [
        (3, "http://a b", "x\r\n\r\ny", 1), (1, "u\r\nWARC-Type: x", "x\r\n\r\ny", 2), (2, None, None, 3), (7, "n", "", 4), (5, "d", "é", 5), (5, "d", "é", 5), (5, "d", "other", 6),
        (6, "z", "WARC/1.1\r\nContent-Length: 3\r\n\r\n", 7), (8, "l", "long " * 50000, 8), (None, "q", "nobody", 9), (9, "q", "nobody", 10),
    ]
    path = shared_dir(spark, "warc-test")
    op.write_archives(spark.createDataFrame(rows, SCHEMA), path)
    got = op.read_archives(spark, path)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(rows)


def records(spark, path):
    """(file, headers) of every record, each the only one of its gzip member."""
    out = []
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).collect():
        for m in op.members(bytes(r["content"])):
            found = list(op.parse_records(m))
            assert len(found) <= 1
            out += [(r["path"], head) for head, _ in found]
    return out


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_form_of_archives(spark, limit):
    rows = [(1, "http://a", "x", 0), (2, "http://b", "x", 0), (3, "http://c", "y", 0), (3, "http://d", "y", 0), (4, "http://e", "y", 0), (5, "f", "alone", 0)]
    path = shared_dir(spark, "warc-test")
    op.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), path, broadcast_bytes=limit)
    found = records(spark, path)
    ids = [h["WARC-Record-ID"] for _, h in found]
    assert len(set(ids)) == len(ids) and all(next(h for f, h in found if f == file)["WARC-Type"] == "warcinfo" for file, _ in found)
    by = {h["WARC-Target-URI"]: h for _, h in found if h["WARC-Type"] != "warcinfo"}
    assert {u: h["WARC-Type"] for u, h in by.items()} == {"http://a": "response", "http://b": "revisit", "http://c": "response", "http://d": "response", "http://e": "revisit", "f": "response"}
    assert by["http://b"]["WARC-Refers-To"] == by["http://a"]["WARC-Record-ID"] and by["http://b"]["WARC-Refers-To-Target-URI"] == "http://a"
    assert "WARC-Refers-To" not in by["http://e"] and by["http://e"]["WARC-Refers-To-Target-URI"] == "http://c"


def test_clashing_columns_and_names_with_dots(spark):
    df = spark.createDataFrame([(1, "u", "p", 1, 2), (2, "u", "p", 3, 4)], "`p.id` int, `x.url` string, `x.html` string, sha1 int, tied int")
    path = shared_dir(spark, "warc-test")
    op.write_archives(df, path, page_id="p.id", url="x.url", html="x.html")
    assert sorted(r["record_type"] for r in op.read_archives(spark, path).collect()) == ["response", "revisit"]


def test_archives_are_bounded(spark):
    import random

    r = random.Random(1)
    rows = [(i, f"http://p/{i}", "".join(r.choice("abcdefghij0123456789") for _ in range(2000)), i) for i in range(1500)]
    path = shared_dir(spark, "warc-test")
    op.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, file_bytes=160_000)
    sizes = [f["length"] for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("length").collect()]
    # A block is over its share by a record at most, and there is a separator after each.
    assert len(sizes) > 8 and max(sizes) <= 160_000 + op.BLOCKS * 2200
    got = op.read_archives(spark, path)
    assert sorted((tuple(x) for x in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(rows)


def test_members_that_are_cut_off():
    whole = op._member(["WARC-Type: response"], b"block")
    assert [len(list(op.parse_records(m))) for m in op.members(whole + op.EMPTY_MEMBER.encode("latin-1") + whole)] == [1, 0, 1]
    with pytest.raises(ValueError, match="cut off"):
        list(op.members(whole[:-3]))


def test_empty_table(spark):
    path = shared_dir(spark, "warc-test")
    op.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert op.read_archives(spark, path).count() == 0


def test_small_payloads_are_never_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab", 0), (2, "u", "ab", 0), (3, "u", "abc", 0), (4, "u", "abc", 0)], SCHEMA)
    path = shared_dir(spark, "warc-test")
    op.write_archives(df, path, min_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in op.read_archives(spark, path).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_parser_refuses_broken_archives():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in op.parse_records(good * 2)] == [b"abc"] * 2
    for bad in (good[:-2], good.replace(b": 3", b": 2"), b"junk\r\n\r\n" + good):
        with pytest.raises(ValueError):
            list(op.parse_records(bad))
