import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from framewright.llm import warc

from ..compare import differences, duck


def test_same_as_sql(spark, sf_dir):
    assert differences(warc.op6_warc(spark, sf_dir), duck(sf_dir), warc.OP6_SQL) == []


def test_pages(spark, sf_dir):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = warc.op6_warc(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        html = pages[r["page_id"]]
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode() and r["intact"]
        to = None if first[html] == r["page_id"] else first[html]
        assert (r["record_type"], r["refers_to"]) == ("response" if to is None else "revisit", to)


PAGES = [(1, "http://a/", "same"), (2, "http://b/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u\r\nv", ""), (5, "x", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.1"), (6, "x", "😀\r\n\r\n"), (None, "y", "alone")]


def test_odd_pages(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, capture_id string")
    got = warc.captures(pages).collect()
    assert len(got) == len(PAGES) and all(r["request"] and r["metadata"] for r in got)
    kinds = defaultdict(list)
    for r in got:
        kinds[int(r["metadata"]["fields"]["page-id"] or -1)].append(r["response"]["record_type"])
    assert kinds[1] == ["response"] and kinds[2] == ["revisit"] * 2 and sorted(kinds[3] + kinds[4]) == ["response", "revisit"] and kinds[5] == kinds[6] == kinds[-1] == ["response"]
    assert warc.captures(pages.limit(0)).count() == 0
    assert all(r["response"]["record_type"] == "response" for r in warc.captures(pages.where("page_id IN (3, 4)"), 1).collect())


def test_null_and_least_ids(spark, tmp_path):
    """A null page_id is smaller than all others, and no id stands for it."""
    low = -(1 << 63)
    spark.createDataFrame([(None, "u", "x"), (low, "u", "x"), (low, "u", "y"), (7, "u", "y")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.op6_warc(spark, str(tmp_path)).collect()}
    assert got == {(None, "response", None), (low, "revisit", None), (low, "response", None), (7, "revisit", low)}


def test_records_are_read_one_by_one():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 6\r\n\r\na\r\n\r\nb\r\n\r\n"
    members = gzip.compress(record) + gzip.compress(record)
    for data in (record * 2, gzip.compress(record * 2), members):
        assert [(h["warc-type"], b) for h, b in warc.records_of(data)] == [("metadata", b"a\r\n\r\nb")] * 2
    for broken in (record[:-3], record[:-8], b"x" + record):
        with pytest.raises(ValueError):
            list(warc.records_of(broken))


def test_assembly_keeps_lone_records(spark):
    blank = [None] * 12
    record = lambda i, kind, to: tuple([i, kind, to, *blank[3:11], {}])
    rows = [record("<m>", "response", None), record("<r>", "request", "<m>"), record("<r0>", "request", "<m>"), record("<x>", "metadata", "<gone>"), record("<n>", "revisit", None)]
    got = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert set(got) == {"<m>", "<n>"} and got["<m>"]["request"]["record_id"] == "<r0>" and got["<m>"]["metadata"] is None and got["<n>"]["request"] is None
