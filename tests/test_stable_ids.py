"""Identifiers of pages numbered past two bytes, against FNV-1a over the bytes written out by hand."""

import struct

from sievework.plans import knowing


def _fnv(data):
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % 2**64
    return f"{h:016x}"


def test_numbers_past_two_bytes(spark, tmp_path):
    pages = [0, 1, 65535, 65536, 70003, 16777217]
    spark.createDataFrame([(n, f"https://example.org/{n}") for n in pages], "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    text = lambda s: struct.pack("<I", len(s)) + s.encode()
    for r in knowing.stable_ids(spark, str(tmp_path)).collect():
        n, url = r.page_id, f"https://example.org/{r.page_id}"
        title = "" if n % 7 == 3 else f"Page {n % 7}"
        doc = "doc_" + _fnv(b"x\0doc\0" + text(url) + text(title) + text("html"))
        assert r.chunk == "chunk_" + _fnv(b"x\0chunk\0" + text(doc) + struct.pack("<Q", n) + text("A/B"))
        line = lambda v: struct.pack("<I", 0 if v is None else v or 2**32 - 1)
        assert r.span == "span_" + _fnv(b"x\0code_span\0" + text("loc") + line(None if n % 3 == 1 else n % 3) + line(n) + text(title))
        assert r.plan == _fnv(b"x\0request_plan\0" + text("web_fetch") + text(url) + struct.pack("<Q", n))
