import hashlib
import re
from datetime import UTC, datetime

import pytest

from sluice.llm import warc

PAGES = "page_id long, url string, html string"


def truth(pages):
    rows = [(p, (h or "").encode()) for p, _, h in pages]
    first = {}
    for p, body in rows:
        if len(body) >= 100 and p is not None:
            first[body] = min(first.get(body, p), p)
    out = []
    for p, body in rows:
        again = p is not None and len(body) >= 100 and first[body] != p
        out.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


def result(frame):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in frame.collect()), key=str)


def odd_pages():
    big, breaks = "x" * 150, "a\r\n\r\nb\r\n" * 30 + "\r\n\r\n"
    rows = [(k, "http://a/", big) for k in (5, 3, 9, 3)]
    rows += [(20, None, None), (21, "", ""), (22, "http://x/\r\n\r\ny", breaks), (23, "u", breaks), (24, "u", "\r\n\r\n"), (25, "u", "é" * 60), (26, "u", "short"), (27, "u", "short"), (None, "u", big)]
    return [*rows, (28, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 20), (29, "u", "long " * 400_000)]


def test_small_pages(spark, small):
    pages = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert result(warc.op1_warc_revisits(spark, small)) == truth(pages)


def test_odd_pages(spark, tmp_path):
    pages = odd_pages()
    clash = {c: "'mine'" for c in ("digest", "n_bytes", "first", "r_page", "value", "payload_digest", "record_type")}
    spark.createDataFrame(pages, PAGES).selectExpr("*", *[f"{v} AS {c}" for c, v in clash.items()]).write.parquet(f"{tmp_path}/pages.parquet")
    assert result(warc.op1_warc_revisits(spark, str(tmp_path))) == truth(pages)


def test_payloads_come_back_whole(spark, tmp_path):
    pages = [p for p in odd_pages() if p[0] is not None]
    warc.write_archives(spark.createDataFrame(pages, PAGES), f"{tmp_path}/w")
    html = {}
    for p, _, h in pages:
        html.setdefault(p, (h or "").encode())
    for r in warc.read_archives(spark, f"{tmp_path}/w").collect():
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == html[r["page_id"]]


def test_headers_are_fresh(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200)], PAGES), f"{tmp_path}/w")
    text = "".join(r[0] + "\n" for r in spark.read.text(f"{tmp_path}/w").collect())
    dates = set(re.findall("WARC-Date: (.*?)\r?\n", text))
    assert len(dates) == 1 and abs((datetime.now(UTC) - datetime.fromisoformat(dates.pop().strip())).total_seconds()) < 300
    assert text.count("WARC-Block-Digest: sha256:") == 2 and text.count("WARC-Type: revisit") == 1


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op1_warc_revisits(spark, str(tmp_path)).count() == 0


def test_truncated_archives_are_an_error():
    with pytest.raises(ValueError):
        list(warc.records_of(iter([("f", b"WARC/1.1\r\nContent-Length: 50"), ("f", b"abc")])))
