"""References against urljoin, signatures against hmac, canonical JSON of odd values."""

import hashlib
import hmac
import itertools
import json
from urllib.parse import urljoin

from pyspark.sql import functions as F

from sluice.functions import canonical, urls, web

BASES = ["http://a.example/b/c/d;p?q", "https://a.example", "https://a.example/", "http://a.example:8080/x/y/", "https://a.example/x/w/y/z?k=/../#f"]  # urljoin drops empty segments, which URLs of browsers keep
REFERENCES = ["g", "./g", "g/", "/g", "//h.example", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g?y/./x", "g#s/../x", "http://h.example/a/../b", "mailto:x@y", "a b/é"]


def test_references_as_urljoin_resolves_them(spark):
    rows = list(itertools.product(REFERENCES, BASES))
    got = spark.createDataFrame(rows, "ref string, base string").withColumn("url", urls.resolve(F.col("ref"), F.col("base"))).collect()
    for r in got:
        base = r["base"] if r["base"].count("/") > 2 else r["base"] + "/"
        want = urljoin(base, r["ref"]) if r["ref"] else base.split("#")[0]
        # urljoin leaves these as they are, browsers don't
        want = {"//h.example": f"{want}/", "http://h.example/a/../b": "http://h.example/b"}.get(r["ref"], want)
        assert r["url"] == want, (r["ref"], r["base"])


def test_events_urls_fall_back_in_order(spark):
    rows = [("../x", "https://o.example/a/b", "https://s.example", "https://o.example/x"), ("/x", "no url", None, "no url/x"), (None, "https://o.example", "https://s.example", "https://o.example"), ("x", None, "https://s.example/a/", "https://s.example/a/x"), (None, "", "https://s.example", "https://s.example/"), ("x", None, "bad", "bad"), ("x", None, None, urls.DEFAULT_URL), (None, None, "", urls.DEFAULT_URL)]
    frame = spark.createDataFrame(rows, "p string, o string, s string, want string").withColumn("got", urls.event_url(F.col("p"), F.col("o"), F.col("s")))
    assert [r for r in frame.collect() if r["got"] != r["want"]] == []


def test_signatures_equal_hmac(spark):
    for secret in ("k", "s" * 64, "ü" * 50):
        bodies = ["", "a", "é😀" * 100, "x" * 5000]
        sign = lambda b: hmac.new(secret.encode(), b.encode(), hashlib.sha1).hexdigest()  # noqa: B023, E731
        rows = [(b, sign(b), True) for b in bodies] + [(b, sign(b + "."), False) for b in bodies] + [("a", None, False), (None, sign(""), True), ("a", "", False)]
        frame = spark.createDataFrame(rows, "body string, s string, want boolean").withColumn("ok", web.verify_signature(F.col("body"), F.col("s"), secret))
        assert all(r["ok"] == r["want"] for r in frame.collect())
        assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    assert spark.range(1).select(web.verify_signature(F.lit("a"), F.lit("b"), None).alias("ok")).first()["ok"]


def test_canonical_json_at_three_depths(spark):
    value = {"b": 1, "a": {"z": [3, {"y": True, "x": "1", "w": None}], "c": {"e": 1.5, "d": "t"}}, "é": ""}

    def shuffled(v):
        return {k: shuffled(v[k]) for k in reversed(list(v))} if isinstance(v, dict) else [shuffled(x) for x in v] if isinstance(v, list) else v

    texts = [json.dumps(value), json.dumps(shuffled(value), indent=2), json.dumps(value, ensure_ascii=False)]
    others = ['{"a":1}', '{"a":"1"}', '{"a":true}', '{"a":"true"}', '{"a":null}', "{}", "[1,2]", "[2,1]", '"x"', "5"]
    bad = [None, "", "{broken", "{} x", '{"a":1,"a":2}', "1, 2"]
    rows = [(t,) for t in texts + others + bad]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(canonical.canonical_json(F.col("t"))).collect()]
    assert len(set(got[:3])) == 1 and got[0] == json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert got[3:13] == others and got[13:] == [None] * len(bad)


def test_dimensions_match_by_value_and_type(spark):
    rows = [(k, t) for k, t in enumerate(['{"a":1}', '{"a":"1"}', '{"a":true}', '{"a":null}', "{}", '{"a":{"y":2,"x":[1]}}', "bad", None])]
    frame = spark.createDataFrame(rows, "k int, dimensions string")
    for wanted, ids in ((1, [0]), ("1", [1]), (True, [2]), (None, [3]), ({"x": [1], "y": 2}, [5])):
        assert [r["k"] for r in canonical.where_dimensions(frame, {"a": wanted}).collect()] == ids, wanted
