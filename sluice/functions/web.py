"""URL, secret and hash functions, all built of Spark's own expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLETS = "•" * 4


def mask_secret(value: Column) -> Column:
    """None for nothing, four bullets for a short secret, else its ends around four bullets."""
    return F.when(F.length(value) > 8, F.concat(F.left(value, F.lit(4)), F.lit(BULLETS), F.right(value, F.lit(4)))).when(F.length(value) > 0, F.lit(BULLETS))


def ip_hash(ip: Column, salt: str) -> Column:
    return F.when(F.length(ip) > 0, F.sha2(F.concat(F.lit(salt + ":"), ip), 256))


def status_tone(status: Column) -> Column:
    """The colour of a status."""
    return (
        F.when(status.isin("healthy", "success", "connected"), "green").when(status.isin("demo", "running"), "cyan")
        .when(status.isin("needs_credentials", "warning", "queued", "skipped"), "amber").when(status.isin("error", "disabled"), "rose").otherwise("slate")
    )


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """The lower-case host of an http or https URL, else an empty string."""
    return F.lower(F.regexp_extract(url, "^[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?([^/?#:\\s]+)", 1))


def segments(url: Column) -> Column:
    path = F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def origin(url: Column) -> Column:
    """Scheme and host, and the port if it is not the scheme's own."""
    port = F.regexp_extract(url, "^[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?[^/?#:\\s]+:([0-9]+)", 1)
    own = F.when(scheme(url) == "https", "443").otherwise("80")
    return F.concat(scheme(url), F.lit("://"), host(url), F.when((port == "") | (port == own), "").otherwise(F.concat(F.lit(":"), port)))


def classify(url: Column, own_host: str = "site.example") -> Column:
    """(type, confidence, normalized) of the connector that fits an URL best, null if none does.

    Candidates stand in registry order; the first of the highest confidence wins.
    """
    h, s, o = host(url), segments(url), origin(url)
    is_web = F.length(h) > 0
    one = lambda kind, ok, confidence, norm: F.when(ok, F.struct(F.lit(kind).alias("type"), F.lit(confidence).cast("double").alias("confidence"), norm.alias("normalized")))
    path = lambda n: F.concat(o, F.lit("/"), F.array_join(F.slice(s, 1, n), "/"))
    shop = h.endswith(".myshopify.com")
    admin = (h == "admin.shopify.com") & (F.get(s, F.lit(0)) == "store") & (F.size(s) >= 2)
    first = F.coalesce(F.get(s, F.lit(0)), F.lit(""))
    found = [
        one("supabase", is_web & h.endswith(".supabase.co"), 0.98, o),
        one("vercel_project", (h == "vercel.com") & (F.size(s) >= 2), 0.94, path(2)),
        one("shopify", shop | admin, 0.98, F.when(shop, o).otherwise(path(2))),
        one("tiktok", h.contains("tiktok.com") & first.startswith("@"), 0.96, path(1)),
        one("instagram", h.contains("instagram.com") & (first != "") & ~first.isin("p", "reel", "stories"), 0.94, F.concat(F.lit("https://www.instagram.com/"), first)),
        one("custom_csv", F.lower(F.trim(url)).endswith(".csv"), 0.72, F.trim(url)),
        one("website", is_web & ((h == own_host) | h.endswith("." + own_host)), 0.99, o),
        one("website", is_web, 0.6, o),
    ]
    ranked = F.transform(F.array_compact(F.array(*found)), lambda x, i: F.struct((-x["confidence"]).alias("c"), i.alias("i"), x.alias("x")))
    return F.array_min(ranked)["x"]


def resolve_url(path: Column, base: Column, fallback: Column) -> Column:
    """An event's URL: its path on its origin, else the origin, else the path on the source's URL, else that."""
    clean = F.regexp_replace(base, "/+$", "")
    joined = lambda root, p: F.concat(F.regexp_replace(root, "/+$", ""), F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return F.when(has(base) & has(path), joined(clean, path)).when(has(base), base).when(has(fallback), joined(fallback, F.coalesce(path, F.lit("/"))))


def verify_signature(body: Column, signature: Column, secret: str | None) -> Column:
    """Whether a signature is the body's HMAC-SHA1, put together of Spark's SHA-1 and the secret's two pads; no secret accepts all."""
    if not secret:
        return F.lit(True)
    key = secret.encode()
    key = (hashlib.sha1(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.sha1(F.concat(outer, F.unhex(F.sha1(F.concat(inner, F.coalesce(body, F.lit("")).cast("binary"))))))
    return F.coalesce(digest == signature, F.lit(False))


def seal(value: Column, key: str) -> Column:
    """AES-256-GCM with a random IV, base64."""
    return F.base64(F.aes_encrypt(value, F.lit(key), F.lit("GCM")))


def unseal(value: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(value), F.lit(key), F.lit("GCM")).cast("string")
