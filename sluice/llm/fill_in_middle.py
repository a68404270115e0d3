"""Fill-in-the-middle texts: prefix, middle and suffix cut at the units of a grammar.

A unit grammar says which neighbouring code points stay in one unit: for each class of
left neighbours, the classes of right neighbours that go on with the unit. `boundary`
translates it to a regular expression of look-around only, which matches, with no width,
between a left neighbour and a right one that begins a unit. Spark's split at these places
drops nothing: the pieces joined are the text. An empty text has no place to split at and
gives one empty piece, so it is taken as a text of no units on its own.

The cuts follow from hashes of the seed and doc_id alone: the prefix ends after the smaller
of two uniform unit counts, the middle after the larger. A document is left plain by
share, or where the text is empty or holds a sentinel; others are written suffix first (spm)
by share, or prefix first (psm). `restored` rebuilds the text from output and form.

All of it is Spark functions over one row at a time: no shuffle, no Python, and no
key can be hot. Work and memory grow with the length of the text.

Defined results: a null text is an empty one. A null doc_id is hashed as an empty string, so
all rows without one share their cuts. Repeated rows are cut alike. An empty table gives no
rows. Extra columns are kept by `fill_in_middle`; those with names of its own (NEW) are
dropped from its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Unit grammars: class of the left neighbour -> classes of right neighbours in the same unit. Classes are insides of brackets.
GRAMMARS: dict[str, dict[str, list[str]]] = {
    "letters": {"A-Za-z": ["A-Za-z"], "^A-Za-z": []},
    "characters": {r"\s\S": []},
    "words": {r"^\x20\x09-\x0D": [r"^\x20\x09-\x0D"], r"\x20\x09-\x0D": [r"\x20\x09-\x0D"]},
    "lines": {r"^\n": [r"\s\S"], r"\n": []},
}
SENTINELS = ("<P>", "<S>", "<M>")
NEW = ["n", "form", "prefix", "middle", "suffix", "output"]


def boundary(grammar: dict[str, list[str]]) -> str:
    """A regular expression that matches, with no width, wherever a unit ends and another begins.

    The second half of a surrogate pair begins nothing: Java looks at a text in 16-bit
    halves, and would else part characters beyond U+FFFF.
    """
    ends = [f"(?<=[{left}])" + (f"(?!{'|'.join(f'[{right}]' for right in same)})" if same else "") for left, same in grammar.items()]
    return rf"(?:{'|'.join(ends)})(?=[\s\S])(?![\x{{DC00}}-\x{{DFFF}}])"


def units(text: Column, grammar: dict[str, list[str]]) -> Column:
    """The units of a text, which joined give the text again (null, empty: none)."""
    return F.when(F.length(text) > 0, F.split(text, boundary(grammar))).otherwise(F.array().cast("array<string>"))


def _hash(seed: int, doc_id: Column, k: int) -> Column:
    """The k-th 8 hexadecimal digits, from 0, of the SHA-256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels that begin with a character which none holds elsewhere can't arise where a piece and a sentinel meet."""
    if len(set(sentinels)) < 3 or not all(sentinels) or any(s[0] in t[1:] for s in sentinels for t in sentinels) or any(s != t and s.startswith(t) for s in sentinels for t in sentinels):
        raise ValueError(f"sentinels must differ, and none may begin with a character of the rest of one: {sentinels}")


def fill_in_middle(docs: DataFrame, units_of: str = "letters", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs (doc_id, text) with n (units), form, prefix, middle and suffix (null if plain) and output."""
    check_sentinels(sentinels)
    p, s, m = (F.lit(x) for x in sentinels)
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [c for c in docs.columns if c.lower() not in NEW]
    rows = docs.select(*kept, units(text, GRAMMARS[units_of]).alias("_units"), *[_hash(seed, F.col("doc_id"), k).alias(f"_h{k + 1}") for k in range(4)])
    n = F.size("_units").cast("long")
    plain = (n == 0) | text.contains(p) | text.contains(s) | text.contains(m) | (F.col("_h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    cut = [F.col(h) % (n + 1) for h in ("_h1", "_h2")]
    rows = rows.select(*kept, "_units", n.alias("n"), form.alias("form"), F.least(*cut).cast("int").alias("_a"), F.greatest(*cut).cast("int").alias("_b"))

    def part(first: Column, count: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("_units", first, count), ""))

    a, b = F.col("_a"), F.col("_b")
    parts = {"prefix": part(F.lit(1), a), "middle": part(a + 1, b - a), "suffix": part(b + 1, F.size("_units") - b)}
    rows = rows.select(*kept, "n", "form", *[v.alias(k) for k, v in parts.items()])
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(text)
    return rows.withColumn("output", output)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of."""
    p, s, m = sentinels
    before, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    first = {"psm": p, "spm": s}
    second = {"psm": s, "spm": p}

    def rebuilt(kind: str) -> Column:
        head, tail = F.substring_index(F.substring_index(before, second[kind], 1), first[kind], -1), F.substring_index(before, second[kind], -1)
        return F.concat(head, middle, tail) if kind == "psm" else F.concat(tail, middle, head)

    return F.when(form == "psm", rebuilt("psm")).when(form == "spm", rebuilt("spm")).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
     u AS (SELECT doc_id, x, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') AS p, len(regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]')) AS n,
                  ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
     f AS (SELECT *, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
     c AS (SELECT *, array_to_string(p[1:a], '') AS pre, array_to_string(p[a + 1:b], '') AS mid, array_to_string(p[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE x END) AS output_sha256,
       sha256(x) AS restored_sha256 FROM c
"""
