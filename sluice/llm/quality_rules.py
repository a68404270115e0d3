"""Line-first quality rules: bad lines go, then documents that lose too much text.

Every line with a word is judged on its own:

* punctuation: over 15 % of its characters are signs (or over 60 % are capitals A-Z in a
  line of 12 characters or more),
* navigation: two or more `|`, `»` or `·` separators, at least one to every four words,
* boilerplate: a phrase of a fixed list (English, German, French, Spanish), a line equal to an earlier one of the text, or
  over 30 % of its words repeat the word before.

Lines that fail are removed; lines without a word stay. A document is rejected when over
half of its words go, or when the base rules fail it: under 10 words, or over 20 % of
the words in five-word windows that the text has twice or more.

All of it is Spark's own functions over one row at a time: no shuffle, so no key can be
hot, and Python never sees a text. Work for a text is n log n in its words and lines.

Defined results: a null text is one without words; it is rejected and its cleaned text is
empty. Ties and repeated rows are judged alike. An empty table gives no rows. Extra
columns are kept by `clean`; it drops columns of its own names (clean_text and those of
MEASURES) from its input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words

#: Fixed values.
SYMBOLS = "#*$%&|<>"
SIGNS = "#*$%&|<>!=_~^+\\{}[]@/"
SEPARATORS = "|»·"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"
PHRASES = [
    "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "enable javascript", "lorem ipsum", "subscribe to our newsletter", "skip to content",
    "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "hier klicken", "newsletter abonnieren", "zum inhalt springen",
    "accepter les cookies", "politique de confidentialité", "conditions générales", "tous droits réservés", "cliquez ici", "aller au contenu",
    "aceptar cookies", "política de privacidad", "términos de uso", "todos los derechos reservados", "haga clic aquí", "ir al contenido",
]

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_bad_lines", "n_kept_words", "kept"]


def one_of(characters: str) -> str:
    """A regular expression for one of these characters."""
    return "[" + "".join("\\" + c if not c.isalnum() else c for c in characters) + "]"


def count_of(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(one_of(characters)))


def without_spaces(text: Column) -> Column:
    """The text without the characters of SPACES."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text)


def repeat_words(ws: Column, width: int = 5) -> Column:
    """How many words lie in windows of `width` words that occur twice or more, the first included.

    Most texts have no window twice: then all their hashes differ. For the others the
    windows themselves are compared as text (words hold no space): equal ones are brought
    together by a sort and the covered words are summed over the sorted starts.
    """
    starts_at = F.sequence(F.lit(1), F.size(ws) - width + 1)
    hashes = F.transform(starts_at, lambda i: F.xxhash64(F.slice(ws, i, width)))
    windows = F.transform(starts_at, lambda i: F.concat_ws(" ", F.slice(ws, i, width)))

    def covered(sorted_: Column) -> Column:
        twice = F.filter(sorted_, lambda x, i: F.coalesce(F.get(sorted_, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(sorted_, i + 1)["w"] == x["w"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(s, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("end")), lambda a, p: F.struct((a["n"] + width - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + width).alias("end")), lambda a: a["n"]))

    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    no_two = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(ws) < width + 1, 0).when(no_two, 0).otherwise(let(placed, covered))


def has_phrase(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.contains(p) for p in PHRASES]))


def bad_line(line: Column, text: dict[str, Column]) -> Column:
    """Whether a line fails on its own (repeated lines are seen to where lines are together).

    text: whether the whole text has any signs, phrases, separators, or a word twice
    running; what the text has not, its lines need not be searched for.
    """
    n = F.length(line)
    signs = text["signs"] & (count_of(line, SIGNS) * 100 > n * 15)
    shouted = (n >= 12) & (F.regexp_count(line, F.lit("[A-Z]")) * 100 > F.length(without_spaces(line)) * 60)

    def repeats(ws: Column) -> Column:
        same = F.zip_with(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, F.lit(2), F.size(ws)), lambda a, b: a == b)
        return F.size(F.filter(same, lambda x: x)) * 100 > F.size(ws) * 30

    menu = text["bars"] & let(count_of(line, SEPARATORS), lambda bars: (bars >= 2) & (bars * 4 >= F.size(words(line))))
    return signs | shouted | (text["phrases"] & has_phrase(line)) | menu | (text["stutters"] & let(words(line), repeats))


def clean(docs: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """docs with clean_text and the columns of MEASURES."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.drop("clean_text", *MEASURES).withColumn("_words", words(F.col("text"))).withColumn("_lines", F.split(text, "\n"))
    has_word = lambda x: F.ltrim(x, F.lit(SPACES)) != ""
    full = F.filter("_lines", has_word)
    rows = rows.withColumn("_full", full).withColumn("_distinct", F.array_distinct("_full"))
    ws = F.col("_words")
    flags = {
        "signs": text.rlike(one_of(SIGNS)), "bars": count_of(text, SEPARATORS) > 1, "phrases": has_phrase(text),
        "stutters": F.exists(F.zip_with(ws, F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1))), lambda a, b: a.eqNullSafe(b)), lambda x: x),
    }
    rows = rows.withColumn("_flags", F.struct(*[v.alias(k) for k, v in flags.items()]))
    # Only texts with a line twice need order: sorted, a copy stands next to the line before it; then lines go back to
    # their places. What lambdas use of the whole text is bound by `let`: a column would be worked out anew for each line.
    some_twice = F.size("_full") != F.size("_distinct")
    again = lambda s, y, k: F.coalesce(F.get(s, k - 1)["x"] == y["x"], F.lit(False)) & has_word(y["x"])
    own = lambda x, f: bad_line(x, {k: f[k] for k in flags})  # false for a line without a word

    def kept_lines(f: Column) -> Column:
        by_text = F.sort_array(F.transform("_lines", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        marks = let(by_text, lambda s: F.sort_array(F.transform(s, lambda y, k: F.struct(y["i"].alias("i"), (again(s, y, k) | own(y["x"], f)).alias("bad")))))
        in_order = let(marks, lambda m: F.filter("_lines", lambda x, i: ~F.get(m, i)["bad"]))
        return F.when(some_twice, in_order).otherwise(F.filter("_lines", lambda x: ~own(x, f)))

    rows = rows.withColumn("_keep", let(F.col("_flags"), kept_lines))
    n_words = F.size("_words").cast("long")
    rows = rows.withColumns({
        "n_words": n_words,
        "word_chars": F.length(F.concat_ws("", "_words")).cast("long"),
        "n_symbols": count_of(text, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_full") - F.size("_distinct")).cast("long"),
        "n_repeat_words": repeat_words(F.col("_words")).cast("long"),
        "n_lines": F.size("_full").cast("long"),
        "clean_text": F.array_join("_keep", "\n"),
    })
    rows = rows.withColumn("n_bad_lines", F.when(F.size("_keep") == F.size("_lines"), F.lit(0).cast("long")).otherwise(F.col("n_lines") - F.size(F.filter("_keep", has_word))))
    rows = rows.withColumn("n_kept_words", F.when(F.col("n_bad_lines") == 0, F.col("n_words")).otherwise(F.size(words(F.col("clean_text")))).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    enough = F.col("n_kept_words") >= (1 - max_loss) * F.col("n_words")
    return rows.withColumn("kept", ~F.col("base_failed") & enough).drop("_words", "_lines", "_full", "_distinct", "_flags", "_keep")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean_text")


def _sql_count(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, {_sql_text(characters)}, '')))"


def _sql_text(characters: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in characters)


OP5_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
     w AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS ws FROM t),
     win AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) AS s FROM w),
     twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
     rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY 1),
     cut AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, unnest(range(len(string_split(x, chr(10))))) AS i FROM t),
     li AS (SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS lw, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM cut),
     judged AS (SELECT doc_id, len(lw) AS n, again, len(lw) > 0 AS full_line, again
         OR {_sql_count('line', SIGNS)} * 100 > length(line) * 15
         OR length(line) >= 12 AND {_sql_count('line', CAPITALS)} * 100 > (length(line) - {_sql_count('line', SPACES)}) * 60
         OR regexp_matches(lower(line), '{"|".join(PHRASES)}')
         OR len(list_filter(range(2, len(lw) + 1), lambda k: lw[k] = lw[k - 1])) * 100 > len(lw) * 30
         OR {_sql_count('line', SEPARATORS)} >= 2 AND {_sql_count('line', SEPARATORS)} * 4 >= len(lw) AS bad FROM li),
     s AS (SELECT doc_id, count(*) FILTER (WHERE full_line) AS n_lines, count(*) FILTER (WHERE full_line AND bad) AS n_bad_lines, count(*) FILTER (WHERE full_line AND again) AS n_dup_lines,
         coalesce(sum(n) FILTER (WHERE full_line AND NOT bad), 0)::BIGINT AS n_kept_words FROM judged GROUP BY 1),
     b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(translate(x, {_sql_text(SPACES)}, ''))::BIGINT AS word_chars, {_sql_count('x', SYMBOLS)}::BIGINT AS n_symbols, s.n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         s.n_lines, s.n_bad_lines, s.n_kept_words FROM w JOIN s ON s.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_kept_words >= 0.5 * n_words AS kept FROM b
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their cleaned text, under their own columns."""
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    row = F.struct(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
    # Each row goes as an array of one or none: a filter on `kept` would be pushed below
    # the measures, with all of their expressions copied into it.
    return clean(docs).select(F.inline(F.when(F.col("kept"), F.array(row))))
