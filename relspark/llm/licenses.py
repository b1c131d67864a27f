"""Licence scans with DataFrame functions only.

Units of a text are its lines, its paragraphs of several lines, the whole text where it has several paragraphs, and windows:
for each template, runs of as many words as it has, beginning at every word whose number is a multiple of a tenth of that
(of every word for short templates). So a licence is found above code and within prose.
A unit's words (runs of a-z and 0-9 after lower-casing) give the set of its word bigrams; the Dice
coefficient with a template's set is 2 * common / (sum of sizes). A coefficient of at least t bounds a unit's size to
[t / (2 - t), (2 - t) / t] times the template's, so units and templates meet in an equi-join on the unit's size: a
template is listed under each size that it allows. Windows meet their template in an equi-join on bigrams: only windows
that hold at least t / (2 - t) of its bigrams, which that bound asks for, are looked at further. A unit that reaches t with any
template also has one of a few words (markers, worked out from the templates' bigrams and t); texts and units without any
are left out first. The table of templates is fixed, so its broadcasts have a bound that doesn't depend on the data.

Defined results: a null or empty text and a unit of one word give no row; ties go to the licence first in
order of name; of the windows of a document and licence the best gives a row, of equal ones the first; rows that
repeat a doc_id and text are one document; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.shared import shared_folder
from relspark.llm.license_texts import templates

THRESHOLD = 0.8
# fixed values: words too frequent in some language's prose to be worth testing for
COMMON = set("a all an and any are as at be by can do for from if in is it its may mit no not of on or other out person see so such that the this to under use we with without you your work project version terms free public".split())


def bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _distinct() -> list[tuple[str, list[str]]]:
    return [(licence, list(grams)) for licence, grams in sorted({(licence, tuple(bigrams(text))) for licence, text in templates()})]


def _least(n: int, threshold: float) -> int:
    """A unit that reaches the threshold has at least so many bigrams in common with a template of n."""
    return max(1, math.ceil(threshold / (2 - threshold) * n - 1e-9))


@lru_cache
def markers(threshold: float = THRESHOLD) -> list[str]:
    """Words of which any unit that reaches the threshold with any template has at least one.

    A template's bigrams without a marker are fewer than the common ones needed. Chosen greedily: each time the
    word that brings the templates nearest to that, common words last.
    """
    chosen: list[str] = []
    open_ = [(set(grams), _least(len(grams), threshold)) for _, grams in _distinct()]
    while open_ := [(bare, least) for bare, least in open_ if len(bare) >= least]:
        gain: Counter = Counter()
        for bare, least in open_:
            touched: Counter = Counter(w for g in bare for w in set(g.split()))
            for w, n in touched.items():
                gain[w] += min(n, len(bare) - least + 1)
        best = min(gain, key=lambda w: (w in COMMON or w.isdigit(), -gain[w], w))
        chosen.append(best)
        open_ = [({g for g in bare if best not in g.split()}, least) for bare, least in open_]
    return sorted(chosen)


def _listed(threshold: float) -> list[tuple[int, int]]:
    """(size of unit, number of template) of all that may reach the threshold."""
    out = []
    for k, (_, grams) in enumerate(_distinct()):
        high = math.floor((2 - threshold) / threshold * len(grams) + 1e-9)
        out += [(size, k) for size in range(_least(len(grams), threshold), high + 1)]
    return out


def _windowed(threshold: float) -> list[tuple[str, int, str, int, int, int, int]]:
    """(bigram, number, licence, words, step of windows, bigrams, least in common) of each bigram of each template."""
    words = {(licence, tuple(bigrams(text))): len(re.findall("[a-z0-9]+", text.lower())) for licence, text in sorted(templates())}
    out = []
    for k, (licence, grams) in enumerate(_distinct()):
        wide = words[licence, tuple(grams)]
        out += [(g, k, licence, wide, max(1, wide // 10), len(grams), _least(len(grams), threshold)) for g in grams]
    return out


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _pairs(words: Column) -> Column:
    """The bigrams of words, in order."""
    return F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())


def _windows(texts: DataFrame, threshold: float) -> DataFrame:
    """doc_id, unit, place, license, dice of each document's and licence's best window. texts: doc_id, th, text."""
    spark, key = texts.sparkSession, ["doc_id", "th", "template", "start"]
    table = spark.createDataFrame(_windowed(threshold), "gram string, template int, license string, wide int, step int, size int, least int")
    # dealt by document: the many rows below are grouped where they are made
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = texts.repartition(wide, "doc_id", "th").select("doc_id", "th", _words(F.col("text")).alias("words"))
    placed = words.select("doc_id", "th", F.size("words").alias("n"), F.posexplode(_pairs(F.col("words"))).alias("p", "gram")).join(F.broadcast(table), "gram")
    # the windows that hold words p and p + 1
    first = F.expr("cast(ceil(greatest(p + 2 - wide, 0) / step) as int) * step")
    met = placed.withColumns({"low": first, "high": F.expr("least(p, n - wide)")}).filter("low <= high").withColumn("start", F.explode(F.expr("sequence(low, high, step)")))
    common = met.groupBy(*key, "license", "wide", "size", "least", "gram").agg(F.lit(1).alias("one"))
    common = common.groupBy(*key, "license", "wide", "size", "least").agg(F.count("*").alias("common")).filter("common >= least")
    there = words.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "words")
    found = common.join(there, common["doc_id"].eqNullSafe(there["d"]) & (common["th"] == there["t"]))
    held = F.size(F.array_distinct(_pairs(F.slice("words", F.col("start") + 1, F.col("wide")))))
    scored = found.withColumn("dice", 2.0 * F.col("common") / (held + F.col("size"))).filter(F.col("dice") >= threshold)
    best = scored.groupBy("doc_id", "th", "license").agg(F.min(F.struct((-F.col("dice")).alias("d"), "start")).alias("one"))
    return best.select("doc_id", F.lit("window").alias("unit"), F.col("one.start").alias("place"), "license", F.round(-F.col("one.d"), 9).alias("dice"))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit (line, paragraph, text, window), place (from 0 among its kind; of a window its first word), license, dice: the best licence of each unit that reaches the threshold."""
    spark = docs.sparkSession
    shared_folder(spark)
    sizes = spark.createDataFrame(_listed(threshold), "size int, template int")
    known = spark.createDataFrame([(k, licence, grams) for k, (licence, grams) in enumerate(_distinct())], "template int, license string, theirs array<string>")
    marked = lambda body: F.lower(body).rlike(rf"(?<![a-z0-9])(?:{'|'.join(markers(threshold))})(?![a-z0-9])")
    texts = docs.filter(F.col("text").isNotNull() & marked("text")).select("doc_id", "text", F.xxhash64("text").alias("th")).dropDuplicates(["doc_id", "th"]).checkpoint()
    text = texts.select("*", F.split("text", "\n").alias("lines"), F.split("text", r"\n[ \t\r]*\n").alias("parts"))
    unit = lambda kind, array: F.transform(array, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("place"), x.alias("body")))
    several = F.filter(unit("paragraph", "parts"), lambda u: u["body"].contains("\n"))
    whole = F.when(F.size("parts") > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("place"), F.col("text").alias("body")))).otherwise(F.array().cast("array<struct<unit:string,place:int,body:string>>"))
    units = text.select("doc_id", "th", F.inline(F.concat(unit("line", "lines"), several, whole)))
    grams = units.filter(marked("body")).select("doc_id", "th", "unit", "place", F.array_distinct(_pairs(_words(F.col("body")))).alias("grams"))
    met = grams.withColumn("size", F.size("grams")).join(F.broadcast(sizes), "size").join(F.broadcast(known), "template")
    common = F.size(F.array_intersect("grams", "theirs"))
    scored = met.withColumn("dice", 2.0 * common / (F.col("size") + F.size("theirs"))).filter(F.col("dice") >= threshold)
    one = scored.groupBy("doc_id", "th", "unit", "place").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("one"))
    one = one.select("doc_id", "unit", "place", F.col("one.license").alias("license"), F.round(-F.col("one.d"), 9).alias("dice"))
    return one.union(_windows(texts, threshold))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of the same rows over the view documents: every unit against every template that it shares a bigram with, without pruning."""
    windowed = ", ".join(f"({k}, '{licence}', {wide}, {step}, {size}, {g!r})" for g, k, licence, wide, step, size, _ in _windowed(threshold))
    return f"""
WITH bigrams(k, license, wide, step, size, g) AS (VALUES {windowed}),
texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS parts FROM documents WHERE text IS NOT NULL AND text <> ''),
units AS (
  SELECT doc_id, text, 'line' AS unit, i - 1 AS place, lines[i] AS body FROM (SELECT doc_id, text, lines, unnest(range(1, len(lines) + 1)) AS i FROM texts)
  UNION ALL SELECT doc_id, text, 'paragraph', i - 1, parts[i] FROM (SELECT doc_id, text, parts, unnest(range(1, len(parts) + 1)) AS i FROM texts) WHERE contains(parts[i], chr(10))
  UNION ALL SELECT doc_id, text, 'text', 0, text FROM texts WHERE len(parts) > 1),
worded AS (SELECT *, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM units),
grams AS (SELECT doc_id, text, unit, place, list_distinct([w[k] || ' ' || w[k + 1] for k in range(1, len(w))]) AS g FROM worded WHERE len(w) > 1),
shared AS (
  SELECT doc_id, th, unit, place, license, n, size, count(*) AS common FROM (SELECT doc_id, md5(text) AS th, unit, place, len(g) AS n, unnest(g) AS g FROM grams) JOIN bigrams USING (g)
  GROUP BY doc_id, th, unit, place, k, license, n, size),
scored AS (SELECT doc_id, th, unit, place, license, 2.0 * common / (n + size) AS dice FROM shared),
whole AS (SELECT DISTINCT doc_id, md5(text) AS th, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM texts),
pairs AS (SELECT doc_id, th, n, unnest(g) AS g, unnest(p) AS first FROM (SELECT doc_id, th, len(w) AS n, range(0, len(w) - 1) AS p, [w[j] || ' ' || w[j + 1] for j in range(1, len(w))] AS g FROM whole)),
met AS (
  SELECT doc_id, th, k, license, wide, size, g, unnest(range(CAST(ceil(greatest(first + 2 - wide, 0) / step) AS BIGINT) * step, least(first, n - wide) + 1, step)) AS s
  FROM pairs JOIN bigrams USING (g)),
windows AS (SELECT doc_id, th, k, license, wide, size, s, count(DISTINCT g) AS common FROM met GROUP BY ALL HAVING count(DISTINCT g) >= {threshold} / 2 * size),
measured AS (
  SELECT windows.doc_id, windows.th, license, s, 2.0 * common / (len(list_distinct([w[j] || ' ' || w[j + 1] for j in range(s + 1, s + wide)])) + size) AS dice
  FROM windows JOIN whole ON windows.th = whole.th AND windows.doc_id IS NOT DISTINCT FROM whole.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, th, license ORDER BY dice DESC, s) AS r FROM measured WHERE dice >= {threshold})
SELECT doc_id, unit, CAST(place AS INTEGER) AS place, license, round(CAST(dice AS DOUBLE), 9) AS dice
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, th, unit, place ORDER BY dice DESC, license) AS k FROM scored WHERE dice >= {threshold})
WHERE k = 1
UNION ALL SELECT doc_id, 'window', CAST(s AS INTEGER), license, round(CAST(dice AS DOUBLE), 9) FROM best WHERE r = 1"""
