"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sources in code point order (null last) weigh 1, 2, 3, repeating. Their targets share all words by weight,
   but stop at CAP times the source's size; the excess goes to the others by weight until none is above.
2. The mix consists of blocks of `block` words. The blocks of each of the SHARDS output shards go to the sources with
   the highest quotients target / (2 k - 1): the seats up to each shard's end are apportioned, and a shard's quota is the
   difference (the method is house-monotone). Only seats within the proven rounding range of each source are ranked.
3. A source's documents, in an order seeded by SEED, form one stream of words cut into blocks. A source of n seats
   over a stream of b blocks takes every block n div b times and n mod b evenly spaced blocks, from a seeded offset, once
   more; these n choices are numbered round by round along the stream, and each shard takes as many of the next ones as its
   quota says. So no document is taken more than CAP times, and the words that a shard takes of a document
   follow in closed form from where the document begins and ends in the stream. spans() lists the chosen blocks.

Streams are cut by two-level prefix sums (documents in buckets, buckets in sources), so a source with a third of
all rows is spread over as many tasks as its size asks for.

The tables of sources (weights, targets, seats) have a row for each source, or for each seat in doubt, not for each document.
Up to FEW sources they are ranked by plain windows, and go to the tasks as a table; more are ranked by ranges, and joined by a
shuffle. The rows are the same.

Defined results: a null or empty text has size 0 and nothing is taken of it; a null source is a source of its
own and comes last; repeated rows are separate documents. An empty table gives an empty result. Other columns pass
through; columns of the names that mix adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspark.shared import shared_folder

CAP, SHARDS, BLOCK, SEED, FEW = 3, 16, 16, 20240601, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def _before(x: DataFrame, group: list[str], order: list[Column], totals: dict[str, Column], small: bool) -> DataFrame:
    """Adds, under the totals' names, the sums over the rows before each row, in the order given, within its group.

    Few rows are one window for each group. More are dealt by ranges of the order, and sums run over the ranges
    and then within each, so that no task holds a whole group.
    """
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c, w: F.coalesce(F.sum(c).over(upto(w)), F.lit(0))
    if small:
        return x.withColumns({n: run(c, Window.partitionBy(*group).orderBy(*order)) for n, c in totals.items()})
    dealt = x.repartitionByRange(*map(F.col, group), *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sums = dealt.groupBy(*group, "__part").agg(*[F.sum(c).alias(f"__sum_{n}") for n, c in totals.items()])
    first = sums.select(*group, "__part", *[run(F.col(f"__sum_{n}"), Window.partitionBy(*group).orderBy("__part")).alias(f"__first_{n}") for n in totals])
    within = Window.partitionBy(*group, "__part").orderBy(*order)
    out = dealt.join(first, [*group, "__part"]).withColumns({n: F.col(f"__first_{n}") + run(c, within) for n, c in totals.items()})
    return out.drop("__part", *[f"__first_{n}" for n in totals])


def _targets(sized: DataFrame, few: int) -> tuple[DataFrame, bool]:
    """__key, source_size, n_docs, target, total: one row per source; and whether there are few sources."""
    x = sized.groupBy("__key").agg(F.sum("__size").alias("source_size"), F.count("*").alias("n_docs")).checkpoint()
    small = x.limit(few + 1).count() <= few
    name, none = F.col("__key.name").asc_nulls_last(), []
    x = _before(x, none, [name], {"place": F.lit(1)}, small)
    x = x.withColumns({"weight": (F.col("place") % 3 + 1).cast("double"), "cap": (CAP * F.col("source_size")).cast("double")})
    total, weights = x.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # sources fill up in the order of cap / weight; with those before it full, a source and all after it share by weight
    x = _before(x, none, [(F.col("cap") / F.col("weight")).asc(), name], {"full": F.col("cap"), "gone": F.col("weight")}, small)
    x = x.withColumn("level", (F.lit(total) - F.col("full")) / (F.lit(weights) - F.col("gone"))).checkpoint()
    # the level falls from the first source that does not fill up at it, whose level holds
    level = x.agg(F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))).first()[0]
    target = F.least("cap", F.coalesce(F.lit(level).cast("double") * F.col("weight"), F.col("cap")))
    return x.select("__key", "source_size", "n_docs", target.alias("target"), F.lit(total).cast("long").alias("total")), small


def _seats(targets: DataFrame, block: int, shards: int, small: bool) -> DataFrame:
    """__key, shard, seats up to the shard's end, by Sainte-Lague."""
    x = targets.filter("target > 0").withColumns({"most": CAP * F.ceil(F.col("source_size") / block), "votes": F.col("target") / block})
    votes, sources = x.agg(F.sum("votes"), F.count("*")).first()
    x = x.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    x = x.withColumn("house", F.floor(F.round(F.col("total") / block) * F.col("shard") / shards))
    x = x.withColumns({"share": F.col("votes") * F.col("house") / F.lit(votes or 1.0), "slack": (F.lit(sources) + 2) / F.greatest(F.col("house"), F.lit(1))})
    # with S sources and H seats the divisor is within (S + 2) / H of the even one; seats are ranked in that range only
    low = F.greatest(F.lit(0), F.floor(F.col("share") * (1 - F.col("slack"))) - 1)
    high = F.ceil(F.col("share") * (1 + 2 * F.col("slack"))) + 2
    x = x.withColumns({"low": F.least(low, "most"), "high": F.least(high, "most")})
    seats = x.filter("high > low").withColumn("seat", F.explode(F.sequence(F.col("low") + 1, F.col("high"))))
    seats = seats.select("__key", "shard", "seat", (F.col("votes") / (2 * F.col("seat") - 1)).alias("quotient"))
    placed = _before(seats, ["shard"], [F.col("quotient").desc(), F.col("__key.name").asc_nulls_last(), F.col("seat").asc()], {"place": F.lit(1)}, small)
    left = x.groupBy("shard").agg((F.first("house") - F.sum("low")).alias("left"))
    won = placed.join(left, "shard").filter("place < left").groupBy("__key", "shard").agg(F.count("*").alias("won"))
    return x.join(won, ["__key", "shard"], "left").select("__key", "shard", (F.col("low") + F.coalesce("won", F.lit(0))).alias("seats"))


def _number(text: Column) -> Column:
    """52 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


ADDED = ("size", "source_size", "target", "taken", "by_shard")


def _sized(docs: DataFrame, seed: int, text: bool) -> tuple[DataFrame, dict[str, str]]:
    """The documents under private names (with the text only if asked for), with size, source key and place in the seeded order; written once. The columns' private names."""
    shared_folder(docs.sparkSession)
    own = {c: f"__c{k}" for k, c in enumerate(docs.columns) if c not in ADDED and (text or c != "text")}
    body = F.coalesce(docs["text"], F.lit(""))
    th = F.md5(body)
    at = _number(F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), th))
    size = F.regexp_count(body, F.lit(WORD)).cast("long")
    held = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in own.items()], size.alias("__size"), F.struct(docs["source"].alias("name")).alias("__key"), th.alias("__th"), at.alias("__at"), docs["doc_id"].alias("__id"))
    return held.checkpoint(), own


def plan(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK, seed: int = SEED, few: int = FEW) -> DataFrame:
    """source, shard, quota: the blocks that each shard holds of each source; block: their words."""
    targets, small = _targets(_sized(docs.select("doc_id", "source", "text"), seed, False)[0], few)
    seats = _seats(targets, block, shards, small)
    before = F.lag("seats", 1, 0).over(Window.partitionBy("__key").orderBy("shard"))
    return seats.select(F.col("__key.name").alias("source"), "shard", (F.col("seats") - before).alias("quota"), F.lit(block).alias("block"))


def _placed(docs: DataFrame, shards: int, block: int, seed: int, text: bool, few: int = FEW) -> tuple[DataFrame, dict[str, str]]:
    """The documents with where they begin and end (__end) in their source's stream, and what is known of the source; the columns' private names."""
    sized, own = _sized(docs, seed, text)
    targets, small = _targets(sized, few)
    seats = _seats(targets, block, shards, small).groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("shard", "seats"))).alias("list"))
    # __seats: the seats before each shard, and at last all
    seats = seats.select("__key", F.concat(F.array(F.lit(0).cast("long")), F.transform("list", lambda x: x["seats"].cast("long"))).alias("__seats"))
    known = targets.join(seats, "__key", "left").select(
        "__key", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.ceil(F.sqrt("n_docs")).alias("__buckets"),
        F.coalesce("__seats", F.array_repeat(F.lit(0).cast("long"), shards + 1)).alias("__seats"), F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).alias("__blocks"),
    )
    known = known.withColumns({"__quota": F.element_at("__seats", -1), "__offset": _number(F.concat_ws(":", F.lit(str(seed)), F.coalesce("__key.name", F.lit("")))) % F.col("__blocks")})
    # a table of few sources goes to every task; a larger one is shuffled, and Spark splits a hot source
    x = sized.join(F.broadcast(known) if small else known.checkpoint(), "__key")
    x = x.withColumn("__bucket", F.floor(F.col("__at") / (1 << 52) * F.col("__buckets")))
    starts = x.groupBy("__key", "__bucket").agg(F.sum("__size").alias("words"))
    starts = starts.select("__key", "__bucket", (F.sum("words").over(Window.partitionBy("__key").orderBy("__bucket")) - F.col("words")).alias("__start"))
    x = x.join(starts, ["__key", "__bucket"])
    within = Window.partitionBy("__key", "__bucket").orderBy("__at", "__id", "__th", "__size").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("__end", F.col("__start") + F.sum("__size").over(within)), own


def _chosen(k: str) -> str:
    """How many of the first k blocks are taken once more than the others; the product may have 80 bits."""
    return f"((cast({k} as decimal(19,0)) * cast(__quota % __blocks as decimal(19,0)) + cast(__offset as decimal(19,0))) div cast(__blocks as decimal(19,0)))"


def _upto(w: str, t: str, b: int) -> str:
    """Words of the first w of the stream that the first t choices take: whole rounds and a part of one, and then the blocks taken once more."""
    full = "(__quota div __blocks) * __blocks"
    rounds = f"(least({t}, {full}) div __blocks) * {w} + least({w}, (least({t}, {full}) % __blocks) * {b})"
    now, after, more = _chosen(f"({w} div {b})"), _chosen(f"({w} div {b} + 1)"), f"greatest({t} - {full}, 0L)"
    return f"({rounds} + if({now} >= {more}, {more} * {b}, {now} * {b} + ({w} % {b}) * ({after} - {now})))"


def mix(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK, seed: int = SEED, text: bool = False, few: int = FEW) -> DataFrame:
    """The documents' columns (text only if asked for), with size, source_size, target, taken and by_shard (the words that each shard takes) added."""
    x, own = _placed(docs, shards, block, seed, text, few)
    begin = "(__end - __size)"
    words = lambda t: f"({_upto('__end', t, block)} - {_upto(begin, t, block)})"
    x = x.withColumn("__before", F.expr(f"transform(__seats, t -> {words('t')})"))
    x = x.withColumn("__by_shard", F.expr(f"zip_with(slice(__before, 2, {shards}), slice(__before, 1, {shards}), (a, z) -> cast(a - z as bigint))"))
    total = F.expr("aggregate(__by_shard, 0L, (a, n) -> a + n)")
    names = {c: F.col(n).alias(c) for c, n in own.items()}
    return x.select(*names.values(), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), total.alias("taken"), F.col("__by_shard").alias("by_shard"))


def spans(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, shard (from 1), first and end (words of the document, end exclusive): a row for each part of a chosen block, as often as it is chosen."""
    x = _placed(docs.select("doc_id", "source", "text"), shards, block, seed, False)[0].filter("__size > 0 and __quota > 0")
    x = x.withColumn("__k", F.explode(F.expr(f"sequence((__end - __size) div {block}, (__end - 1) div {block})")))
    rounds = f"transform(sequence(0, cast(__quota div __blocks as int)), r -> if(r < __quota div __blocks, r * __blocks + __k, if({_chosen('(__k + 1)')} > {_chosen('__k')}, r * __blocks + {_chosen('__k')}, -1L)))"
    x = x.withColumn("__choice", F.explode(F.expr(f"filter({rounds}, t -> t >= 0)")))
    shard = F.expr("size(filter(__seats, t -> t <= __choice))")
    begin = F.col("__end") - F.col("__size")
    first, end = F.greatest(F.col("__k") * block, begin) - begin, F.least((F.col("__k") + 1) * block, F.col("__end")) - begin
    return x.select(F.col("__id").alias("doc_id"), F.col("__key.name").alias("source"), shard.alias("shard"), first.alias("first"), end.alias("end"))


def oracle_sql(block: int = BLOCK, seed: int = SEED) -> str:
    """DuckDB SQL of the same rows over the view documents: every seat is ranked, every source is one stream."""
    number = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)".format
    chosen = "(({n}) * (quota % blocks) + shift) // blocks"
    taken = "((quota // blocks) * ({w}) + b * ({now}) + (({w}) - b * (({w}) // b)) * (({after}) - ({now})))"
    upto = lambda w: taken.format(w=w, now=chosen.format(n=f"({w}) // b"), after=chosen.format(n=f"({w}) // b + 1"))
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(text, '')) AS th FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST({CAP} * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM sums),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM weighed
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, total, CAST({block} AS HUGEINT) AS b,
    least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap)) AS target
  FROM levels),
seats AS (
  SELECT source, row_number() OVER (ORDER BY (target / b) / (2 * seat - 1) DESC, source NULLS LAST, seat) AS place, round(total / b) AS house
  FROM (SELECT *, unnest(range(1, CAST({CAP} * ceil(source_size / b) AS BIGINT) + 1)) AS seat FROM targets WHERE target > 0)),
quotas AS (SELECT source, count(*) AS quota FROM seats WHERE place <= house GROUP BY source),
known AS (
  SELECT t.*, coalesce(quota, 0) AS quota, greatest(CAST(ceil(source_size / b) AS BIGINT), 1) AS blocks
  FROM targets t LEFT JOIN quotas q ON t.source IS NOT DISTINCT FROM q.source),
placed AS (
  SELECT s.doc_id, s.size, k.source_size, k.target, k.quota, k.blocks, k.b, {number(f"'{seed}:' || coalesce(s.source, '')")} % k.blocks AS shift,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY {number(f"concat('{seed}:', coalesce(CAST(s.doc_id AS VARCHAR), ''), ':', s.th)")}, s.doc_id NULLS FIRST, s.th, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM sized s JOIN known k ON s.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, CAST({upto("e")} - {upto("e - size")} AS BIGINT) AS taken FROM placed"""
