import random
from collections import defaultdict

from relspark.llm import mixing


def targets(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: k % 3 + 1 for k, x in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        open_ = [x for x in names if x not in fixed]
        if not open_:
            return fixed
        rest, w = total - sum(fixed.values()), sum(weight[x] for x in open_)
        over = [x for x in open_ if rest * weight[x] / w > 3 * sizes[x]]
        if not over:
            return fixed | {x: rest * weight[x] / w for x in open_}
        fixed |= {x: 3.0 * sizes[x] for x in over}


def sainte_lague(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(votes, key=lambda x: votes[x] / (2 * won[x] + 1))
        won[best] += 1
    return won


def corpus(n=900):
    rng = random.Random(4)
    rows = [(None, None, "a"), (1, "", "a"), (2, "x y", None), (2, "x y", None), (3, "lone", "tiny")]
    for k in range(10, n):
        source = rng.choice(["hot"] * 5 + ["b", "c", "d", "é", None, "z"])
        rows.append((k, " \n".join("w" for _ in range(rng.choice([0, 3, 40, 200, 900]))), source))
    return rows


def test_targets_quotas_and_taken(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 5.0, k, "q", "b", 7) for k, r in enumerate(rows)], "doc_id long, text string, source string, target double, end int, quota string, start string, bucket int")
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str) and len(out) == len(rows)
    assert sorted((r.end, r.quota, r.start, r.bucket) for r in out) == [(k, "q", "b", 7) for k in range(len(rows))]
    assert mixing.mix(docs, text=True).columns == [*(c for c in docs.columns if c != "target"), *mixing.ADDED]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want, got = targets(sizes), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r["size"]
        got[r.source] += r.taken
    for x in sizes:
        assert abs(got[x] - want[x]) <= (mixing.CAP + 1) * mixing.BLOCK, (x, got[x], want[x])


def test_quotas_are_sainte_lague(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.randrange(3000), f"s{rng.randrange(9)}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, votes = mixing.plan(docs, shards=5).collect(), {}
    for r in mixing.mix(docs).collect():
        votes[r.source] = r.target
    house = round(sum(votes.values()) / mixing.BLOCK)
    seats = defaultdict(int)
    for shard in range(1, 6):
        for r in plan:
            if r.shard == shard:
                assert r.quota >= 0
                seats[r.source] += r.quota
        assert dict(seats) == sainte_lague(votes, house * shard // 5)


def test_shards_and_spans(spark):
    """The chosen blocks, listed one by one, are what each shard takes by its quota, and no block is chosen more often than others by two."""
    rows = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_doc, by_source, covered = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in mixing.spans(docs, shards=5).collect():
        by_doc[r.doc_id, r.source, r.shard] += r.end - r.first
        by_source[r.source, r.shard] += r.end - r.first
        for w in range(r.first, r.end):
            covered[r.doc_id, r.source, w] += 1
    want, sizes = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs, shards=5).collect():
        assert sum(r.by_shard) == r.taken and len(r.by_shard) == 5
        sizes[r.source] = r.source_size
        for k, n in enumerate(r.by_shard, 1):
            want[r.doc_id, r.source, k] += n
    assert {k: n for k, n in want.items() if n} == dict(by_doc)
    quotas = {(r.source, r.shard): r.quota for r in mixing.plan(docs, shards=5).collect()}
    for key, quota in quotas.items():
        assert abs(by_source[key] - quota * mixing.BLOCK) < mixing.CAP * mixing.BLOCK, key
    for source in sizes:
        times = [covered[d, s, w] for d, text, s in rows if s == source and d != 2 for w in range(len((text or "").split()))]
        assert not times or max(times) - min(times) <= 1


def test_many_sources(spark):
    """Ranking by ranges gives the same rows as plain windows, for many sources and for few."""
    rng = random.Random(6)
    rows = [(k, "w " * rng.choice([0, 1, 7, 40, 300]), f"host{rng.randrange(400)}" if k % 3 else "hot") for k in range(1500)] + [(9999, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for few in (0, mixing.FEW):
        found = sorted(map(tuple, mixing.mix(docs, few=few).collect()), key=str)
        quotas = sorted(map(tuple, mixing.plan(docs, few=few).collect()), key=str)
        if few == 0:
            want = found, quotas
    assert (found, quotas) == want and len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    goal = targets(sizes)
    assert all(abs(r[4] - goal[r[1]]) < 1e-6 * max(1, r[4]) for r in found)


def test_products_beyond_64_bits(spark):
    """Streams of 2^40 blocks: the choices are spread evenly, without a jump."""
    known = "select 1099511627776L * 16 __end, 700000000001L __quota, 1099511627776L __blocks, 5L __offset"
    x = spark.sql(f"select {mixing._upto('__end', '__quota', 16)} a, {mixing._upto('(__end div 2)', '__quota', 16)} b from ({known})").first()
    assert x.a == 700000000001 * 16 and abs(x.b * 2 - x.a) <= 32


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0 and mixing.plan(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (1, None, "a")], "doc_id long, text string, source string")
    assert [(r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0, 0.0, 0)] * 2
    one = spark.createDataFrame([(1, "a b c", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(one).collect()] in ([(3, 3.0, 3)], [(3, 3.0, 0)])
