import hashlib
import math
import random
import re
from collections import Counter

from relspark.llm import secrets


def base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return out


def entropy(text):
    """Spans of the windows of enough entropy, from the definition."""
    out, w = [], secrets.WINDOW
    for _, pattern, needs, lacks, least in secrets.CLASSES:
        for m in re.finditer(pattern, text):
            if not all(re.search(x, m[0]) for x in ("[0-9]", "[A-Za-z]", needs)) or re.search(lacks, m[0]) or re.search(secrets.UUID, m[0]):
                continue
            barred = [x.span() for x in re.finditer(secrets.ALLOWED, m[0])]
            span = None
            for i in range(len(m[0]) - w + 1):
                if any(i < e and s < i + w for s, e in barred):
                    continue
                if -sum(c / w * math.log2(c / w) for c in Counter(m[0][i : i + w]).values()) >= least:
                    at = m.start() + i
                    if span and at <= span[1] and not any(span[1] - m.start() <= s < at + w - m.start() for s, _ in barred):
                        span[1] = at + w
                    else:
                        span = [at, at + w]
                        out.append(span)
    return [(s, 3, e) for s, e in out]


def digest(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_against_brute_force(spark):
    rng = random.Random(9)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    make = [
        lambda: "password = " + pick("abc123", rng.randrange(4, 14)), lambda: 'API_Key":  "' + pick(b64, 30) + '"', lambda: "apikey:" + pick("ab.=", 9),
        lambda: "AKIA" + pick("ABC123", rng.randrange(8, 20)), lambda: pick("0123456789abcdef", rng.randrange(18, 50)), lambda: pick(b64, rng.randrange(18, 60)),
        lambda: "a" * 30 + "1" + pick(b64, 40), lambda: pick(b64, 30) + "example", lambda: "password = token: abcdefgh12", lambda: "é𝒳ü", lambda: "w" * 25,
        lambda: "12345678-1234-1234-1234-123456789012", lambda: "tOKen=secret=abcdefgh", lambda: pick("0123456789ABCDEF", 32), lambda: "key_" + pick("0123456789abcdef", 24) + "-live", lambda: pick(b64, 22),
        lambda: pick(b64, 25) + "a" * rng.randrange(5, 60) + pick(b64, 25), lambda: pick(b64, 300) + "0000" + pick(b64, 24) + "Sample" + pick(b64, 30), lambda: pick("ab1", 30) + pick(b64, 21),
    ]
    texts = [None, "", "plain", "AKIA", "secret="] + [" ".join(rng.choice(make)() for _ in range(rng.randrange(1, 9))) for _ in range(250)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        found = base(t or "")
        r, kinds = rows[k], Counter(x[1] for x in found)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2]), t
        assert r.base_sha256 == hashlib.sha256(digest(found).encode()).hexdigest(), t
        assert r.spans == digest(found + entropy(t or "")), (t, r.spans)
    assert sum("entropy" in r.spans for r in rows.values()) > 50


def test_edges(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "word " * 200_000 + "AKIA" + "Z9" * 8
    rows = secrets.scan(spark.createDataFrame([(None, long)] * 2, "doc_id long, text string")).collect()
    assert [(r.n_access, r.spans.startswith("access:1000000:1000020")) for r in rows] == [(1, True)] * 2


def test_long_candidates_and_many_matches(spark):
    """Linear in the text: a long run of characters in one string, and very many strings."""
    rng = random.Random(4)
    run = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=300_000))
    part = run[:6000] + "q" * 40 + run[6000:9000]
    many = " ".join(f"{rng.getrandbits(160):040x}" for _ in range(20_000))
    rows = {r.doc_id: r for r in secrets.scan(spark.createDataFrame([(1, run), (2, many), (3, part)], "doc_id long, text string")).collect()}
    assert rows[1].spans.count("entropy") >= 1 and rows[1].spans.startswith("entropy:0:")
    assert rows[2].n_hex == 20_000 and rows[2].spans.endswith(f":{len(many)}")
    assert rows[3].spans == digest(base(part) + entropy(part))


def test_kinds_of_secret_strings_are_found(spark):
    """Of random strings of the usual forms nearly all are found, of words joined by hyphens none."""
    rng = random.Random(8)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    kinds = {"upper hex": lambda: pick("0123456789ABCDEF", 32), "lower hex": lambda: "x-" + pick("0123456789abcdef", 31) + "_y", "short": lambda: pick(b64, 22), "long": lambda: pick(b64, 40)}
    docs = spark.createDataFrame([(k, f"the {make()} end") for k, make in enumerate(x for x in kinds.values() for _ in range(200))], "doc_id long, text string")
    found = [0] * len(kinds)
    for r in secrets.scan(docs).collect():
        found[r.doc_id // 200] += "entropy" in r.spans
    assert min(found) >= 185, dict(zip(kinds, found, strict=True))
    plain = spark.createDataFrame([(k, "see how-to-make-the-best-pizza-at-home-2023 and aaaaaaaaaaaaaaaaaaaaaaaa1") for k in range(3)], "doc_id long, text string")
    assert not any("entropy" in r.spans for r in secrets.scan(plain).collect())
