"""Secret scans with DataFrame functions only.

Base spans are the matches of three patterns (assign, access, hex). Entropy spans come from candidate strings, which
each character class has its own of: hexadecimal runs of one case, and runs of base64 characters. A candidate is cut where a
placeholder of the allow list stands in it; what is left is scored. A window of WINDOW characters slides over it: its Shannon
entropy follows from the sum of count * log2(count) over its characters, and that sum changes by the count of the
character that enters and of the one that leaves. Windows of enough entropy that overlap or touch are one span.
A whole candidate that is a UUID adds nothing; base spans stay whatever the allow list says.

Everything is linear in the text: strings are cut into pieces of PIECE characters and lists into chunks of CHUNK entries,
within which sums run, and then over the pieces. The sums are whole numbers (logarithms times 2^40), so
they don't drift.

Offsets are in code points, end exclusive. Defined results: a null text is the empty text and has no spans;
repeated rows each get their row; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run shorter than 32 fails as a whole
KINDS = ("assign", "access", "hex", "entropy")

WINDOW, PIECE, CHUNK = 20, 1024, 256
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
# name, candidates, what of them is of the class, what is not, least entropy of a window in bits
ONE_CASE = "^(?:[0-9a-f]+|[0-9A-F]+)$"
CLASSES = (("hex", "[A-Za-z0-9]{20,}", ONE_CASE, "^$", 3.0), ("base64", CANDIDATE, "[A-Za-z]", ONE_CASE, 3.7))
# fixed values: the allow list
ALLOWED = "(?i)example|sample|placeholder|dummy|changeme|xxxx|0000|123456789|abcdefgh"
UUID = "^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"

_PARTS = "array<struct<b:int,s:int,e:int,t:string,m:string>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _parts(text: Column, pattern: str) -> Column:
    """A text around the matches of the pattern: for each match, and at the end, the text t from b to s before the match m from s to e."""

    def chunk(pairs: Column, k: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["t"])
            end = start + F.coalesce(F.length(x["m"]), F.lit(0))
            found = F.struct(a["at"].alias("b"), start.alias("s"), end.alias("e"), x["t"].alias("t"), x["m"].alias("m"))
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(found)).alias("out"))

        return F.aggregate(F.slice(pairs, k * CHUNK + 1, F.lit(CHUNK)), F.struct(F.lit(0).alias("at"), F.array().cast(_PARTS).alias("out")), step)

    def placed(chunks: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(chunks, none, lambda a, c: F.struct((a["at"] + c["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        moved = lambda x, by: F.struct((x["b"] + by).alias("b"), (x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["t"].alias("t"), x["m"].alias("m"))
        return F.flatten(F.zip_with(chunks, bases, lambda c, by: F.transform(c["out"], lambda x: moved(x, by))))

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t, m: F.struct(t.alias("t"), m.alias("m")))
    chunks = _let(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda k: chunk(p, k)))
    return _let(chunks, placed)


def _places(text: Column, pattern: str) -> Column:
    """The matches of the pattern, of _parts."""
    return F.filter(_parts(text, pattern), lambda x: x["m"].isNotNull())


def _gain(n: Column) -> Column:
    """2^40 times what one more of a character of which a window has n adds to the sum of count * log2(count)."""
    g = [k * math.log2(k) if k else 0.0 for k in range(WINDOW + 1)]
    return F.get(F.array(*(F.lit(round((b - a) * 2**40)) for a, b in zip(g, g[1:], strict=False))), n)


_RUNS = "array<struct<lo:int,hi:int>>"


def _join(runs: Column, lo: Column, hi: Column) -> Column:
    """The runs with one more from first window lo to last window hi, which joins the last one if their spans overlap or touch."""
    last = F.element_at(runs, -1)
    one = F.array(F.struct(lo.alias("lo"), hi.alias("hi")))
    joined = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["lo"].alias("lo"), hi.alias("hi"))))
    return F.when((F.size(runs) > 0) & (F.coalesce(last["hi"], F.lit(0)) + WINDOW >= lo), joined).otherwise(F.concat(runs, one))


def _high(piece: Column, base: Column, bits: float) -> Column:
    """The runs (first and last begin, moved by base) of the piece's windows of at least so many bits."""
    most = round(WINDOW * (math.log2(WINDOW) - bits) * 2**40)
    same = lambda chars, c, first, n: F.size(F.filter(F.slice(chars, first, n), lambda y: y == c))
    none = F.struct(F.lit(0).cast("long").alias("t"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.array().cast(_RUNS).alias("out"))

    def slid(x: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            total = a["t"] + F.get(x["come"], i) - F.when(i >= WINDOW, F.get(x["gone"], i - WINDOW)).otherwise(F.lit(0))
            start = i - (WINDOW - 1)
            high, open_ = (start >= 0) & (total <= most), a["lo"] >= 0
            near = open_ & (start <= a["hi"] + WINDOW)
            lo = F.when(high & ~near, start).otherwise(a["lo"])
            out = F.when(high & open_ & ~near, F.concat(a["out"], F.array(F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"))))).otherwise(a["out"])
            return F.struct(total.alias("t"), lo.alias("lo"), F.when(high, start).otherwise(a["hi"]).alias("hi"), out.alias("out"))

        finish = lambda a: F.when(a["lo"] >= 0, F.concat(a["out"], F.array(F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"))))).otherwise(a["out"])
        return F.aggregate(F.sequence(F.lit(0), F.size(x["come"]) - 1), none, step, finish)

    def counted(chars: Column) -> Column:
        # of a character: how many of it the window that it enters has, and how many are left in the window that it leaves
        come = F.transform(chars, lambda c, j: _gain(same(chars, c, F.greatest(j - (WINDOW - 2), F.lit(1)), F.least(j, F.lit(WINDOW - 1)))))
        gone = F.transform(chars, lambda c, j: _gain(same(chars, c, j + 2, F.lit(WINDOW - 1))))
        return F.struct(come.alias("come"), gone.alias("gone"))

    chars = F.slice(F.split(piece, "", -1), F.lit(1), F.length(piece))
    runs = _let(_let(chars, counted), slid)
    return F.transform(runs, lambda r: F.struct((r["lo"] + base).alias("lo"), (r["hi"] + base).alias("hi")))


def _scored(part: Column, bits: float) -> Column:
    """Spans s, e of the windows of enough entropy in the text of an entry of _parts."""

    def cut(pieces: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.slice(pieces, F.lit(1), F.size(pieces) - 1))
        overlapping = F.zip_with(pieces, before, lambda p, q: F.struct(p.alias("p"), F.right(q, F.lit(WINDOW - 1)).alias("q")))
        return F.transform(overlapping, lambda x, k: _high(F.concat(x["q"], x["p"]), k * PIECE - F.length(x["q"]), bits))

    runs = _let(F.regexp_extract_all(part["t"], F.lit(f".{{1,{PIECE}}}"), F.lit(0)), cut)
    # runs of one piece are apart already: only the first of the next may join the last
    joined = F.aggregate(
        runs,
        F.array().cast(_RUNS),
        lambda a, r: F.when(F.size(r) > 0, F.concat(_join(a, F.get(r, F.lit(0))["lo"], F.get(r, F.lit(0))["hi"]), F.slice(r, F.lit(2), F.size(r)))).otherwise(a),
    )
    return F.transform(joined, lambda r: F.struct((part["b"] + r["lo"]).alias("s"), (part["b"] + r["hi"] + WINDOW).alias("e")))


def _entropy(text: Column, pattern: str, needs: str, lacks: str, bits: float) -> Column:
    """Spans s, e of the class's candidates."""
    fit = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & m.rlike(needs) & ~m.rlike(lacks) & ~m.rlike(UUID)
    found = F.filter(_places(text, pattern), lambda x: fit(x["m"]))

    def spans(x: Column) -> Column:
        rest = F.filter(_parts(x["m"], ALLOWED), lambda p: F.length(p["t"]) >= WINDOW)
        return F.transform(F.flatten(F.transform(rest, lambda p: _scored(p, bits))), lambda y: F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e")))

    return F.flatten(F.transform(found, spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, then kind) of each document."""
    ends = lambda found: F.transform(found, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e")))
    only = lambda there, found: F.when(there, found).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    small = F.lower("t")
    named = small.contains("password") | small.contains("passwd") | small.contains("secret") | small.contains("token") | small.contains("api")
    # cheap tests first: a text without the words or runs that a pattern needs isn't searched for it
    x = x.select("doc_id", "t", named.alias("named"), F.col("t").rlike(CANDIDATE).alias("long"))
    value = F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))
    assign = F.zip_with(_places(F.col("t"), ASSIGN), value, lambda p, v: F.when(F.length(v) >= 8, p))
    x = x.select(
        "doc_id",
        only(F.col("named"), ends(F.filter(assign, lambda p: p.isNotNull()))).alias("assign"),
        only(F.col("t").contains("AKIA"), ends(F.filter(_places(F.col("t"), ACCESS), lambda p: F.length(p["m"]) >= 16))).alias("access"),
        only(F.col("long"), ends(_places(F.col("t"), HEX))).alias("hex"),
        only(F.col("long"), F.concat(*(_entropy(F.col("t"), *kind[1:]) for kind in CLASSES))).alias("entropy"),
    )
    ranked: Callable[[str], Column] = lambda kind: F.transform(kind, lambda p: F.struct(p["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), p["e"].alias("e")))
    names = F.array(*map(F.lit, KINDS))
    text_of = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda p: F.concat_ws(":", F.get(names, p["k"]), p["s"].cast("string"), p["e"].cast("string"))), ",")
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    base = text_of(F.concat(*map(ranked, KINDS[:3])))
    return x.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), text_of(F.concat(*map(ranked, KINDS))).alias("spans"))
