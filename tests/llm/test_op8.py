import random
import re

from relspark.llm import licenses
from relspark.llm.license_texts import NOTICES, templates


def brute(rows):
    table = sorted({(name, tuple(licenses.bigrams(text))) for name, text in templates()})
    out = set()
    for doc, text in rows:
        if not text:
            continue
        parts = re.split(r"\n[ \t\r]*\n", text)
        units = [("line", i, x) for i, x in enumerate(text.split("\n"))] + [("paragraph", i, x) for i, x in enumerate(parts) if "\n" in x]
        units += [("text", 0, text)] if len(parts) > 1 else []
        for unit, place, body in units:
            g = set(licenses.bigrams(body))
            best = min(((-2 * len(g & set(t)) / (len(g) + len(t)), name) for name, t in table if g), default=(0, ""))
            if -best[0] >= licenses.THRESHOLD:
                out.add((doc, unit, place, best[1], round(-best[0], 9)))
        words = re.findall("[a-z0-9]+", text.lower())
        best = {}
        for name, body in templates():
            wide, t = len(re.findall("[a-z0-9]+", body.lower())), set(licenses.bigrams(body))
            for s in range(0, len(words) - wide + 1, max(1, wide // 10)):
                g = {f"{a} {b}" for a, b in zip(words[s : s + wide], words[s + 1 : s + wide], strict=False)}
                dice = 2 * len(g & t) / (len(g) + len(t))
                if dice >= licenses.THRESHOLD:
                    best[name] = min(best.get(name, (0, 0)), (-dice, s))
        out |= {(doc, "window", s, name, round(-d, 9)) for name, (d, s) in best.items()}
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(None, "Released under the MIT License."), (1, None), (2, ""), (3, "licensed"), (4, "RELEASED under the mit license"), (4, "RELEASED under the mit license")]
    for k in range(10, 120):
        name, text = rng.choice(templates())
        words = text.split()
        for _ in range(rng.randrange(0, 1 + len(words) // 6)):
            words[rng.randrange(len(words))] = rng.choice(["x", "the", "license"])
        lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)] if rng.random() < 0.5 else [" ".join(words)]
        rows.append((k, "\n".join(["some prose", rng.choice(["", "more"]), *lines, rng.choice(["", " \t"]), "Ärger end of file"])))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted(set(map(tuple, licenses.scan(docs).collect())), key=str)
    assert got == brute(rows)
    assert {"line", "paragraph"} <= {x[1] for x in got}


def test_whole_notices_are_found(spark):
    docs = spark.createDataFrame([(k, "x = 1\n\n" + text.replace(". ", ".\n") + "\n\ny = 2\n") for k, text in enumerate(NOTICES.values())], "doc_id long, text string")
    found = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert set(enumerate(NOTICES)) <= found
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licences_above_code_and_within_prose(spark):
    code = "\n".join(f"def f{k}(x):\n    return x + {k}" for k in range(80))
    prose = " ".join(f"word{k % 37} and thing{k}" for k in range(150))
    texts = {}
    for k, (name, text) in enumerate(NOTICES.items()):
        words = text.split()
        lines = "\n".join("# " + " ".join(words[i : i + 11]) for i in range(0, len(words), 11))
        texts[3 * k] = (name, f"# Copyright 2020 A\n#\n{lines}\n\n{code}")
        texts[3 * k + 1] = (name, f"{prose} {text} {prose}")
        texts[3 * k + 2] = (name, f"Copyright 2023 Example\n{text[: len(text) // 2]}\n\n{text[len(text) // 2 :]}\n\n{prose}\n\n{prose}")
    texts[1000] = ("MIT", "Copyright 2023 Example Foo Inc Released under the MIT License")
    docs = spark.createDataFrame([(k, t) for k, (_, t) in texts.items()], "doc_id long, text string")
    found = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert {(k, n) for k, (n, _) in texts.items()} <= found
    plain = spark.createDataFrame([(1, code), (2, prose)], "doc_id long, text string")
    assert licenses.scan(plain).count() == 0
