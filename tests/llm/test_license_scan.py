import random
import re

from raschmill.llm.license_scan import PHRASES, TEMPLATES, needed, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text):
    w = WORD.findall(low(text))
    places, base = [], set()
    for p, label in PHRASES:
        ps = p.split()
        for i in range(len(w) - len(ps) + 1):
            if w[i : i + len(ps)] == ps:
                places.append(i)
                base.add(label)
    found, best = set(), 0.0
    for line in low(text).split("\n"):
        b = set(WORD.findall(line))
        for label, t in TEMPLATES:
            s = set(t.split())
            if len(b & s) >= needed(len(s)):
                found.add(label)
                best = max(best, len(b & s) / len(s))
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(found), 1.0 if places else best


def test_against_brute_force(spark):
    r = random.Random(6)
    pool = [w for _, t in TEMPLATES for w in t.split()] + ["x", "É", "Apache", "MIT", "nc", "CC"]
    sep = [" ", "  ", ", ", ".\n", "-", "\n"]
    texts = ["cc by nc cc by nc", "CC BY-NC", "under the mit license under the mit license", " ", "", None, "a" * 50_000, "cc by nc\ncc-by-nc, apache license version 2 under the MIT License!"]
    for _ in range(300):
        parts = []
        for _ in range(r.randint(0, 6)):
            if r.random() < 0.5:
                ws = r.choice(TEMPLATES)[1].split()
                ws = [w for w in ws if r.random() < 0.93]
                if r.random() < 0.3:
                    r.shuffle(ws)
                parts += [r.choice([" ", "-", ", "]).join(ws)]
            elif r.random() < 0.4:
                parts.append(r.choice(PHRASES)[0].title())
            else:
                parts.append(" ".join(r.choice(pool) for _ in range(r.randint(0, 12))))
        texts.append(r.choice(sep).join(parts))
    rows = list(enumerate(texts)) + [(None, texts[20])]
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, label string")
    got = {x["id"]: tuple(x)[1:] for x in scan(docs).collect()}
    for i, t in rows:
        assert got[i] == brute(t), (i, t)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "nothing")], "doc_id long, text string")
    got = sorted((r["n_words"], ",".join(r["found"]), r["score"]) for r in scan(docs).collect())
    assert got == [(1, "", 0.0), (5, "mit", 1.0), (5, "mit", 1.0)]
    assert scan(docs.limit(0)).count() == 0
