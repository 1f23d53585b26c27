"""Plain versions of the quality classifier and of the secret scan's ownership."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
from fixtures import SF, documents, odd  # noqa: F401
from pyspark.sql import functions as F

from loghawk.llm import quality
from loghawk.llm.quality import quality_scores
from loghawk.llm.secret_scan import TOKEN, scan


# ---- naive Bayes support vectors

def plain_features(raw):
    out = {(raw[i] << 8) | raw[i + 1] for i in range(len(raw) - 1)}
    out |= {quality.PAIRS + ((((raw[i] << 16) | (raw[i + 1] << 8) | raw[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 15) for i in range(len(raw) - 2)}
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    capitals = sum(65 <= b <= 90 for b in raw)
    marks = sum(not (9 <= b <= 13 or b == 32 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in raw)
    figures = (sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, capitals / size, marks / size, (len(raw) - n) / n, len(words))
    for i, (x, bounds) in enumerate(zip(figures, quality.BINS.values())):
        out.add(quality.PAIRS + quality.TRIPLES + quality.STEP * i + sum(x >= b for b in bounds))
    return out


def test_quality_scores_match_a_plain_version(spark, documents):
    """Log-count ratios, dual coordinate descent, calibration and scores, one number at a time."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    picks = dict(documents.select("doc_id", F.xxhash64(F.lit(8), "doc_id")).collect())
    rows = sorted((picks[r.doc_id], r.doc_id, r.quality) for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    held = [(plain_features(texts[i]), y) for _, i, y in rows]
    count = [collections.Counter(), collections.Counter()]
    for f, y in held:
        count[y].update(f)
    total = [sum(c.values()) + quality.SIZE for c in count]
    ratio = lambda x: math.log((count[1][x] + 1) / total[1]) - math.log((count[0][x] + 1) / total[0])
    scale = {x: ratio(x) for f, _ in held for x in f}
    good = sum(y for _, y in held) / len(held)
    cost = [0.5 / good if y else 0.5 / (1 - good) for _, y in held]
    w, alpha, rng = collections.defaultdict(float), [0.0] * len(held), np.random.default_rng(8)
    norm = [max(math.sqrt(sum(scale[x] ** 2 for x in f)), 1e-12) for f, _ in held]
    for _ in range(20):
        moved = 0.0
        for i in rng.permutation(len(held)):
            f, y = held[i][0], 1.0 if held[i][1] else -1.0
            gradient = y * sum(w[x] * scale[x] for x in f) / norm[i] - 1.0
            new = min(max(alpha[i] - gradient, 0.0), cost[i])
            for x in f if new != alpha[i] else ():
                w[x] += (new - alpha[i]) * y * scale[x] / norm[i]
            moved, alpha[i] = max(moved, abs(new - alpha[i])), new
        if moved < 1e-3:
            break
    every = {x: (w.get(x, 0.0) * s, s * s) for x, s in scale.items()}
    unseen = math.log(1 / total[1]) - math.log(1 / total[0])

    def margin(f):
        known = [every.get(x, (0.0, unseen ** 2)) for x in f]
        return sum(a for a, _ in known) / max(math.sqrt(sum(b for _, b in known)), 1e-12)

    a, b = 1.0, 0.0
    points = [(margin(f), 0.99 if y else 0.01, c) for (f, y), c in zip(held, cost)]
    for _ in range(30):
        g0, g1, h00, h01, h11 = 1e-3 * a, 0.0, 1e-3, 0.0, 1e-3
        for x, t, c in points:
            p = 1 / (1 + math.exp(-min(max(a * x + b, -30), 30)))
            g0, g1, q = g0 + c * (p - t) * x, g1 + c * (p - t), c * p * (1 - p)
            h00, h01, h11 = h00 + q * x * x, h01 + q * x, h11 + q
        det = h00 * h11 - h01 * h01
        a, b = a - (h11 * g0 - h01 * g1) / det, b - (h00 * g1 - h01 * g0) / det
    a = max(a, 1e-6)
    got = {r.doc_id: r for r in quality_scores(documents, labels).collect()}
    assert set(got) == set(texts)
    for i, raw in texts.items():
        want = 1 / (1 + math.exp(-(a * margin(plain_features(raw)) + b)))
        assert abs(got[i].score - want) < 1e-4, i
        assert got[i].predicted == int(want >= 0.5) or abs(want - 0.5) < 1e-4


def test_quality_ties(spark):
    """Equal texts have equal scores, whatever their id, source and label."""
    rows = [(i, "some plain words stand here and say a thing" if i % 2 else "xx !!! ## xx xx", "en", "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    assert len({r.score for r in got if r.doc_id % 2}) == len({r.score for r in got if not r.doc_id % 2}) == 1
    assert all(r.predicted == r.doc_id % 2 for r in got)


# ---- ownership of secrets

def plain_scan(rows, max_owners=2, max_repositories=4):
    """[(id, text, lang, source)] -> sorted [(id, spans, n_live, n_example)]."""
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [("assign", assign, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    found = []
    for i, text, lang, source in rows:
        spans = [(m.start(), n, m.end(), m[g]) for n, (_, p, g, least) in enumerate(kinds) for m in p.finditer(text or "") if len(m[g]) >= least]
        base = [(s, e) for s, _, e, _ in spans]
        spans += [(m.start(), 3, m.end(), m[0]) for m in re.finditer(TOKEN[1], text or "") if not any(s < m.end() and m.start() < e for s, e in base)]
        found.append((i, source, (source, lang), spans))
    owners, repositories = collections.defaultdict(set), collections.defaultdict(set)
    for _, o, r, spans in found:
        for *_, value in spans:
            owners[value].add(o)
            repositories[value].add(r)
    live = lambda v: len(owners[v]) <= max_owners and len(repositories[v]) <= max_repositories
    out = []
    for i, _, _, spans in found:
        names = [f"{('assign', 'access', 'hex', 'token')[n]}:{s}:{e}" for s, n, e, v in sorted(spans, key=lambda x: x[:2]) if n < 3 or live(v)]
        out.append((i, ",".join(names), sum(live(x[3]) for x in spans), sum(not live(x[3]) for x in spans)))
    return sorted(out, key=str)


def test_ownership_matches_a_plain_version(spark, documents, odd):
    rng = random.Random(3)
    values = ["".join(rng.choice("ABCDEFGHabcdefgh0123456789") for _ in range(rng.choice([16, 22, 30]))) + "aB1" for _ in range(25)]
    values += ["AKIA" + "".join(rng.choice("ABCDEF0123456789") for _ in range(16)) for _ in range(5)] + [hashlib.md5(str(i).encode()).hexdigest() for i in range(5)]
    made = []
    for i in range(300):
        v = rng.choice(values[:8]) if rng.random() < 0.4 else rng.choice(values)
        text = rng.choice(["see {} here", "password = '{}'", "token: {} and {}", "{}", "x{}", "api_key={}, {}"]).replace("{}", v, 1).replace("{}", rng.choice(values))
        made.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "c", None]), 1, 1, "c"))
    extra = spark.createDataFrame(made, odd.schema)
    for df in (documents, odd, extra):
        rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
        got = sorted(((r.doc_id, r.spans, r.n_live, r.n_example) for r in scan(df).collect()), key=str)
        assert got == plain_scan(rows)
    found = plain_scan([r[:4] for r in made])
    assert any(x[3] for x in found) and any(x[2] for x in found)
