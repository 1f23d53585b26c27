"""Near, exact, line and passage dedup against brute force."""

import random

import brute
from brute import texts
from fixtures import documents, empty, odd  # noqa: F401

from loghawk.llm.components import connected_components
from loghawk.llm.exact_dedup import exact_duplicates
from loghawk.llm.line_dedup import dedup_lines, documents_without_repeated_lines
from loghawk.llm.near_dedup import first_of_near_duplicates, near_duplicates
from loghawk.llm.repeats import remove_repeats


def test_near_duplicates_match_brute_force(documents):
    rows = [(i, t) for i, t, _ in texts(documents)]
    for k, percent, band in ((3, 85, 6), (5, 80, 5)):
        got = near_duplicates(documents, k=k, percent=percent, rows=band).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute.near(rows, k, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(odd, empty):
    rows = texts(odd)
    got = near_duplicates(odd, k=3, percent=85, rows=6).collect()
    assert len(got) == len(rows)
    want = {i: c for i, _, c in brute.near([(i, t) for i, t, _ in rows if i is not None], 3, 85)}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert want[2] == 1 and want[7] == 6 and want[5] == 5
    assert near_duplicates(empty).collect() == []
    left = first_of_near_duplicates(odd, k=3, percent=85, rows=6)
    assert left.columns == odd.columns and 2 not in {r.doc_id for r in left.collect()}


def test_near_duplicates_in_one_large_group(spark, monkeypatch):
    """Copies with edits of their own, over several blocks: no link is lost."""
    from loghawk.llm import near_dedup
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, k=3, percent=85, rows=6).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute.near(rows, 3, 85)


def test_near_duplicates_of_a_hot_group_grow_in_proportion(spark, monkeypatch):
    """Near copies over many blocks, three groups of them in a chain with texts between, and others
    that only share buckets: right links, and the rows sent to compare don't grow by the number of blocks."""
    from loghawk.llm import near_dedup
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    sent = []

    def counted(df, name, keep=near_dedup.store):
        out = keep(df, name)
        if name.endswith("asked"):
            sent.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "store", counted)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(400):
        w = list(base)
        for _ in range(1 + (d % 40 == 0) * 7):
            w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, k=3, percent=85, rows=6).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute.near(rows, 3, 85)
    print("rows sent", sent)
    assert sum(sent) < 40 * len(rows)
    sent.clear()
    chain = []
    for d in range(150):        # each a window of a long run of words: only neighbours are near
        chain.append((d, " ".join(f"w{i}" for i in range(d % 50 * 2, d % 50 * 2 + 60))))
    chain += [(1000 + d, " ".join([f"w{i}" for i in range(30)] + [f"x{d}y{i}" for i in range(9 + d % 5)])) for d in range(40)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 2)
    got = near_duplicates(df, k=3, percent=85, rows=6).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute.near(chain, 3, 85)


def test_bands_decide_what_near_duplicates_lose():
    """At the threshold, the gate on equal minima loses far less than the bands."""
    from math import ceil, comb

    from loghawk.llm import near_dedup
    n = near_dedup.HASHES
    for percent, rows in ((85, 6), (80, 5)):
        q = percent / 100 + (1 - percent / 100) / 256       # a byte of each minimum
        gate = sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(ceil(near_dedup.gate(percent))))
        bands = (1 - q**rows) ** (n // rows)
        assert gate < bands / 10 and gate + bands < 1 / 1_500_000, (percent, gate, bands)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_exact_duplicates(documents, odd, empty):
    for df in (documents, odd):
        want = brute.exact([(i, t) for i, t, _ in texts(df)])
        for support in (0.002, 0.2, 1.0):
            got = [tuple(r) for r in exact_duplicates(df, support=support).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_duplicates(empty).collect() == []


def test_lines_match_brute_force(documents, odd, empty):
    rows = [(i, t) for i, t, _ in texts(documents)]
    assert sorted(tuple(r) for r in dedup_lines(documents).collect()) == sorted(brute.lines(rows))
    one = odd.where("doc_id is null or doc_id <> 10").dropDuplicates(["doc_id", "text"])
    got = dedup_lines(one)
    want = brute.lines([(i, t) for i, t, _ in texts(one)])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert dedup_lines(odd).count() == odd.count()
    assert dedup_lines(empty).collect() == []


def test_lines_one_edit_apart(spark):
    rng = random.Random(11)
    rows, d = [], 0
    for size in (1, 2, 3, 17, 63, 64, 65, 127, 128, 129, 300):
        base = "".join(rng.choice("abcd é") for _ in range(size)).replace("\n", "") or "a"
        rows.append((d := d + 1, base))
        for _ in range(12):
            at, x = rng.randrange(len(base) + 1), rng.choice("abcdz")
            rows.append((d := d + 1, rng.choice([base[:at] + x + base[at:], base[:at] + base[at + 1:], base[:at] + x + base[at + 1:], base + "zz"])))
    rows = [(i, t) for i, t in rows if t]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in dedup_lines(df).collect()) == sorted(brute.lines(rows))


def test_documents_without_repeated_lines(spark):
    df = spark.createDataFrame([(1, "one line here\n\ntwo lines here", 29, "x"), (2, "one line here", 13, "x"), (3, "one lime here\nthree", 19, "x"), (4, None, None, "x"), (5, "", 0, "x")],
                               "doc_id long, text string, n_chars long, line string")
    got = {r.doc_id: (r.text, r.n_chars) for r in documents_without_repeated_lines(df).collect()}
    assert got == {1: ("one line here\n\ntwo lines here", 29), 3: ("three", 5), 4: (None, None), 5: ("", 0)}


def test_repeats_match_brute_force(documents, odd, empty):
    rows = sorted((i, t) for i, t, _ in texts(documents))
    assert sorted(tuple(r) for r in remove_repeats(documents).collect()) == brute.repeats(rows)
    one = odd.where("doc_id is not null and doc_id <> 10").dropDuplicates(["doc_id"])
    rows = sorted(((i, t) for i, t, _ in texts(one)), key=lambda r: r[0])
    assert sorted(tuple(r) for r in remove_repeats(one).collect()) == brute.repeats(rows)
    assert remove_repeats(odd).count() == odd.count()
    assert remove_repeats(empty).collect() == []


def test_repeats_of_a_very_common_passage(spark, monkeypatch):
    """Anchors with more stretches than a task takes are dealt out by window: same result."""
    from loghawk.llm import repeats
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = []
    for d in range(60):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200)))
        cut = rng.randrange(40)
        rows.append((d, own + passage[cut:130 - rng.randrange(30)] + own[::-1] + ("ab" * 90 if d % 7 == 0 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.repeats(rows)
    assert sorted(tuple(r) for r in remove_repeats(df).collect()) == want
    monkeypatch.setattr(repeats, "MOST_STRETCHES", 3)
    assert sorted(tuple(r) for r in remove_repeats(df).collect()) == want


def test_repeats_with_hot_anchors(spark, monkeypatch):
    """Anchors of a passage that many share are sorted in parts: the earliest of all parts is the first."""
    from loghawk.llm import repeats
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = []
    for d in range(90):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 160)))
        cut = rng.randrange(3) * 20
        rows.append((d, own + passage[cut:] + own[::-1] + (passage[:150] if d % 9 == 0 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute.repeats(rows)
    named = []
    monkeypatch.setattr(repeats, "store", lambda x, name, keep=repeats.store: named.append((name, keep(x, name))) or named[-1][1])
    monkeypatch.setattr(repeats, "SAMPLE", 1.0)
    monkeypatch.setattr(repeats, "SALTS", 7)
    assert sorted(tuple(r) for r in remove_repeats(df).collect()) == want
    tables = dict(named)
    assert tables["rp-hot"].count() > 0 and tables["rp-hot-stretches"].count() > 0
