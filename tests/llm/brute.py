"""Plain Python versions that the operators are held against."""

import collections
import hashlib
import re


def texts(df):
    """(doc_id, text, source) of a table's rows."""
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(rows, k, percent):
    """[(id, text)] with ids -> sorted [(id, n, component)]."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = collections.defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(n)
    for n, (i, s) in enumerate(sets):
        shared = collections.Counter(m for x in s for m in by[x] if m > n)
        for m, c in shared.items():
            j, t = sets[m]
            if 100 * c >= percent * (len(s) + len(t) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets)


def within_one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p:] == b[p + 1:] or len(a) == len(b) and a[p + 1:] == b[p + 1:]


def lines(rows):
    """[(id, text)], distinct -> sorted [(id, n_lines, n_removed, sha256 of the rest)]."""
    places = [(i is None, i or 0, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x]
    places.sort()
    first, gone = {}, set()
    by_size = collections.defaultdict(list)
    edited = {}
    for _, i, n, x in places:
        if x in first:
            gone.add((i, n))
            if edited[x]:
                gone.add((i, n))
            continue
        first[x] = (i, n)
        edited[x] = any(within_one_edit(x, y) for size in (len(x) - 1, len(x), len(x) + 1) for y in by_size[size])
        if edited[x]:
            gone.add((i, n))
        by_size[len(x)].append(x)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n") if t else []
        kept = [x for n, x in enumerate(parts) if (i or 0, n) not in gone]
        out.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def repeats(rows, length=100):
    """[(id, text)] in order -> [(id, bytes, removed, spans, sha256 of the rest)]."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            x = raw[at:at + length]
            if x in seen:
                cover[at:at + length] = b"\1" * length
            seen.add(x)
        rest = bytes(b for b, c in zip(raw, cover) if not c)
        spans = sum(1 for n, c in enumerate(cover) if c and (n == 0 or not cover[n - 1]))
        out.append((i, len(raw), sum(cover), spans, hashlib.sha256(rest).hexdigest()))
    return out


KINDS = (("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16))


def secrets(text):
    found = []
    for n, (kind, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    found.sort()
    names = [x[2] for x in found]
    return tuple(sum(x.startswith(k[0]) for x in names) for k in KINDS), hashlib.sha256(",".join(names).encode()).hexdigest(), names


def exact(rows):
    """[(id, text)] -> [(keep_id, size, kept, sha)] by row."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for (i, _), x in zip(rows, norm):
        groups[x].append(i)
    out = []
    for (i, _), x in zip(rows, norm):
        ids = [y for y in groups[x] if y is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[x]), keep is None or i == keep, hashlib.sha256(x.encode()).hexdigest()))
    return out


def mix_targets(sizes, weights=(1, 2, 3), most=3):
    """source -> size; targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: share.get(s, float(most * sizes[s])) for s in order}
        full |= over
