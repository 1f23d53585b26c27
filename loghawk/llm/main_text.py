"""Main text of web pages by a tree-structured graphical model (operator 4).

A page's elements form a tree; each element is content or not.  A potential of
each element comes from its own features, one of each edge from the states of
parent and child; sum-product messages, up from the leaves and down from the
root, give every element's content marginal.  Both kinds of potentials are
counted from labelled pages, those that name their main part themselves
(<article>, <main>): inside it is content, except for markup that is never text and blocks
whose name says that they are comments or advertising.  A table's parts take over the
state of what holds the table, and so does what stands inline.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# comment, CDATA, declaration, tag, or a broken tag
TOKENS = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)
 |<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++(?:[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)?+)*+)>|<[a-zA-Z/][^>]*+(?:>|$)""".replace("\n ", ""), re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
# Element kinds of the HTML standard: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4
 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
#: What an opening tag ends, if that is open within the nearest of the second kind.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
PARAGRAPH_ENDS = BLOCK - {"option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "head", "html", "body", "button", "legend", "title"}
#: Never text of an article.
MARKUP = frozenset("head script style textarea title noscript template iframe noembed noframes xmp svg canvas audio video form button select input nav footer aside dialog menu".split())
MAIN = frozenset(("article", "main"))
#: Boxes that may hold an article or something else.
BOX = frozenset("div section center fieldset details header hgroup figure".split())
#: A table and its parts: short cells without a full stop say nothing of what they belong to.
TABLE = frozenset("table thead tbody tfoot tr td th caption colgroup".split())
#: Containers, boxes and lists: a name tells what the whole of them is for.
CONTAINER = BOX | TABLE | frozenset("ul ol dl article".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks whose class ends in one of these words (containers: also id, role and itemprop), as in
#: "reader-comments" or "google-ad", are no text of an article, also within it.
BOILERPLATE = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsored promo comment comments commentlist disqus newsletter
 cookie cookies""".split())
#: The same for whole names that end in a word with other uses.
BOILERPLATE_NAMES = frozenset("""ad-container ad-slot ad-banner adsbygoogle comment-list comments-area comments-section comment-section disqus_thread cookie-notice cookie-banner
 cookie-consent newsletter-signup""".split())
#: Words in the names of containers outside <article> and <main> that speak against content: a moderate prior on a learned feature.
OTHER = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead
 topbar footer foot bottom sidebar side aside rail widget notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login form search comment comments
 reply replies respond discussion disqus share sharing social related recommended recommendations more pagination pager toolbar skip copyright legal tags""".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

STATES = 2
#: What a page's elements count together, so that a page of very many doesn't drown the others.
PAGE_WEIGHT = 20.0


class Node:
    __slots__ = ("tag", "parent", "names", "hidden", "boiler", "inside")

    def __init__(self, tag: str, parent: int, names: frozenset, hidden: bool, boiler: bool = False, inside: bool = False):
        self.tag, self.parent, self.names, self.hidden = tag, parent, names, hidden
        self.boiler, self.inside = boiler, inside     # named as comments or advertising; within <article> or <main>

    def never(self) -> bool:
        """Never content, whatever its features are."""
        return self.tag in MARKUP or self.hidden or self.boiler


def boilerplate(tag: str, found: dict[str, str]) -> bool:
    """Does a block's name say that it is no text of an article?"""
    if tag not in BLOCK or tag in HEADING:
        return False
    given = " ".join(found.get(k, "") for k in (("class", "id", "role", "itemprop") if tag in CONTAINER else ("class",)))
    for name in given.split():
        words = WORDS.findall(name)
        if name.lower() in BOILERPLATE_NAMES or words and words[-1].lower() in BOILERPLATE:
            return True
    return False


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in page order (each behind its parent) and text runs (element,
    decoded text); a run of text \"\" is a block's edge or a line break."""
    nodes = [Node("", -1, frozenset(), False)]
    runs: list[tuple[int, str]] = []
    stack = [0]
    at, low = 0, None
    opened: Counter = Counter()     # of each tag, so that the stack is only searched for what is in it

    def close(upto: int) -> None:
        if any(nodes[x].tag in BLOCK for x in stack[upto:]):
            runs.append((0, ""))
        opened.subtract(nodes[x].tag for x in stack[upto:])
        del stack[upto:]

    def text(a: int, b: int) -> None:
        if a < b:
            t = page[a:b]
            runs.append((stack[-1], html.unescape(t) if "&" in t else t))

    for m in iter(lambda: TOKENS.search(page, at), None):
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag))
            elif tag in ("p", "br"):
                runs.append((0, ""))
            continue
        if tag in PARAGRAPH_ENDS and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == "p":
                    close(i)
                    break
                if nodes[stack[i]].tag in ("button", "table", "td", "th", "object"):
                    break
        if tag in ENDS and any(opened[x] for x in ENDS[tag][0]):
            ended, within = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag in within:
                    break
                if nodes[stack[i]].tag in ended:
                    close(i)
                    break
        if tag in BLOCK or tag == "br":
            runs.append((0, ""))
        if tag in VOID:
            continue
        names, hidden, boiler = frozenset(), False, False
        if m[3]:
            found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(m[3])}
            given = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop"))
            names, boiler = frozenset(w.lower() for w in WORDS.findall(given)), boilerplate(tag, found)
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        above = nodes[stack[-1]]
        nodes.append(Node(tag, stack[-1], names, hidden, boiler, above.inside or above.tag in MAIN))
        shut = m[3].rstrip().endswith("/")
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
            if end >= 0:
                close_at = page.find(">", end)
                at = len(page) if close_at < 0 else close_at + 1
            continue
        if not shut or not opened["svg"] + opened["math"]:     # a slash closes only there
            stack.append(len(nodes) - 1)
            opened[tag] += 1
    text(at, len(page))
    return nodes, runs


#: Features of open classes (tags, words in names) are numbered by a hash.
HASHED = 1 << 16


def hashed(kind: str, word: str) -> str:
    return f"{kind}={zlib.crc32(word.encode()) % HASHED}"


def describe(nodes: list[Node], runs: list[tuple[int, str]]) -> list[list[str]]:
    """Features of each element, from itself and from the text that it holds."""
    n = len(nodes)
    chars, linked, stops, children = [0] * n, [0] * n, [0] * n, [0] * n
    for i, t in runs:
        t = t.strip()
        chars[i] += len(t)
        stops[i] += t.count(". ") + t.endswith(".")
        if nodes[i].tag == "a":
            linked[i] += len(t)
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        linked[p] += chars[i] if nodes[i].tag == "a" else linked[i]
        stops[p] += stops[i]
        children[p] += 1
    out = []
    for i, x in enumerate(nodes):
        share = linked[i] / chars[i] if chars[i] else 0
        f = [hashed("tag", x.tag), f"links={int(share * 4)}"]
        if x.tag not in TABLE:
            f += [f"chars={chars[i].bit_length()}", f"stops={min(stops[i], 3)}", f"children={min(children[i], 4)}"]
        f += [hashed("name", w) for w in x.names]
        if x.tag in CONTAINER and not x.inside and x.names & OTHER:
            f.append("other")
        if x.never():
            f.append("markup")
        out.append(f)
    return out


def truth(nodes: list[Node]) -> list[int] | None:
    """States of a labelled page's elements; None if the page names no main part."""
    if not any(x.tag in MAIN or "main" in x.names and x.tag == "div" for x in nodes):
        return None
    out: list[int] = []
    for i, x in enumerate(nodes):
        inside = bool(i) and out[x.parent] == 1 or x.tag in MAIN
        out.append(int(inside and not x.never() and not (x.tag == "header" and "site" in x.names)))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            nodes, runs = parse(page or "")
            states = truth(nodes)
            if states is None:
                continue
            each = PAGE_WEIGHT / len(nodes)
            for i, (f, s) in enumerate(zip(describe(nodes, runs), states)):
                for x in f:
                    c[x, s] += each
                c["", s] += each
                if i:
                    c[f"edge={states[nodes[i].parent]}:{kind(nodes[i])}", s] += each
    keys = sorted(c)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([float(c[k]) for k in keys], pa.float64())], ["feature", "state", "n"])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most_pages: int = 2000) -> dict[str, tuple[float, float]]:
    """Log potentials of the features and of the edges, from labelled pages: at
    most ``most_pages``, those of the smallest hash of the id.  All features count; there are
    at most 2 * ``HASHED`` and some dozens."""
    some = pages.select(F.col(f"`{html_col}`").cast("string").alias("html"), F.xxhash64(F.lit(4), F.col(f"`{id_col}`").cast("string")).alias("pick"))
    some = some.where("html rlike '(?i)<(article|main)'")
    # the hash up to which most_pages lie; only hashes meet in one task
    upto = some.select("pick").orderBy("pick").limit(most_pages).agg(F.max("pick")).first()[0]
    rows = some.where(F.col("pick") <= F.lit(upto).cast("long")).select("html").mapInArrow(_counts, "feature string, state int, n double").groupBy("feature", "state").agg(F.sum("n").alias("n"))
    c: Counter = Counter()
    for r in rows.collect():
        c[r.feature, r.state] = r.n
    return potentials(c)


#: Beforehand: of a child of each kind, the share that is content below a part that isn't, and below one that is.
#: What is never content says nothing of its parent.
EDGES = {"main": (0.98, 0.99), "box": (0.05, 0.99), "table": (0.05, 0.9999), "text": (0.002, 0.99), "none": (1e-6, 1e-6)}
#: Share of a state's elements that any feature is taken to have, so that little follows from one never seen.
SEEN = 0.01
#: Weight of this, in elements; log potentials against content: beforehand, on top of the learned, of the words of OTHER, and of what is never content.
PRIOR, OTHER_LOG, MARKUP_LOG = 1000.0, -4.0, -400.0


def kind(x: Node) -> str:
    return "none" if x.never() else "main" if x.tag in MAIN else "box" if x.tag in BOX else "table" if x.tag in TABLE else "text"


def potentials(c: Counter) -> dict[str, tuple[float, float]]:
    """Log potentials from the counts of (feature, state)."""
    totals = [c["", s] + 50.0 for s in (0, 1)]
    model = {x: tuple(float(np.log(c[x, s] / totals[s] + SEEN)) for s in (0, 1)) for x in {k for k, _ in c} if x and not x.startswith("edge=")}
    model[""] = tuple(float(np.log(t / sum(totals))) for t in totals)
    for x, shares in EDGES.items():
        for parent, share in enumerate(shares):
            name = f"edge={parent}:{x}"
            a, b = c[name, 0] + PRIOR * (1 - share), c[name, 1] + PRIOR * share
            model[name] = (float(np.log(a / (a + b))), float(np.log(b / (a + b))))
    without, content = model.get("other", (0.0, 0.0))
    model["other"], model["markup"] = (without, content + OTHER_LOG), (0.0, MARKUP_LOG)
    return model


def marginals(nodes: list[Node], described: list[list[str]], model: dict[str, tuple[float, float]], shade: float = 0.5) -> list[float]:
    """Content marginal of each element by sum-product, up and then down.
    ``shade`` tempers the features' potentials, which aren't independent."""
    n = len(nodes)
    own = np.zeros((n, STATES))
    for i, f in enumerate(described):
        a, b = 0.0, 0.0
        for x in f:
            p = model.get(x)
            if p:
                a, b = a + p[0], b + p[1]
        own[i] = a * shade, b * shade
    edges = {k: np.exp(np.array([model[f"edge=0:{k}"], model[f"edge=1:{k}"]])).tolist() for k in EDGES}      # [parent][child]
    e_of = [edges[kind(x)] for x in nodes]
    belief = [[1.0, 1.0] for _ in range(n)]
    raise_to = np.exp(own - own.max(axis=1, keepdims=True)).tolist()
    for i in range(n):
        belief[i] = [max(raise_to[i][0], 1e-100), max(raise_to[i][1], 1e-100)]
    up = [[1.0, 1.0] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        (b0, b1), e = belief[i], e_of[i]
        m0, m1 = e[0][0] * b0 + e[0][1] * b1, e[1][0] * b0 + e[1][1] * b1
        z = m0 + m1
        up[i] = [m0 / z, m1 / z]
        p = belief[nodes[i].parent]
        p[0] *= up[i][0]
        p[1] *= up[i][1]
        z = p[0] + p[1]
        p[0], p[1] = max(p[0] / z, 1e-300), max(p[1] / z, 1e-300)
    start = model[""]
    z0, z1 = belief[0][0] * np.exp(start[0]), belief[0][1] * np.exp(start[1])
    belief[0] = [z0 / (z0 + z1), z1 / (z0 + z1)]
    for i in range(1, n):
        p, e = belief[nodes[i].parent], e_of[i]
        q0, q1 = p[0] / up[i][0], p[1] / up[i][1]
        d0, d1 = q0 * e[0][0] + q1 * e[1][0], q0 * e[0][1] + q1 * e[1][1]
        b0, b1 = belief[i][0] * d0, belief[i][1] * d1
        z = b0 + b1
        belief[i] = [b0 / z, b1 / z]
    return [float(b[1]) for b in belief]


def extract(page: str, model: dict[str, tuple[float, float]]) -> str:
    """The blocks of the elements that are content, one on a line."""
    nodes, runs = parse(page)
    content = marginals(nodes, describe(nodes, runs), model)
    out, block = [], []
    for i, t in [*runs, (0, "")]:
        if t == "":
            line = SPACE.sub(" ", "".join(block)).strip(" ")
            if line:
                out.append(line)
            block = []
        elif content[i] >= 0.5:
            block.append(t)
    return "\n".join(out)


def _extract(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x or "", model) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_pages: int = 2000) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each input row.

    Character references are decoded, runs of white space within a block
    become one space, blocks are trimmed and joined by a line feed.  Null and
    empty pages, and pages without content, have the text "".  Without any
    page that names its main part the beforehand potentials alone decide.
    Rows that repeat are answered each.  Extra columns are ignored.
    """
    model = fit(pages, id_col, html_col, most_pages)
    some = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return some.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
