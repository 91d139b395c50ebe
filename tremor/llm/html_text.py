"""Main text of web pages: boosted trees over DOM nodes, decoded as a hierarchy (operator 5).

A page is parsed into block elements and text runs (inline tags are transparent). Features of a
node: kind of tag, attribute tokens, the same of its ancestors, depth, sibling statistics, subtree
density (text, links, tags, punctuation) and place in the page. Gradient-boosted oblivious trees,
trained here on generated pages whose layout is known, give each node the chance that it holds
main text. Decoding maximises the total log likelihood of all nodes under the rule that
nothing below a dropped node is kept, so ancestors and descendants never contradict each other.
The kept runs are the text: character references decoded, white space within a block as one space,
blocks joined by one space.

Edge cases: null and empty html gives an empty text; unclosed and crossing tags are closed as the
block structure asks, and an unclosed script, style, svg or comment does not take the page with it; rows that repeat and null keys are handled row by row; extra columns are ignored;
the whole html is read, whatever its length, and only that page is held in memory.
"""

from __future__ import annotations

import functools
import html as htmllib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TREES, DEPTH, BINS, RATE, TRAIN_PAGES = 80, 5, 24, 0.2, 900
GROUPS = ["#text", "p", "li", "h", "cell", "quote", "div", "section", "main", "nav", "header", "footer", "aside", "form", "list", "table", "figure", "address", "body", "other"]
_TAGS = {
    "p": "p", "li": "li", "dt": "li", "dd": "li", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "td": "cell", "th": "cell", "pre": "quote", "blockquote": "quote", "div": "div",
    "section": "section", "article": "main", "main": "main", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "label": "form",
    "button": "form", "select": "form", "option": "form", "ul": "list", "ol": "list", "dl": "list", "table": "table", "thead": "table", "tbody": "table", "tr": "table", "figure": "figure",
    "figcaption": "figure", "address": "address", "body": "body", "html": "body", "details": "section", "summary": "h", "dialog": "aside", "hr": "other", "center": "div", "caption": "figure",
}
TOKENS = {
    "main": "article content post entry story body main text blog prose",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager",
    "ad": "ad ads adv advert advertisement banner promo sponsor sponsored adbox",
    "comment": "comment comments commentlist reply replies respond disqus discussion reader",
    "notice": "cookie cookies notice alert consent gdpr popup modal newsletter subscribe message warning overlay",
    "side": "sidebar side aside related widget share social recommended teaser more",
    "foot": "footer foot copyright legal bottom colophon",
    "head": "header head masthead topbar top logo branding",
}
_TOKEN = {w: k for k, ws in enumerate(TOKENS.values()) for w in ws.split()}
#: Elements whose bodies are no text of the page; the first seven hold no markup.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")
SKIPPED = (*RAW, "template", "svg")
_PART = re.compile(r"<!--|<[a-zA-Z/!?][^\s>\"'/]*+(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>|<[a-zA-Z/!?][^>]*+>|[^<]++|<", re.S)
_SKIP = re.compile(rf"<({'|'.join(SKIPPED)})(?![^\s/>])", re.I)
_END = {t: re.compile(rf"</{t}(?![^\s/>])[^>]*>?", re.I) for t in RAW}
_NEST = {t: re.compile(rf"<(/?){t}(?![^\s/>])[^>]*>?", re.I) for t in SKIPPED[len(RAW) :]}
_BLOCK = re.compile(r"</?(?:article|main|section|div|p|h[1-6]|ul|ol|table|body|header|footer|nav|aside)(?![^\s/>])", re.I)
_NAME = re.compile(r"</?([a-zA-Z][^\s>/]*)")
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


class Forest:
    """The nodes of a batch of pages, each page in preorder under its own root."""

    def __init__(self):
        self.group: list[int] = []
        self.tokens: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.text: list[str] = []
        self.links: list[int] = []
        self.tags: list[int] = []
        self.start: list[int] = []
        self.roots: list[int] = []

    def add(self, group: int, tokens: int, parent: int, start: int, text: str = "", links: int = 0) -> int:
        self.group.append(group)
        self.tokens.append(tokens)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.text.append(text)
        self.links.append(links)
        self.tags.append(1)
        self.start.append(start)
        return len(self.group) - 1


_ID = {g: k for k, g in enumerate(GROUPS)}
_TEXT, _BODY = _ID["#text"], _ID["body"]
_P = {_ID["p"]}
_CLOSES = {"p": {_ID["p"], _ID["h"]}, "li": {_ID["li"], _ID["p"]}, "cell": {_ID["cell"], _ID["p"]}}


def _tokens(tag: str) -> int:
    found = 0
    for m in _ATTR.finditer(tag):
        for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()):
            if w in _TOKEN:
                found |= 1 << _TOKEN[w]
    return found


def _skipped(page: str, tag: str, at: int) -> int:
    """Where the element that opened before ``at`` ends, or -1 if it is never closed."""
    if tag in _END:
        m = _END[tag].search(page, at)
        return m.end() if m else -1
    depth = 1
    for m in _NEST[tag].finditer(page, at):
        depth += -1 if m[1] else not m[0].endswith("/>")
        if not depth:
            return m.end()
    return -1


def _parts(page: str):
    """Tags and texts in order, without comments and skipped elements. One that is never closed does not take
    the page with it: a comment ends at the next ``>``, code at the next block tag, of others only the tag is left out."""
    at, endless = 0, set()
    while at >= 0:
        start, at = at, -1
        for m in _PART.finditer(page, start):
            part = m[0]
            if part == "<!--":
                close = -1 if part in endless else page.find("-->", m.start() + 2)
                if close < 0:
                    endless.add(part)
                    close = page.find(">", m.end()) - 2
                at = close + 3 if close >= 0 else len(page)
                break
            if part[0] != "<" or not (found := _SKIP.match(part)):
                yield part
                continue
            tag = found[1].lower()
            if part.endswith("/>") and tag not in RAW:
                continue
            end = -1 if tag in endless else _skipped(page, tag, m.end())
            if end < 0:
                endless.add(tag)
                if tag in ("script", "style"):
                    block = _BLOCK.search(page, m.end())
                    end = block.start() if block else len(page)
            if end >= 0:
                at = end
                break


def parse(f: Forest, page: str) -> None:
    """Add the tree of blocks and text runs of a page."""
    root = f.add(_BODY, 0, -1, 0)
    f.roots.append(root)
    at, run, in_head, chars, links, link, select = root, [], False, 0, 0, False, -1

    def flush():
        nonlocal run, chars, links
        if run:
            text = " ".join(htmllib.unescape("".join(run)).split())
            if text:
                f.add(_TEXT, 0, at, chars, text, min(links, len(text)))
                chars += len(text)
            run, links = [], 0

    for part in _parts(page):
        if part[0] != "<" or len(part) == 1:
            if not in_head:
                run.append(part)
                links += len(part) * link
            continue
        if not (name := _NAME.match(part)):
            continue
        tag, closing = name[1].lower(), part[1] == "/"
        if tag == "head":
            in_head = not closing
            continue
        if tag == "a":
            link = not closing
        elif tag == "br":
            run.append(" ")
        group = _TAGS.get(tag)
        if group is None:
            f.tags[at] += 1
            continue
        flush()
        link = False
        if tag in ("html", "body"):
            in_head = in_head and tag == "html"
            if not closing:
                f.tokens[root] |= _tokens(part)
            continue
        in_head = False
        if select >= 0 and tag != "option":  # only options stand in a select, so any other block ends it
            at, select = f.parent[select], -1
            if tag == "select" and closing:
                continue
        if closing:
            up, want = at, _ID[group]
            while up != root and f.group[up] != want:
                up = f.parent[up]
            if up != root:
                at = f.parent[up]
            continue
        stop = _CLOSES.get(group, _P)
        while at != root and f.group[at] in stop:
            at = f.parent[at]
        if tag != "hr":
            at = f.add(_ID[group], _tokens(part) if len(part) > len(tag) + 2 else 0, at, chars)
            select = at if tag == "select" else select
    flush()


N_FEATURES = 2 * len(GROUPS) + 2 * len(TOKENS) + 16


class Shape:
    """Arrays of a forest: levels from the roots down, and features."""

    def __init__(self, f: Forest):
        n = len(f.group)
        self.parent, depth = np.array(f.parent), np.array(f.depth)
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2)) if n else [0]
        self.levels = [by_depth[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        group = np.array(f.group)
        leaf = group == _TEXT
        texts = [t for t in f.text if t]
        sums = np.zeros((n, 7))  # size, links, tags, paragraphs, items, stops, digits
        sums[leaf, 0] = [len(t) for t in texts]
        sums[leaf, 5] = [t.count(".") + t.count(",") for t in texts]
        sums[leaf, 6] = [len(_DIGITS.findall(t)) for t in texts]
        sums[:, 1], sums[:, 2], sums[:, 3], sums[:, 4] = f.links, f.tags, group == _ID["p"], group == _ID["li"]
        sums[leaf, 2] = 0
        for level in self.levels[:0:-1]:
            np.add.at(sums, self.parent[level], sums[level])
        g, t = len(GROUPS), len(TOKENS)
        x = np.zeros((n, N_FEATURES), np.float32)
        x[np.arange(n), group] = 1
        x[:, 2 * g : 2 * g + t] = np.array(f.tokens)[:, None] >> np.arange(t) & 1
        root = np.arange(n)
        for level in self.levels[1:]:
            u = self.parent[level]
            root[level] = root[u]
            x[level, g : 2 * g] = np.maximum(x[u, g : 2 * g], x[u, :g])
            x[level, 2 * g + t : 2 * g + 2 * t] = np.maximum(x[u, 2 * g + t : 2 * g + 2 * t], x[u, 2 * g : 2 * g + t])
        size, link, tags, paras, items, stops, digits = sums.T
        kin = np.argsort(self.parent, kind="stable")
        head = np.flatnonzero(np.diff(self.parent[kin], prepend=-2))
        many = np.diff(np.append(head, n))
        place, brothers, before, after = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
        place[kin] = np.arange(n) - np.repeat(head, many)
        brothers[kin] = np.repeat(many, many)
        same = self.parent[kin][1:] == self.parent[kin][:-1]
        before[kin[1:]] = np.where(same, size[kin[:-1]], 0)
        after[kin[:-1]] = np.where(same, size[kin[1:]], 0)
        _, back, times = np.unique(self.parent * g + group, return_inverse=True, return_counts=True)
        alike = times[back]
        roots = self.parent < 0
        place[roots], brothers[roots], alike[roots], before[roots], after[roots] = 0, 1, 1, 0, 0
        total, one, up = np.maximum(size[root], 1), np.maximum(size, 1), np.maximum(self.parent, 0)
        o = 2 * g + 2 * t
        for j, col in enumerate((depth, np.log1p(place), np.log1p(brothers), alike / brothers, np.log1p(size), link / one, tags / one * 100, np.log1p(paras), np.log1p(items), size / total, np.array(f.start) / total, stops / one * 100, digits / one, np.log1p(before), np.log1p(after), size / np.maximum(size[up], 1))):
            x[:, o + j] = col
        self.features = x


_DIGITS = re.compile("[0-9]")


def decode(shape: Shape, p: np.ndarray) -> np.ndarray:
    """The likeliest keep marks with no kept node below a dropped one."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    inside, outside = np.log(p), np.log1p(-p)
    for level in shape.levels[:0:-1]:
        np.add.at(inside, shape.parent[level], np.maximum(inside[level], outside[level]))
        np.add.at(outside, shape.parent[level], outside[level])
    keep = inside > outside
    for level in shape.levels[1:]:
        keep[level] &= keep[shape.parent[level]]
    return keep


def predict(model, f: np.ndarray) -> np.ndarray:
    base, feats, cuts, leaves = model
    z = np.full(len(f), base)
    for k in range(len(feats)):
        z += leaves[k][(f[:, feats[k]] > cuts[k]) @ (1 << np.arange(DEPTH))]
    return 1 / (1 + np.exp(-z))


def boost(f: np.ndarray, y: np.ndarray):
    """Oblivious trees on the log loss, with quantile bins; each tree looks at a random half of the features."""
    rng = np.random.default_rng(5)
    edges = [np.unique(np.quantile(f[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(f.shape[1])]
    edges = [np.unique(np.append(e, 0.5)) if set(np.unique(f[:, j])) <= {0.0, 1.0} else e for j, e in enumerate(edges)]
    binned = [np.searchsorted(e, f[:, j], side="left") for j, e in enumerate(edges)]
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    z, feats, cuts, leaves = np.full(len(y), base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p) + 1e-6
        leaf, tree_f, tree_c = np.zeros(len(y), np.int64), [], []
        chosen = rng.permutation(len(binned))[: (len(binned) + 1) // 2].tolist()
        for level in range(DEPTH):
            best = (-1.0, 0, 0)
            for j in chosen:
                b, nb = binned[j], len(edges[j]) + 1
                if nb < 2:
                    continue
                gs = np.bincount(leaf * nb + b, g, nb << level).reshape(-1, nb).cumsum(axis=1)
                hs = np.bincount(leaf * nb + b, h, nb << level).reshape(-1, nb).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = (gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1)).sum(axis=0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            _, j, k = best
            tree_f.append(j)
            tree_c.append(edges[j][k])
            leaf += (binned[j] > k).astype(np.int64) << level
        value = RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + 1)
        z = z + value[leaf]
        feats.append(np.array(tree_f))
        cuts.append(np.array(tree_c, np.float32))
        leaves.append(value)
    return base, feats, cuts, leaves


def _generated(r: random.Random) -> str:
    """A page of a random layout; words that stand in its main text begin with ``x``."""
    syllables = "an be co du el fi ga ho in ka lo mi no pe qua ra so ta un ve".split()
    word = lambda main: ("x" if main else "b") + "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(main: bool, a: int, b: int) -> str:
        noise = r.choice(["", "", "", "", "!!", "***", " |"])
        out = [word(main) + (noise if r.random() < 0.5 else "") + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(a, b))]
        return " ".join(out)

    def links(main: bool, a: int, b: int) -> str:
        kind = r.choice(["ul", "ol", "div"])
        item = "li" if kind != "div" else r.choice(["p", "div", "span"])
        return f"<{kind}>" + "".join(f"<{item}><a href='/{k}'>{words(main, 1, 4)}</a></{item}>" for k in range(r.randint(a, b))) + f"</{kind}>"

    def wrap(tags: str, names: str, inner: str, plain: float = 0.2) -> str:
        tag = r.choice(tags.split())
        use = r.choice(names.split())
        attr = "" if tag not in ("div", "section", "ul") and r.random() < 0.6 or r.random() < plain and tag not in ("div", "section", "ul") else f' {r.choice(["class", "class", "id"])}="{r.choice(["", "site-", "page-"])}{use}{r.choice(["", "", " box", "-wrap"])}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    prose = lambda main, a, b: "".join(f"<p>{words(main, 1, 60)}" + r.choice(["</p>", "</p>", "<br>"]) for _ in range(r.randint(a, b)))
    boiler = {
        "nav": lambda: wrap("nav nav div ul", "nav menu navbar breadcrumb navigation", links(False, 2, 9)),
        "head": lambda: wrap("header header div", "header masthead topbar", r.choice(["", f"<h1>{words(False, 1, 4)}</h1>"]) + words(False, 1, 8) + r.choice(["", links(False, 1, 5)])),
        "ad": lambda: wrap("div div div aside section", "ad ads advert banner promo sponsored", r.choice([words(False, 3, 40), prose(False, 1, 2), f"<a href='/x'>{words(False, 2, 9)}</a>"])),
        "side": lambda: wrap("aside aside div section", "sidebar related widget share social", f"<h3>{words(False, 1, 3)}</h3>" + r.choice([links(False, 2, 8), prose(False, 1, 3)])),
        "notice": lambda: wrap("div div section aside", "cookie-notice notice alert consent newsletter popup", r.choice([prose(False, 1, 2), words(False, 4, 30)]) + r.choice(["", "<button>" + words(False, 1, 2) + "</button>"])),
        "form": lambda: f"<form>{words(False, 1, 9)}<label>{words(False, 1, 4)}</label><input><button>{words(False, 1, 2)}</button>{r.choice(['', prose(False, 1, 1)])}</form>",
        "comment": lambda: wrap("section div ol", "comments commentlist discussion replies", f"<h3>{words(False, 1, 3)}</h3>" + "".join(wrap("div li article", "comment reply", f"<b>{words(False, 1, 2)}</b>" + prose(False, 1, 3), 0) for _ in range(r.randint(1, 6)))),
        "foot": lambda: wrap("footer footer div", "footer copyright colophon", "&copy; " + r.choice([words(False, 3, 40), prose(False, 1, 2)]) + r.choice(["", links(False, 1, 5)])),
    }

    def article() -> str:
        body = r.choice([f"<h1>{words(True, 1, 9)}</h1>", f"<h1>{words(True, 1, 9)}</h1>", ""])
        for _ in range(r.randint(1, 9)):
            body += r.choices([
                prose(True, 1, 3), f"<h2>{words(True, 1, 6)}</h2>", "<ul>" + "".join(f"<li>{words(True, 1, 15)}</li>" for _ in range(r.randint(1, 6))) + "</ul>",
                links(True, 2, 6), f"<p>{words(True, 1, 9)}<select>" + "".join(f"<option>{words(False, 1, 2)}" for _ in range(r.randint(1, 5))) + f"</select>{words(True, 1, 9)}</p>",
                f"<blockquote>{words(True, 3, 40)}</blockquote>", f"<table><tr><td>{words(True, 1, 5)}</td><td>{words(True, 1, 5)}</td></tr></table>", f"<pre>{words(True, 3, 20)}</pre>",
                words(True, 5, 60), f"<div>{words(True, 5, 60)}</div>", f"<p>{words(True, 1, 9)}<a href='/y'>{words(True, 1, 4)}</a>{words(True, 1, 9)}</p>",
            ], [8, 2, 1, 0.5, 0.2, 1, 1, 1, 1, 1, 2])[0]
            if r.random() < 0.08:
                body += boiler[r.choice(["ad", "side", "form", "notice"])]()
        if r.random() < 0.2:
            body += f"<h2>{words(True, 1, 3)}</h2>" + links(True, 2, 6)  # a list of linked sources
        named = wrap("article article main main div section", "content post entry article story main-content post-body entry-content text", body)
        grid = f'<div class="{r.choice(["row", "grid", "columns", "flex"])}"><div class="{r.choice(["col-8", "col", "column", "cell", "w-2/3"])}">{body}</div></div>'
        return r.choices([named, body, f"<div>{body}</div>", f"<section>{body}</section>", f"<div><div>{body}</div></div>", grid], [10, 4, 3, 1, 1, 2])[0]

    top = [boiler[k]() for k in ("nav", "head", "notice", "ad", "side", "form") if r.random() < 0.5]
    end = [boiler[k]() for k in ("foot", "comment", "side", "ad", "form", "notice", "nav") if r.random() < 0.5]
    r.shuffle(top)
    inner = "".join(top) + (article() if r.random() < 0.97 else "") + "".join(end)
    if r.random() < 0.3:
        inner = wrap("div main", "page wrapper container", inner)
    return f"<html><head><title>t</title></head><body>{inner}</body></html>"


@functools.cache
def trained(seed: int = 11):
    """The model, from ``TRAIN_PAGES`` generated pages; the same on every call."""
    r = random.Random(seed)
    forest = Forest()
    for _ in range(TRAIN_PAGES):
        parse(forest, _generated(r))
    shape = Shape(forest)
    y = np.array([float(t.startswith("x")) for t in forest.text])
    for level in shape.levels[:0:-1]:
        np.maximum.at(y, shape.parent[level], y[level])
    return boost(shape.features, y)


def main_texts(model, pages: list[str]) -> list[str]:
    forest = Forest()
    for page in pages:
        parse(forest, page)
    if not pages:
        return []
    shape = Shape(forest)
    keep = decode(shape, predict(model, shape.features)).tolist()
    ends = [*forest.roots[1:], len(keep)]
    return [" ".join(forest.text[i] for i in range(a, b) if keep[i] and forest.text[i]) for a, b in zip(forest.roots, ends, strict=True)]


def _extracted(model):
    def run(batches):
        for batch in batches:
            pages = batch.column(batch.schema.get_field_index("html"))
            texts: list[str] = []
            group, size = [], 0
            for x in pages:
                group.append(x.as_py() or "")
                size += len(group[-1])
                if size > 1 << 20:
                    texts += main_texts(model.value, group)
                    group, size = [], 0
            texts += main_texts(model.value, group)
            keep = [batch.column(batch.schema.get_field_index(n)) for n in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages(page_id, url, html)``."""
    model = pages.sparkSession.sparkContext.broadcast(trained())
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extracted(model), f"page_id {kind}, url string, text string, n_chars long")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
