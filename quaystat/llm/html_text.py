"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a list of element nodes with figures about tag, attribute words, depth, siblings and the density of
text, links and tags below. Trees score each node; a pass from the leaves up then keeps the set of nodes of
largest total score in which every kept node's ancestors are kept, so a dropped menu can't hold a kept
paragraph. Spark's own GBTClassifier fits the trees on a bounded sample: at most TRAIN_PAGES pages, labelled
by their own markup (what stands in <article> or <main>), each also rendered anew in other kinds of markup,
so that the trees can't lean on those two tags alone.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystat.llm.common import ship

#: Bound of the labelled sample: pages by the smallest hash of their id, and variants of each.
TRAIN_PAGES, RENDERINGS, SHORTENED = 160, 5, 2
TREES, DEPTH = 30, 5

BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
DROP = set("script style title head template noscript iframe svg math object canvas noembed noframes textarea select".split())
CONTROL = set("button label input select textarea option fieldset legend".split())
#: A start tag closes these open elements, up to the named bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSE_P = BLOCK - {"html", "body", "option", "optgroup", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "noscript", "frameset"}

GOOD = set("article articlebody content post entry main story text body prose page".split())
BAD = set("ad ads adv advert advertisement advertorial banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer foot form header head login masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related reply replies respond search share sharing sidebar side signup skip social sponsor sponsored subscribe tags teaser toolbar widget".split())
GROUPS = [{"article", "main"}, {"nav", "header", "footer", "aside", "menu"}, {"p", "pre", "blockquote"}, {"li", "ul", "ol", "dl", "dt", "dd"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"table", "tr", "td", "th", "tbody"}, {"form", "dialog", *CONTROL}, {"div", "section", "body", "html"}]

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_MAIN = re.compile(r"(<(?:article|main)\b[^>]*>)(.*?)(</(?:article|main)>|\Z)", re.S | re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


class Page:
    """Nodes in page order (node 0 is the root) and text pieces with their node; None marks a block's edge."""

    def __init__(self, source: str):
        self.tag, self.parent, self.words, self.at = ["#root"], [-1], [()], [0]
        self.links: list[int] = [0]  # characters of own text inside <a>
        self.chars, self.marks, self.inner = [0], [0], [0]
        self.pieces: list[tuple[int, str] | None] = []
        self._read(source)

    def _read(self, s: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # every open element, with the node its text belongs to
        dropped = anchor = 0
        at, find, seen = 0, _TOKEN.search, 0

        def text(raw: str) -> None:
            nonlocal seen
            if dropped or not raw:
                return
            t = html.unescape(raw) if "&" in raw else raw
            node = stack[-1][1]
            self.pieces.append((node, t))
            n = len(t) - t.count(" ")
            seen += n
            self.chars[node] += n
            self.marks[node] += t.count(".") + t.count(",") + t.count("!") + t.count("?")
            if anchor:
                self.links[node] += n

        def pop() -> None:
            nonlocal dropped, anchor
            tag, _ = stack.pop()
            if tag in DROP:
                dropped -= 1
            elif tag == "a":
                anchor -= 1
            if tag in BLOCK:
                self.pieces.append(None)

        while True:
            m = find(s, at)
            if not m:
                text(s[at:])
                return
            text(s[at : m.start()])
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    text(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag = m[2].lower()
            if m[1]:
                if any(t == tag for t, _ in stack[1:]):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                elif tag in ("p", "br"):
                    self.pieces.append(None)
                continue
            if tag == "br":
                self.pieces.append(None)
                continue
            if tag in CLOSE_P and any(t == "p" for t, _ in stack):
                while len(stack) > 1 and any(t == "p" for t, _ in stack):
                    pop()
            if tag in CLOSES:
                ends, bounds = CLOSES[tag]
                k = len(stack) - 1
                while k > 0 and stack[k][0] not in bounds and stack[k][0] not in ends:
                    k -= 1
                if k > 0 and stack[k][0] in ends:
                    del_to = k
                    while len(stack) > del_to:
                        pop()
            words = ()
            if "=" in m[3]:
                words = tuple(w.lower() for a in _ATTRIBUTE.finditer(m[3]) for w in _WORD.findall(a[2] or a[3] or a[4] or ""))
            node = stack[-1][1]
            if tag in BLOCK or words or tag in CONTROL:
                node = len(self.tag)
                self.tag.append(tag)
                self.parent.append(stack[-1][1])
                self.words.append(words)
                self.at.append(seen)
                for x in (self.links, self.chars, self.marks, self.inner):
                    x.append(0)
            else:
                self.inner[node] += 1
            if tag in BLOCK:
                self.pieces.append(None)
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span"):
                continue
            stack.append((tag, node))
            if tag in DROP:
                dropped += 1
            elif tag == "a":
                anchor += 1
            if tag in RAW:
                end = _RAW_END[tag].search(s, at)
                at = end.start() if end else len(s)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        own = np.array([self.chars, self.links, self.marks, self.inner], np.float64)
        under = own.copy()
        under[3] += 1
        for i in range(n - 1, 0, -1):
            under[:, parent[i]] += under[:, i]
        groups = np.array([[t in g for g in GROUPS] for t in self.tag], np.float64)
        good = np.array([sum(w in GOOD for w in ws) for ws in self.words], np.float64)
        bad = np.array([sum(w in BAD for w in ws) for ws in self.words], np.float64)
        depth, above = np.zeros(n), np.zeros((n, 4))  # above: article/main, nav and the like, good words, bad words
        mine = np.stack([groups[:, 0], np.maximum(groups[:, 1], groups[:, 6]), np.minimum(good, 1), np.minimum(bad, 1)], 1)
        kids, same, order = np.zeros(n), np.zeros(n), np.zeros(n)
        count: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            above[i] = np.maximum(above[p], mine[p])
            order[i] = kids[p]
            kids[p] += 1
            count[p, self.tag[i]] = count.get((p, self.tag[i]), 0) + 1
        for i in range(1, n):
            same[i] = count[parent[i], self.tag[i]]
        total = max(1.0, under[0, 0])
        sub, up = np.maximum(under[0], 1), np.maximum(under[0][parent], 1)
        cols = [
            groups, above, good, bad, depth, kids, same, order / np.maximum(1, kids[parent]),
            np.log1p(own[0]), np.log1p(under[0]), under[0] / total, under[0] / under[3], under[1] / sub, under[2] / sub,
            under[0] / up, under[1][parent] / up, under[0][parent] / np.maximum(under[3][parent], 1), np.array(self.at) / total,
        ]
        return np.concatenate([c.reshape(n, -1) for c in cols], 1)

    def chosen(self, score: np.ndarray) -> np.ndarray:
        """The nodes to keep: of all sets that hold each node's ancestors the one of largest score."""
        n = len(self.tag)
        under = np.array(self.chars, np.float64)
        for i in range(n - 1, 0, -1):
            under[self.parent[i]] += under[i]
        best = score * (np.array(self.chars) + 0.5 * under)
        best[0] = 0.0
        for i in range(n - 1, 0, -1):
            if best[i] > 0:
                best[self.parent[i]] += best[i]
        keep = best > 0
        keep[0] = True
        for i in range(1, n):
            keep[i] &= keep[self.parent[i]]
        return keep

    def text(self, keep: np.ndarray) -> str:
        out, block = [], []
        for piece in [*self.pieces, None]:
            if piece is None:
                if t := " ".join("".join(block).split()):
                    out.append(t)
                block = []
            elif keep[piece[0]]:
                block.append(piece[1])
        return "\n".join(out)

    def main(self) -> np.ndarray:
        """Nodes that stand in main text by the page's own tags, or by words of a rendering."""
        inside = np.zeros(len(self.tag), bool)
        for i in range(1, len(self.tag)):
            out = self.tag[i] in GROUPS[1] or self.tag[i] in GROUPS[6] or "qsnoise" in self.words[i]
            inside[i] = (inside[self.parent[i]] or self.tag[i] in GROUPS[0] or "qstext" in self.words[i]) and not out
        return inside

    def labels(self) -> np.ndarray:
        """1 where a node or one below it has main text by the page's own tags, or by words of a rendering."""
        n, inside = len(self.tag), self.main()
        both = np.array([self.chars, np.where(inside, self.chars, 0)], np.float64)
        for i in range(n - 1, 0, -1):
            both[:, self.parent[i]] += both[:, i]
        return (both[1] > 0).astype(np.float64)


class Trees:
    """Boosted regression trees as arrays."""

    def __init__(self, feature, threshold, left, right, value):
        self.parts = [np.asarray(x) for x in (feature, threshold, left, right, value)]

    @classmethod
    def of(cls, model) -> Trees:
        """The arrays of a fitted GBTClassificationModel; all features are continuous."""
        size = 2 ** (DEPTH + 1)
        n = len(model.treeWeights)
        feature, threshold = np.zeros((n, size), np.int64), np.full((n, size), np.inf)
        left, right, value = np.tile(np.arange(size), (n, 1)), np.tile(np.arange(size), (n, 1)), np.zeros((n, size))
        for k, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
            todo, used = [(0, tree._java_obj.rootNode())], 1
            while todo:
                at, node = todo.pop()
                if node.subtreeDepth() == 0:
                    value[k, at] = weight * node.prediction()
                    continue
                feature[k, at], threshold[k, at] = node.split().featureIndex(), node.split().threshold()
                left[k, at], right[k, at] = used, used + 1
                todo += [(used, node.leftChild()), (used + 1, node.rightChild())]
                used += 2
        return cls(feature, threshold, left, right, value)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, value in zip(*self.parts):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            out += value[at]
        return 2 * out


def rendered(text: list[str], noise: list[str], rng: random.Random) -> str:
    """A page of other markup with these main and other blocks. The words qstext and qsnoise carry the labels only."""
    e = html.escape
    short = lambda: e(" ".join(rng.choice(noise or ["more"]).split()[: rng.randint(1, 6)]))
    link = lambda: f'<a href="/{rng.randint(1, 99)}">{short()}</a>'
    other = lambda: e(rng.choice(noise or ["more to read"]))

    def part(kind: str) -> str:
        style = rng.random()
        name = {"nav": ["nav", "main-menu", "navbar"], "header": ["header", "masthead", "top-header"], "footer": ["footer", "page-footer", "foot"], "aside": ["sidebar", "related", "widget side"], "notice": ["cookie-notice", "consent", "notice"], "ad": ["ad", "advert", "sponsored", "promo banner"], "comments": ["comments", "comment-list", "replies"], "form": ["newsletter", "search-form", "signup"]}[kind]
        inner = {
            "nav": lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9))) + "</ul>",
            "header": lambda: f"<div>{short()}</div>" + link(),
            "footer": lambda: f"&copy; {short()} &middot; {other()}" if rng.random() < 0.6 else f"<p>{other()}</p>{link()} {link()}",
            "aside": lambda: f"<h3>{short()}</h3><ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 6))) + "</ul>" if rng.random() < 0.6 else f"<p>{other()}</p>",
            "notice": lambda: f"<p>{other()}</p><button>{short()}</button>" if rng.random() < 0.5 else other(),
            "ad": lambda: other() if rng.random() < 0.6 else f"<p>{other()}</p>{link()}",
            "comments": lambda: f"<h3>{short()}</h3>" + "".join(f"<div class=comment><b>{short()}</b><p>{e(rng.choice(text or ['nice']))[:300]}</p></div>" for _ in range(rng.randint(1, 4))),
            "form": lambda: f"<label>{short()}</label><input name=q><button>{short()}</button><p>{other()}</p>",
        }[kind]()
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        if style < 0.4:
            return f'<{tag} class="qsnoise {rng.choice(name)}">{inner}</{tag}>'
        return f'<{"form" if kind == "form" else "div"} {rng.choice(["class", "id"])}="qsnoise {rng.choice(name)}">{inner}</{"form" if kind == "form" else "div"}>'

    body = []
    for k, t in enumerate(text):
        body.append(f"<h1>{e(t)}</h1>" if k == 0 and rng.random() < 0.7 else rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>" if len(t) < 80 else "<p>{}</p>"]).format(e(t)))
    for kind in rng.sample(["ad", "aside", "notice", "form", "nav", "comments"], rng.randint(0, 3)):
        body.insert(rng.randint(0, len(body)) if kind != "comments" else len(body), part(kind))
    shell = rng.choice(['<article class="qstext">{}</article>', '<main class="qstext">{}</main>', '<div class="qstext post-content">{}</div>', '<div id="qstext content"><div class="entry">{}</div></div>', '<div class="qstext">{}</div>', '<section class="qstext story"><div>{}</div></section>'])
    before = "".join(part(k) for k in ["header", "nav", *rng.sample(["ad", "notice", "aside", "form"], rng.randint(0, 3))])
    after = "".join(part(k) for k in [*rng.sample(["aside", "comments", "ad", "form", "notice"], rng.randint(0, 3)), "footer"])
    return f"<html><head><title>{short()}</title></head><body>{before}{shell.format(''.join(body))}{after}</body></html>"


def training_rows(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of the pages and their renderings."""
    xs, ys = [], []
    for k, source in enumerate(pages):
        rng = random.Random(k)
        page = Page(source)
        inside = page.main()
        versions = [source] if inside.any() else []
        main = [x for x in page.text(inside).split("\n") if x]
        other = [x for x in page.text(~inside).split("\n") if x]
        for _ in range(SHORTENED if versions else 0):  # the same page with little to read
            few = html.escape(" ".join(" ".join(main).split()[: rng.randint(1, 25)]))
            body = rng.choice(["<h1>{0}</h1><p>{0}</p>", "<h1>{0}</h1><p><b>{0}<br>", "<p>{0}</p>", "<h1>{0}</h1>"]).format(few)
            versions.append(_MAIN.sub(lambda m: m[1] + body + m[3], source, count=1))
        for _ in range(RENDERINGS):
            body = main or other
            if rng.random() < 0.45:  # short texts too
                body = body[: rng.randint(1, 2)]
                body = [" ".join(x.split()[: rng.randint(2, 30)]) for x in body]
            versions.append(rendered(body, other, rng))
        for v in versions:
            p = Page(v)
            y = p.labels()
            p.words = [tuple(w for w in ws if w not in ("qstext", "qsnoise")) for ws in p.words]
            x = p.features()
            full = x[:, len(GROUPS) + 4 + 7] > 0  # nodes with text below
            xs.append(x[full])
            ys.append(y[full])
    return np.concatenate(xs), np.concatenate(ys)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Trees | None:
    """Trees fitted on at most TRAIN_PAGES pages; None if there is no page."""
    spark = pages.sparkSession
    sample = pages.filter(F.length(html_col) > 0).orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_PAGES).select(html_col).toArrow()
    sources = sample.column(0).to_pylist()
    if not sources:
        return None
    x, y = training_rows(sources)
    if y.min() == y.max():
        return Trees([[0]], [[np.inf]], [[0]], [[0]], [[1.0 if y.min() else -1.0]])
    rows = pa.table({"x": pa.array(x.tolist(), pa.list_(pa.float64())), "label": pa.array(y)})
    data = spark.createDataFrame(rows).select(array_to_vector("x").alias("features"), "label").coalesce(2)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7, minInstancesPerNode=4, cacheNodeIds=False).fit(data)
    return Trees.of(model)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), trees: Trees | None = None) -> DataFrame:
    """(id_col, *keep, text, n_chars) for each input row.

    text: the kept blocks in page order, one a line, white space inside a block made one space. A null or empty page
    gives an empty text, and so does one without main text. Null and repeated ids and repeated rows each keep
    their row. Very long pages are read whole; a page needs memory in proportion to its own length only.
    """
    ship(df.sparkSession)
    trees = trees or fit(df, id_col, html_col)
    sent = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                pages = [Page(s or "") for s in part.column(part.num_columns - 1).to_pylist()]
                xs = [p.features() for p in pages]
                score = model.score(np.concatenate(xs)) if model else np.zeros(sum(map(len, xs)))
                ends = np.cumsum([len(x) for x in xs])
                texts = [p.text(p.chosen(s)) for p, s in zip(pages, np.split(score, ends[:-1]))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, *keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return df.select(id_col, *keep, html_col).mapInArrow(run, f"{kinds}, text string, n_chars long")
