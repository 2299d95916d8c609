"""Main text of web pages: flat text blocks, classified by a small decision tree.

1. *Blocks.*  One pass over the page's tags cuts its text at block-level tags;
   inline tags vanish, comments, scripts, styles and other raw text are skipped.
   No tree of the page is built: a list of the open containers is all the context
   there is (whether one of them is an article, or a menu, footer, form ... by its
   tag, role, class or id).
2. *Features.*  Words and share of linked words of a block and of its two
   neighbours, its context, whether it is a heading.
3. *Classifier.*  A decision tree (Gini impurity), grown in numpy from the labelled
   table below when an operator is called; it is a few dozen numbers and travels
   with the tasks.

Blocks that the tree keeps are joined by an empty line.  White space of any kind
inside a block is one space and character references are decoded.  A page is read
once from front to back, so the work is proportional to its length.

Results for odd input: a null or empty page, and one without any kept block, has an
empty text; unclosed tags, quotes, comments and raw text end with the page; a page is
extracted by itself, so repeated rows and null ids or urls change nothing.  Very
long pages are taken whole.  Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import bounded_batches, filled, text_slices

#: Tags that end a block and, among them, those followed as containers.
CONTAINERS = frozenset("""address article aside body center dialog div dl details fieldset figure footer form header html main menu
    nav ol section select svg table ul button noscript template object video audio canvas math""".split())
BLOCKS = CONTAINERS | frozenset("""blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup hr legend li optgroup option p pre
    summary tbody td tfoot th thead title tr head""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is not markup; it is skipped up to their end tag.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Containers that never hold the article's text, by tag, role, or a word of class or id.
SIDE_TAGS = frozenset("aside button canvas dialog footer form header menu nav noscript object select svg template math".split())
SIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
SIDE_WORDS = frozenset("""ad ads adsense advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments
    consent cookie cookies copyright disclaimer discussion disqus foot footer gdpr header legal login masthead menu modal nav navbar
    navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply
    respond responses search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toc
    toolbar topbar widget widgets""".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article articlebody body content entry main maincontent post story".split())

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "side", "main", "heading")


def _context(name: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """(side, main): what a tag says about its content."""
    side, main = name in SIDE_TAGS, name in MAIN_TAGS
    if name == "header" and inside:
        side = False        # the head of an article holds its title
    if attrs:
        for key, *values in _ATTR.findall(attrs):
            key, value = key.lower(), values[0] or values[1] or values[2]
            if key == "role":
                side |= value.lower() in SIDE_ROLES
                main |= value.lower() in MAIN_TAGS
            elif key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                side = True
            elif key in ("class", "id") and name not in ("html", "body"):
                words = {w.lower() for w in _WORD.findall(value)}
                about = bool(words & MAIN_WORDS)
                said = words & SIDE_WORDS
                if name in MAIN_TAGS:
                    said &= {"comment", "comments", "reply"}
                if about and said <= {"header", "comments"} and (said != {"comments"} or len(words) > 2):
                    said = set()        # an article's own head; a page kind such as "post with comments"
                side |= bool(said)
                main |= about and not said
    return side, main


class Page:
    """Blocks of one page: texts, and per block (words, linked words, side, main, heading)."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.facts: list[tuple[int, int, bool, bool, bool]] = []
        self._parts: list[str] = []
        self._linked: list[str] = []
        self._open: list[tuple[str, bool, bool]] = []       # containers: name, side, main, inherited
        self._names: Counter = Counter()
        self._own = (False, False, False)                    # the block's own tag: side, main, heading
        self._links = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        find = source.find
        while at < end:
            lt = find("<", at)
            if lt < 0:
                self._text(source[at:])
                break
            if lt > at:
                self._text(source[at:lt])
            nxt = source[lt + 1:lt + 2]
            if source.startswith("<!--", lt):
                stop = find("-->", lt + 2)
                at = end if stop < 0 else stop + 3
            elif nxt in ("!", "?") or (nxt == "/" and not source[lt + 2:lt + 3].isalpha()):
                stop = find(">", lt)
                at = end if stop < 0 else stop + 1
            elif nxt == "/" or (nxt.isascii() and nxt.isalpha()):
                tag = _TAG.match(source, lt) or _LOOSE.match(source, lt)
                if tag is None:
                    break
                at = tag.end()
                name = tag.group(1).lower()
                if nxt == "/":
                    self._close(name)
                else:
                    self._start(name, tag.group(2))
                    if name in RAW:
                        done = _RAW_END[name].search(source, at)
                        at = end if done is None else done.start()
            else:
                self._text("<")
                at = lt + 1
        self._flush()

    def _text(self, raw: str) -> None:
        self._parts.append(raw)
        if self._links:
            self._linked.append(raw)

    def _flush(self) -> None:
        if self._parts:
            words = html.unescape("".join(self._parts)).split()
            if words:
                linked = len(html.unescape("".join(self._linked)).split()) if self._linked else 0
                _, side, main = self._open[-1] if self._open else ("", False, False)
                self.texts.append(" ".join(words))
                self.facts.append((len(words), min(linked, len(words)), side or self._own[0], main or self._own[1], self._own[2]))
            self._parts.clear()
            self._linked.clear()

    def _start(self, name: str, attrs: str) -> None:
        if name in BLOCKS:
            self._flush()
            _, side, main = self._open[-1] if self._open else ("", False, False)
            own_side, own_main = _context(name, attrs, main)
            self._own = (False, False, False)
            if name in CONTAINERS:
                if not attrs.endswith("/"):
                    self._open.append((name, side or own_side, main or own_main))
                    self._names[name] += 1
            else:
                self._own = (own_side, own_main, name in HEADINGS)
        elif name == "a":
            self._links = 1
            self._linked.append(" ")
        elif name == "br":
            self._text(" ")

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
            self._own = (False, False, False)
            if self._names[name]:
                while True:
                    last = self._open.pop()[0]
                    self._names[last] -= 1
                    if last == name:
                        break
        elif name == "a":
            self._links = 0

    def features(self) -> np.ndarray:
        n = len(self.facts)
        out = np.zeros((n, len(FEATURES)))
        if n:
            f = np.array(self.facts, dtype=float)
            share = f[:, 1] / f[:, 0]
            out[:, 0], out[:, 1] = f[:, 0], share
            out[1:, 2], out[1:, 3] = f[:-1, 0], share[:-1]
            out[:-1, 4], out[:-1, 5] = f[1:, 0], share[1:]
            out[:, 6:] = f[:, 2:]
        return out


# --- the labelled table -----------------------------------------------------

#: Labelled pages: a block starting with + is main text, with - is not; {n} stands
#: for n words.
LABELLED = (
    # an article element between menu and footer, paragraphs of any length
    "<nav><ul><li><a>-{1}</a></li><li><a>-{1}</a></li><li><a>-{2}</a></li></ul></nav><article><h1>+{8}</h1><p>+{70}</p><p>+{2}</p>"
    "<p>+{35}</p><p>+{1}</p></article><footer>-{9}</footer>",
    "<header><div>-{3}</div></header><div class=ad>-{14}</div><main><h2>+{4}</h2><p>+{22}</p><p>+{3}</p><ul><li>+{6}</li><li>+{9}</li>"
    "</ul><p>+{55}</p></main><aside><h3>-{2}</h3><p>-{30}</p></aside><footer><p>-{40}</p></footer>",
    "<article><h1>+{6}</h1><p>+{1}</p></article><footer><p>-{12}</p></footer>",
    "<div class=ad>-{25}</div><article><p>+{3}</p><p>+<a>{4}</a></p><p>+{5}</p><p>+{80}</p></article>",
    # things inside an article that are not its text
    "<article><h1>+{7}</h1><div class=share>-{3}</div><p>+{60}</p><form><p>-{5}</p></form><p>+{41}</p><aside>-{33}</aside><p>+{9}</p>"
    "<div id=related><h3>-{2}</h3><p>-<a>{6}</a></p><p>-<a>{5}</a></p></div><section class=comments><p>-{45}</p><p>-{28}</p></section>"
    "</article>",
    "<article><h1>+{5}</h1><p>+{30}</p><ul><li>-<a>{3}</a></li><li>-<a>{4}</a></li><li>-<a>{3}</a></li><li>-<a>{4}</a></li></ul></article>",
    "<main><p>+{18}</p><p>+<a>{2}</a>{10}</p><p>+{4}</p><ul><li>-<a>{5}</a></li><li>-<a>{6}</a></li><li>-<a>{2}</a></li></ul></main>",
    "<article><p>+{20}</p><p>+<a>{9}</a></p><p>+{30}</p><p>+<a>{2}</a></p><p>+{14}</p><p>+<a>{5}</a></p><p>+{3}</p></article>",
    # no hints at all: words and links decide
    "<div><a>-{1}</a></div><div><a>-{2}</a></div><div><a>-{1}</a></div><h1>+{6}</h1><div>+{48}</div><div>+{66}</div><div>+{12}</div>"
    "<div>+{39}</div><div>-<a>{3}</a></div><div>-<a>{4}</a></div><div>-{3}</div>",
    "<table><tr><td>-<a>{2}</a></td><td>-<a>{2}</a></td></tr></table><h2>+{5}</h2><p>+{29}</p><p>+{6}</p><p>+{44}</p><p>+{21}</p>"
    "<p>-<a>{2}</a></p><p>-{2}</p>",
    "<div>-{2}</div><div>-{3}</div><div>-<a>{1}</a></div><p>+{90}</p><p>+{17}</p><p>+<a>{3}</a>{25}</p><p>+{110}</p><div>-{4}</div>"
    "<div>-<a>{6}</a></div>",
    "<h1>+{9}</h1><p>+{25}</p><h2>+{3}</h2><p>+{31}</p><h2>+{2}</h2><p>+{27}</p><h3>-{2}</h3><ul><li>-<a>{4}</a></li><li>-<a>{7}</a></li></ul>",
    "<p>-{3}</p><ul><li>-<a>{2}</a></li><li>-<a>{2}</a></li></ul><p>+{33}</p><p>+{15}</p><p>-<a>{12}</a></p><p>-<a>{14}</a></p>",
    # notices, forms, long side texts
    "<div class=cookie><p>-{38}</p></div><div class=menu>-{4}</div><div><p>+{52}</p><p>+{24}</p></div><div id=footer><p>-{60}</p></div>",
    "<form><p>-{20}</p></form><p>+{40}</p><p>+{28}</p><div class=sidebar><p>-{22}</p><p>-{50}</p></div><div class=comment>-{31}</div>",
    "<div class=notice>-{16}</div><article><p>+{12}</p><div class=advert>-{40}</div><p>+{14}</p></article>"
    "<div class=comments><div>-{70}</div><div>-{3}</div></div>",
    "<nav>-{30}</nav><article><h1>+{3}</h1><p>+{200}</p></article><footer>-{100}</footer>",
)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table's blocks."""
    x, y = [], []
    for source in LABELLED:
        source = re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m.group(1))), source)
        page = Page(re.sub(r">([+-])", ">", source))
        marks = [m == "+" for m in re.findall(r">([+-])", source)]
        assert len(marks) == len(page.texts)
        x.append(page.features())
        y.extend(marks)
    return np.concatenate(x), np.array(y)


# --- decision tree ------------------------------------------------------------

class Tree:
    """Binary decision tree grown by Gini impurity; arrays by node number."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.feature: list[int] = []
        self.limit: list[float] = []
        self.below: list[int] = []
        self.above: list[int] = []
        self.share: list[float] = []
        self._grow(x, y, depth)
        self.nodes = tuple(np.array(a) for a in (self.feature, self.limit, self.below, self.above, self.share))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.feature)
        for column in (self.feature, self.limit, self.below, self.above):
            column.append(-1)
        self.share.append(float(y.mean()))
        cut = self._cut(x, y) if depth and 0 < y.sum() < len(y) else None
        if cut is not None:
            self.feature[me], self.limit[me] = cut
            low = x[:, cut[0]] <= cut[1]
            self.below[me] = self._grow(x[low], y[low], depth - 1)
            self.above[me] = self._grow(x[~low], y[~low], depth - 1)
        return me

    @staticmethod
    def _cut(x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        """Feature and limit of least impurity; the first of equal ones."""
        n, best, found = len(y), None, None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            left, right = hits[:-1], hits[-1] - hits[:-1]
            impurity = left * (k - left) / k + right * (n - k - right) / (n - k)
            impurity[v[1:] == v[:-1]] = np.inf
            if n > 1 and np.isfinite(impurity.min()) and (best is None or impurity.min() < best - 1e-12):
                at = int(impurity.argmin())
                best, found = impurity[at], (f, float((v[at] + v[at + 1]) / 2))
        return found

    def keep(self, x: np.ndarray) -> np.ndarray:
        """Whether each row is main text."""
        feature, limit, below, above, share = self.nodes
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(feature[at] >= 0)
            if not len(open_):
                return share[at] >= 0.5
            node = at[open_]
            at[open_] = np.where(x[open_, feature[node]] <= limit[node], below[node], above[node])


def trained() -> Tree:
    return Tree(*labelled())


def main_text(source: str, tree: Tree) -> str:
    page = Page(source)
    return "\n\n".join(t for t, k in zip(page.texts, tree.keep(page.features()), strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            tree: Tree | None = None) -> DataFrame:
    """Per page: id, url, ``text``, ``n_chars`` (code points of the text)."""
    bounded_batches(pages.sparkSession)
    tree = tree or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = filled(batch.column(2))
            for lo, hi, _, _ in text_slices(source):
                texts = [main_text(s, tree) for s in source.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                                                  pa.array(texts, pa.string())], names=["id", "url", "text"])
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "id long, url string, text string").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """One row per text block: id, place in the page, text, features, ``kept``."""
    bounded_batches(pages.sparkSession)
    tree = tree or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = filled(batch.column(1))
            for lo, hi, _, _ in text_slices(source):
                found = [Page(s) for s in source.slice(lo, hi - lo).to_pylist()]
                sizes = [len(p.texts) for p in found]
                x = np.concatenate([p.features() for p in found])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), sizes))),
                    pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int32()),
                    pa.array([t for p in found for t in p.texts], pa.string()),
                    *[pa.array(x[:, i], pa.float64()) for i in range(len(FEATURES))], pa.array(tree.keep(x), pa.bool_())],
                    names=["id", "place", "text", *FEATURES, "kept"])
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    columns = ", ".join(f"{f} double" for f in FEATURES)
    return src.mapInArrow(run, f"id long, place int, text string, {columns}, kept boolean").withColumnRenamed("id", id_col)
