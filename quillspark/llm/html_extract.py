"""Main text of web pages: the best-scoring stretch of words and tags.

A page is read as a sequence of words and tags. Words score by where they stand (in an article, outside of one, in a link,
in an element whose class marks it as no part of the text), tags score below zero; the weights are log ratios counted on
labelled pages, those that mark their article themselves. One linear scan finds the contiguous stretch of largest sum; its
blocks, without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, are the
text. What an element is, is decided on the parsed page with its word counts, never by a search in the raw html:

- An article or main element counts if it has words of its own outside menus and marked elements. Where the paragraphs
  outside hold more words than all articles together (a teaser, comments that are articles), no article counts.
- A class, id or role marks its element if one whole token consists of the names of such parts and of plain layout words
  alone: "comment-list" does, "comment-less" and "has-sidebar" don't. An element that holds an article or most of the
  page's words isn't set apart, but for reader comments; nor is such a form.
- If nothing scores above zero that way, the page is scored again without the marks.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: Most labelled pages that the weights are counted on, each as a whole.
SAMPLE = 300

# Element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER = frozenset("head script style title noscript template iframe svg math canvas object audio video nav footer aside button select option textarea dialog menu".split())
ARTICLE = frozenset("article main".split())
UNMARKED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Words in a class, id or role for parts that are no article text, those for reader comments, and words that say only where a part stands.
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
APART = COMMENTS | frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar banner cookie cookies consent gdpr notice notices alert alerts disclaimer related recommended recommendations share sharing social subscribe subscription newsletter signup login popup modal overlay widget widgets pagination pager toolbar complementary contentinfo search".split())
LAYOUT = frozenset("site page global top bottom left right side main primary secondary inner outer wrapper wrap container box block bar list lists item items section sections area panel body content holder row rows column columns group slot unit link links button buttons form zone module region card cards posts articles stories thread feed text title heading label inline fixed sticky mobile desktop small large wide full icons".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(>|\Z)|[^<]+|<", re.DOTALL)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)")
_MARKED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def marks_of(attributes: str) -> tuple[bool, bool]:
    """(marked as apart, marked as reader comments) by a whole token of class, id or role."""
    marked = comments = False
    for m in _MARKED.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            parts = {x.lower() for x in _PART.findall(token)}
            parts = {x for x in parts if len(x) > 1}
            if parts & APART and parts <= APART | LAYOUT:
                marked = True
                comments |= bool(parts & COMMENTS)
    return marked, comments


class Page:
    """A parsed page: items in order, (kind, value, element), and for every element its parent, name and word counts.

    kind: "text", "tag" or "break"; pieces of text between two breaks are one block. Reading is linear in the page's
    length whatever its markup: an end tag that no open element has is passed over, others close up to theirs.
    """

    def __init__(self, page: str):
        self.items: list[tuple[str, str, int]] = []
        self.parent, self.name, self.marked, self.comments = [0], [""], [False], [False]
        self.link, self.p = [False], [False]
        self._read(page)

    def _open(self, name: str, above: int, attributes: str) -> int:
        marked, comments = marks_of(attributes) if attributes and name not in UNMARKED else (False, False)
        self.parent.append(above)
        self.name.append(name)
        self.marked.append(marked)
        self.comments.append(comments)
        self.link.append(self.link[above] or name == "a")
        self.p.append(self.p[above] or name == "p")
        return len(self.name) - 1

    def _read(self, page: str) -> None:
        items = self.items
        stack, blocks = [0], [0]  # open elements, and how many of those up to each are no inline ones
        held: Counter = Counter()
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.match(page, at)
            if m[0] == "<":  # a stray quote inside a tag
                m = _LOOSE.match(page, at) or m
            at = m.end()
            name = m[2]
            if name is None:
                if m[0][0] != "<" or len(m[0]) == 1:
                    items.append(("text", m[0], stack[-1]))
                continue
            if not m[4]:  # the page ends inside this tag
                break
            name = name.lower()
            if name not in INLINE:
                items.append(("break", "", stack[-1]))
            if m[1]:
                items.append(("tag", name, stack[-1]))
                if held[name]:
                    self._close(stack, blocks, held, name)
                continue
            if held["p"] and name in CLOSES_P and self._only_inline_since_p(stack, blocks):
                self._close(stack, blocks, held, "p")
            items.append(("tag", name, stack[-1]))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(page, at)
                at = end.start() if end else n
                if end:
                    at = page.find(">", at) + 1 or n
                items.append(("break", "", stack[-1]))
            elif name not in VOID and not m[3].endswith("/") and not (name == "a" and held["a"]):
                stack.append(self._open(name, stack[-1], m[3]))
                blocks.append(blocks[-1] + (name not in INLINE))
                held[name] += 1
                if name == "p":
                    self._p_at = len(stack) - 1

    def _only_inline_since_p(self, stack: list[int], blocks: list[int]) -> bool:
        at = self._p_at
        return at < len(stack) and self.name[stack[at]] == "p" and blocks[-1] == blocks[at]

    def _close(self, stack: list[int], blocks: list[int], held: Counter, name: str) -> None:
        while True:
            gone = self.name[stack.pop()]
            blocks.pop()
            held[gone] -= 1
            if gone == name:
                return

    def kinds(self, marks: bool = True) -> list[str]:
        """For every element where its own words stand: "in" an article, "out" of it, "free" on a page where none counts,
        "apart", or "within" if it is apart inside an article. Without marks, classes and forms set nothing apart."""
        n = len(self.name)
        never = [False] * n  # by name; a header outside of articles too
        inside = [False] * n
        in_marked = [False] * n
        for e in range(1, n):
            up = self.parent[e]
            inside[e] = inside[up] or self.name[e] in ARTICLE
            never[e] = never[up] or self.name[e] in NEVER or (self.name[e] == "header" and not inside[up])
            in_marked[e] = in_marked[up] or (marks and self.marked[e])
        words, in_p, of_article = [0] * n, [0] * n, [0] * n
        for kind, value, e in self.items:
            if kind == "text" and not never[e]:
                k = len(value.split())
                words[e] += k
                in_p[e] += k * (self.p[e] and not self.link[e] and not inside[e] and not in_marked[e])
                of_article[e] += k * (inside[e] and not in_marked[e])
        for e in range(n - 1, 0, -1):
            for count in (words, in_p, of_article):
                count[self.parent[e]] += count[e]
        # words of the articles below an element: of those outside marked elements, or of any where there are no others
        own = of_article if of_article[0] else words
        holds = [0] * n
        for e in range(n - 1, 0, -1):
            below = own[e] if self.name[e] in ARTICLE and not never[e] else 0
            holds[self.parent[e]] = max(holds[self.parent[e]], holds[e], below)
        apart = [False] * n
        for e in range(1, n):
            kept = (holds[e] > 0 or 2 * words[e] > words[0]) and not self.comments[e]
            set_off = marks and (self.marked[e] or self.name[e] == "form") and not kept and not (inside[self.parent[e]] and self._only_header(e))
            apart[e] = apart[self.parent[e]] or never[e] or set_off
        inner = sum(len(v.split()) for k, v, e in self.items if k == "text" and inside[e] and not apart[e])
        counts = inner > 0 and in_p[0] <= inner
        out = []
        for e in range(n):
            article = counts and inside[e]
            out.append(("within" if article else "apart") if apart[e] else "in" if article else "out" if counts else "free")
        return out

    def _only_header(self, e: int) -> bool:
        """In an article a header has its title."""
        return self.name[e] == "header"


def count(text: str) -> Counter:
    """How many words and tags of each class stand inside and outside the page's article."""
    page = Page(text)
    kinds = page.kinds()
    seen: Counter = Counter()
    for what, value, e in page.items:
        kind = kinds[e]
        if what == "tag" and kind != "free":
            seen[("tag:" + value, kind in ("in", "within"))] += 1
        elif what == "text" and kind != "free":
            n = len(value.split())
            seen[("link" if page.link[e] else "word", kind == "in")] += n if kind in ("in", "out", "apart") else 0
            seen[("aside", kind == "within")] += n if kind in ("within", "apart") else 0
            seen[("out", False)] += n if kind == "out" else 0
    return seen


class Weights:
    """Scores of words and tags: log ratios of their shares inside and outside of articles on labelled pages, held to a
    range for each kind; what was never seen gets what equal counts give."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        total = {side: sum(v for (_, s), v in counts.items() if s == side) + 1 for side in (True, False)}

        def ratio(names: list[str]) -> float:
            inside, outside = (sum(counts.get((c, side), 0) for c in names) + 1 for side in (True, False))
            return math.log(inside / total[True] * total[False] / outside)

        tags = sorted({c for c, _ in counts if c.startswith("tag:")})
        self.word = max(0.5, min(3.0, ratio(["word"])))
        self.link = min(0.2, ratio(["link"]))
        self.outside = max(-2.0, min(-0.5, ratio(["out"])))
        self.aside = max(-0.5, min(-0.1, ratio(["aside"])))
        self.inner = max(-0.2, min(-0.02, ratio(tags)))
        self.tag = {t[4:]: max(-3.0, min(-0.1, ratio([t]))) for t in tags}

    def score(self, what: str, value: str, kind: str, link: bool) -> float:
        if what == "break" or kind == "within":
            return 0.0
        if what == "tag":
            return self.inner if kind == "in" else self.tag.get(value, -0.3)
        n = len(value.split())
        if kind in ("out", "apart"):
            return n * (self.outside if kind == "out" else self.aside)
        return n * (self.word if kind == "in" or not link else self.link)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """(first, stop) of the contiguous stretch of largest sum, (0, 0) if none is above zero; the first such one."""
    best, best_from, best_to, run, start = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, best_from, best_to = run, start, i + 1
    return best_from, best_to


def main_text(text: str, weights: Weights) -> str:
    """The blocks of the best stretch, white space made single, joined by a space."""
    page = Page(text)
    for marks in (True, False):
        kinds = page.kinds(marks)
        first, stop = best_stretch([weights.score(what, value, kinds[e], page.link[e]) for what, value, e in page.items])
        if stop:
            break
    blocks: list[str] = []
    now: list[str] = []
    for what, value, e in page.items[first:stop]:
        if what == "text" and kinds[e] in ("in", "free", "out"):
            now.append(value)
        elif what == "break" or what == "text":
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Weights:
    """Weights from the SAMPLE pages of least md5 of the id that mark an article; defaults where there are none.

    The bound on the labelled pages is the only one; each is counted as a whole.
    """
    marked = pages.filter(F.col(html_col).rlike(r"(?i)<(article|main)[\s>/]")).select(F.col(id_col).alias("_id"), F.col(html_col).alias("_h"))
    rows = marked.orderBy(F.md5(F.coalesce(F.col("_id").cast("string"), F.lit(""))), "_id").limit(SAMPLE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for page in batch.column(0).to_pylist():
                seen.update(count(page))
            keys = list(seen)
            yield pa.RecordBatch.from_pydict({"c": pa.array([k[0] for k in keys], pa.string()), "inside": pa.array([k[1] for k in keys], pa.bool_()), "n": pa.array([seen[k] for k in keys], pa.int64())})

    counts = rows.select("_h").mapInArrow(work, "c string, inside boolean, n long").groupBy("c", "inside").agg(F.sum("n").alias("n"))
    return Weights({(r["c"], r["inside"]): r["n"] for r in counts.collect()})


def extract(pages: DataFrame, weights: Weights, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages without html_col, and the main text of the whole page in text_col (one that is there is replaced).

    Null and empty pages, and pages without text outside menus and the like, have the empty text. Broken markup is read
    as far as it goes: unclosed elements end with the page, end tags without an element are passed over, a page that ends
    inside a tag ends before it. Very long pages take time in proportion to their length. Repeated rows each get their
    result; of two equally good stretches the first is taken; an empty table gives no rows; other columns pass as they are.
    """
    names = [c for c in pages.columns if c not in (html_col, text_col)]
    schema = T.StructType([*[pages.schema[c] for c in names], T.StructField(text_col, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                at = {c: i for i, c in enumerate(part.schema.names)}
                out = pa.array([main_text(x or "", weights) for x in part.column(at[html_col]).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(at[c]) for c in names], out], [*names, text_col])

    return bounded_batches(pages).mapInArrow(work, schema)
