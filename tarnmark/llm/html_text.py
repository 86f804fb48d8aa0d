"""Main text of HTML pages by composite text density.

Every DOM node gets its characters per tag, adjusted by the share of link
characters and link tags below it:

    density = C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LCb / Cb * C + e)

(C characters, T tags, LC and LT those of links, Cb and LCb of the body; a zero
denominator counts as one). A node's density sum is the sum of its child elements' densities. The subtree
with the largest sum is the text; the least density on its path to the body is a
threshold, and it takes in its neighbours along that path that reach it, and all
of the nearest article or main element around it; an article inside it never
stands for the whole.

What is never part of an article by its element, ARIA role or visibility (menus,
forms, scripts and so on) is cut before densities are computed; so is an element
whose class or id is, as a whole word or with words of place and shape only, one
of MARKS (adverts, notices, reader comments); inside an article, words that its
own sections bear too (a discussion, a notice) say nothing. What follows an
article beside it is cut if it is mostly links, or a list of like records each
shorter than half the article, as comments are under any class. Nothing of this
holds for an element that encloses an article, nor for a form around more than
half of the page; buttons and labels inside a sentence are text; and if nothing
would be left, classes count for nothing.

Defined results: null or empty html, and pages without text, give an empty
text; broken markup is read to the end, an odd declaration as a comment; equal
sums go to the first node in page order; repeated rows are extracted each; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.llm.common import per_batch

#: Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul caption option".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "body", "html"}
NEVER_TEXT = set(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input label math menu nav noscript "
    "object option script select style svg template textarea title video".split()
)
#: Within these, buttons and labels are words of a sentence.
SENTENCES = set("p li dd td th blockquote h1 h2 h3 h4 h5 h6 figcaption".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Class or id words of what surrounds an article, and words that may stand beside them.
MARKS = set(
    "ad ads advert adverts advertisement adsense adbox banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright discussion disqus footer gdpr header login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promotion recommended related reply replies respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
BESIDE = set(
    "area bar block bottom box buttons container content footer form global group header inner item items left links list main "
    "outer page posts primary reader readers right row secondary section site slot stories thread top unit user wrap wrapper".split()
)
#: Of these words, the ones that name nothing inside an article, where sections and paragraphs bear them as well.
OF_SECTIONS = set("banner copyright discussion footer header login masthead menu menubar nav navigation notice notices notification popup reply replies".split())
#: Records behind an article that are comments: so many of one shape at least, each at most this part of the article.
RECORDS, RECORD_PART = 3, 2
_PARTS = re.compile(r"[a-z]+")
_SIBLINGS = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
    "option": ("select", "datalist"),
}
_SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}


class _Tree(HTMLParser):
    """Nodes in page order as parallel lists; text stays with the node that has it directly."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.cut, self.marked, self.items = ["html"], [-1], [False], [False], []
        self.shapes = [("html", "")]  # name and class
        self.open, self.depth = [0], Counter()  # open nodes, and how many of them have a name

    def _close(self, depth: int) -> None:
        self.depth.subtract(self.tags[n] for n in self.open[depth:])
        del self.open[depth:]

    def _pop_to(self, names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        if not any(self.depth[n] for n in names):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[depth]]
            if tag in names:
                self._close(depth)
                return
            if tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._pop_to(("p",), ("table", "button", "object"))
        if tag in _SIBLINGS:
            self._pop_to(_SAME.get(tag, (tag,)), _SIBLINGS[tag])
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.shapes.append((tag, next((v or "" for n, v in attrs if n == "class"), "")))
        self.cut.append(self._is_cut(tag, attrs))
        self.marked.append(self._is_marked(tag, attrs))
        self.items.append((node, None))
        if tag not in VOID:
            self.open.append(node)
            self.depth[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.depth[tag]:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[depth]] == tag:
                self.items.append((self.open[depth], None))
                self._close(depth)
                return

    def handle_data(self, data: str) -> None:
        self.items.append((self.open[-1], data))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A '<![...' is a comment up to its '>', as in browsers."""
        return self.rawdata.find(">", i + 3) + 1 or -1

    def _in_article(self) -> bool:
        return self.depth["article"] + self.depth["main"] > 0

    def _is_cut(self, tag: str, attrs: list) -> bool:
        if tag in NEVER_TEXT:
            return tag not in ("button", "label") or not any(self.depth[x] for x in SENTENCES)
        if tag == "header" and not self._in_article():
            return True
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value and value.lower() in ROLES):
                return True
            if name == "style" and value and "display:none" in value.lower().replace(" ", ""):
                return True
        return False

    def _is_marked(self, tag: str, attrs: list) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        for name, value in attrs:
            if value and name in ("class", "id"):
                for word in value.lower().split():
                    parts = set(_PARTS.findall(word))
                    marks = parts & MARKS
                    if marks and parts <= MARKS | BESIDE and not (self._in_article() and marks <= OF_SECTIONS):
                        return True
        return False


def _density(c: int, t: int, lc: int, lt: int, body_c: int, body_lc: int) -> float:
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + body_lc / max(1, body_c) * c + math.e)
    inner = c / max(1, lc) * t / max(1, lt)
    return c / max(1, t) * (math.log(inner) / math.log(base) if base > 1 and inner > 1 else 0.0 if inner <= 1 else math.log(inner))


def _behind_articles(tree: _Tree, held: list[int], encloses: list[bool]) -> list[int]:
    """Elements that follow an article beside it and hold comments, or little but links.

    Comments are known by their structure: records of one name and class, not bare
    paragraphs, that are most of the element, each much shorter than the article.
    """
    tags, parents, n = tree.tags, tree.parents, len(tree.tags)
    linked, children, beside = [0] * n, [[] for _ in range(n)], {}
    in_link = [False] * n
    for i in range(1, n):
        children[parents[i]].append(i)
        in_link[i] = in_link[parents[i]] or tags[i] == "a"
    for i, text in tree.items:
        if text and in_link[i]:
            linked[i] += len(text.strip())
    for i in range(n - 1, 0, -1):
        linked[parents[i]] += linked[i]

    def records(i: int, article: int) -> bool:
        while i is not None:  # down through wrappers of most of it
            shapes: dict[tuple, list[int]] = {}
            for c in children[i]:
                if held[c] and tags[c] != "p":
                    shapes.setdefault(tree.shapes[c], []).append(held[c])
            if any(len(x) >= RECORDS and 2 * sum(x) >= held[i] and RECORD_PART * max(x) <= article for x in shapes.values()):
                return True
            whole = [c for c in children[i] if 2 * held[c] >= held[i]]
            i = whole[0] if len(whole) == 1 and len(children[i]) < 4 else None
        return False

    out = []
    for i in range(1, n):
        p = parents[i]
        if tags[i] == "article" or encloses[i]:
            beside[p] = max(beside.get(p, 0), held[i])
        elif p in beside and held[i] and tags[i] in BLOCKS and tags[i] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            if 2 * linked[i] >= held[i] or records(i, beside[p]):
                out.append(i)
    return out


def main_text(html: str | None) -> str:
    """The article of a page, one line for each block."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tags, parents, n = tree.tags, tree.parents, len(tree.tags)

    encloses, held = [False] * n, [0] * n  # an article or main element; characters
    for i, text in tree.items:
        if text and tags[i] not in ("script", "style"):
            held[i] += len(text.strip())
    for i in range(n - 1, 0, -1):
        held[parents[i]] += held[i]
        if tags[i] in ("article", "main") or encloses[i]:
            encloses[parents[i]] = True

    def cut_by(classes: bool) -> list[bool]:
        out = [False] * n
        for i in range(1, n):
            own = tree.cut[i] and not (tags[i] == "form" and 2 * held[i] > held[0])
            out[i] = out[parents[i]] or ((own or (classes and tree.marked[i])) and not encloses[i])
        return out

    for i in _behind_articles(tree, held, encloses):
        tree.cut[i] = True
    cut = cut_by(True)
    if not any(text and not cut[i] and not text.isspace() for i, text in tree.items):
        cut = cut_by(False)

    chars, link_chars, count, links, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parents[i]] or tags[i] == "a"
    for i, text in tree.items:
        if text and not cut[i]:
            size = len(text.strip())
            chars[i] += size
            link_chars[i] += size if in_link[i] else 0
    for i in range(n - 1, 0, -1):
        if not cut[i]:
            p = parents[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            count[p] += count[i] + 1
            links[p] += links[i] + (tags[i] == "a")
    body = next((i for i in range(n) if tags[i] == "body"), 0)
    if not chars[body]:
        body = 0
    density = [_density(chars[i], count[i], link_chars[i], links[i], chars[body], link_chars[body]) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        if not cut[i]:
            sums[parents[i]] += density[i]
    inside = [i == body for i in range(n)]
    for i in range(body + 1, n):
        inside[i] = inside[parents[i]]
    best = max((i for i in range(n) if inside[i] and not cut[i]), key=lambda i: (sums[i], -i), default=body)

    path = [best]
    while path[-1] != body and path[-1] > 0:
        path.append(parents[path[-1]])
    threshold = min(density[i] for i in path)
    below = [False] * n
    for i in range(best, n):
        below[i] = i == best or below[parents[i]]
    on_path = set(path)
    roots = {best} | {
        i for i in range(1, n) if parents[i] in on_path and i not in on_path and tags[i] in BLOCKS and density[i] >= threshold > 0 and not below[i]
    }
    roots.update([i for i in path if tags[i] in ("article", "main")][:1])  # only adds text
    kept = [False] * n
    for i in range(n):
        kept[i] = not cut[i] and (i in roots or (i > 0 and kept[parents[i]]))
    if not any(kept):
        return ""

    lines, now = [], []
    for i, text in tree.items:
        if text is None:
            if tags[i] in BLOCKS:
                lines.append("".join(now))
                now = []
            elif tags[i] == "br":
                now.append(" ")
        elif kept[i]:
            now.append(text)
    lines.append("".join(now))
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

        return step

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(per_batch(make), "page_id long, url string, text string, n_chars long")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1: all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
