"""Main text of web pages by the maximum-scoring contiguous run of page tokens.

A page is a sequence of tags and text runs. Words score positive and tags negative, with weights
learned from labelled pages, those whose own article or main element marks the content: how much more
often a tag, or a word under a kind of element, is found inside the content than outside. One linear
scan finds the contiguous run with the largest sum, and its text is the result, but for side elements:
those that HTML itself sets apart (navigation, forms, scripts, hidden parts and the like), those whose
class, id or role was found outside the content on labelled pages, and menus, adverts, notices and
reader comments that say so.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>\"']|[\"'])*?)(?:>|\Z)|[^<]+|<+(?=<)|<", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?![\w-]))""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "select", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img"}
#: Elements that HTML defines as no part of the content around them; header only outside of content.
SIDE = {"head", "nav", "footer", "aside", "form", "menu", "button", "dialog", "fieldset"} | RAW
SIDE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}
CONTENT = {"article", "main"}
CLOSED_BY_OWN = {"p", "li", "td", "tr", "dt", "dd", "option"}
#: What is no main text by its name, as a whole name or as its head noun ("cookie-notice").
SIDE_NOUN = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "footer", "menu", "nav", "navbar", "navigation", "notice", "notices", "sidebar"}
HOLDER = {"area", "block", "body", "box", "container", "content", "inner", "item", "list", "section", "slot", "text", "unit", "wrapper"}
#: Scores without labelled pages; words and tags of side elements, which only stand between.
WORD, TEXT_TAG, OTHER_TAG, BETWEEN = 1.0, -0.2, -1.0, -0.1
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "td", "th", "tr", "table", "tbody", "figure", "figcaption", "article", "main", "section"} | INLINE
#: A name is a side element's if its words are so much more often (log ratio) outside the content.
OUTSIDE = -2.0


def names_of(attributes: str) -> tuple[list[str], bool]:
    """Names that an element's class, id and role give, and whether it is hidden or of a side role."""
    names: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or kind == "aria-hidden" and value == "true":
            return names, True
        if kind == "style":
            if "display:none" in value.replace(" ", ""):
                return names, True
        elif kind == "role" and value in SIDE_ROLE:
            return names, True
        elif kind != "aria-hidden":
            names += value.split()
    return names, False


def side_noun(name: str) -> bool:
    parts = re.split(r"[-_]+", name)
    while len(parts) > 1 and parts[-1] in HOLDER:
        parts.pop()
    return parts[-1] in SIDE_NOUN


def text_size(text: str) -> int:
    """Words, or as many as its length makes likely where words are not spaced."""
    return max(len(text.split()), len(text.strip()) // 6)


class Labels:
    """What labelled pages tell: key -> [times inside the content, times outside]."""

    def __init__(self):
        self.seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def add(self, key: str, inside: int, outside: int) -> None:
        at = self.seen[key]
        at[0] += inside
        at[1] += outside


def weights_of(seen: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights from times inside and outside: log ratios; words are kept above 0.1, tags below -0.1."""
    out = {}
    for key, (inside, outside) in seen.items():
        ratio = math.log((inside + 1) / (outside + 1))
        if key.startswith("word in "):
            out[key] = min(1.0, max(0.1, 0.5 + ratio / 4))
        elif key.startswith("named "):
            out[key] = ratio
        else:
            out[key] = max(-6.0, min(-0.1, ratio - 0.5))
    return out


class Page:
    """One walk over a page, linear in its length: items, their scores and the best run of them."""

    def __init__(self, page: str, weights: dict[str, float], labels: Labels | None = None):
        self.weights, self.labels = weights, labels
        self.texts: list[tuple[str | None, bool]] = []  # (text or None, new block?)
        self.scores: list[float] = []
        self.start = self.end = 0  # items of the best run
        self.content = 0  # content elements
        #: open elements: (name, side, in content, nearest block, side by its tag, names, inside, outside)
        self.stack: list[tuple[str, bool, bool, str, bool, tuple[str, ...], int, int]] = []
        self.open: dict[str, int] = defaultdict(int)
        self.inside = self.outside = 0  # words so far
        self.walk(page)
        while self.stack:
            self.pop()
        self.scan()

    def is_side(self, name: str, attributes: str, in_content: bool) -> tuple[bool, bool, tuple[str, ...]]:
        """(side?, by its tag?, names)"""
        if name in SIDE or name == "header" and not in_content:
            return True, True, ()
        if not attributes or name in ("html", "body"):
            return False, False, ()
        names, hidden = names_of(attributes)
        get = self.weights.get
        return hidden or any(side_noun(x) or get(f"named {x}", 0.0) < OUTSIDE for x in names), False, tuple(names)

    def pop(self) -> str:
        name, _, _, _, _, names, inside, outside = self.stack.pop()
        self.open[name] -= 1
        if self.labels and names:
            for x in {*names}:
                self.labels.add(f"named {x}", self.inside - inside, self.outside - outside)
        return name

    def put(self, key: str, n: int, text: str | None, block: bool, side: bool, content: bool, default: float) -> None:
        self.texts.append((None if side else text, block))
        self.scores.append(BETWEEN * n if side else n * self.weights.get(key, default))
        if self.labels and n and not side:
            self.labels.add(key, n * content, n * (not content))

    def walk(self, page: str) -> None:
        at, n, match, stack = 0, len(page), TOKEN.match, self.stack
        while at < n:
            m = match(page, at)
            at = m.end()
            name = m[2]
            if not name:
                if m[0][:2] not in ("<!", "<?"):
                    self.text(m[0])
                continue
            if m[0][-1] != ">":
                return  # the page ends inside a tag
            name = name.lower()
            if m[1]:
                self.close(name)
                continue
            self.element(name, m[3])
            if name in RAW and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>?", re.I).search(page, at)
                at = end.end() if end else n
                self.close(name)

    def text(self, text: str) -> None:
        _, side, content, where, *_ = self.stack[-1] if self.stack else ("", False, False, "")
        if text.isspace():
            self.texts.append((None if side else text, False))
            self.scores.append(0.0)
            return
        text = html.unescape(text)
        n = text_size(text)
        if content and not side:
            self.inside += n
        else:
            self.outside += n
        self.put(f"word in {where}", n, text, False, side, content, WORD)

    def element(self, name: str, attributes: str) -> None:
        stack = self.stack
        _, side, content, where, by_tag, *_ = stack[-1] if stack else ("", False, False, "", False)
        own, own_tag, names = self.is_side(name, attributes, content)
        if name in CONTENT and not own:
            self.content += 1
            content = True
            side = side and not by_tag  # it ends a side element left open before it
        inline = name in INLINE
        if name not in VOID:
            if name in CLOSED_BY_OWN and stack and stack[-1][0] == name:
                self.pop()
            stack.append((name, side or own, content, where if inline else name, by_tag if side else own_tag, names, self.inside, self.outside))
            self.open[name] += 1
        self.put(name, 1, " " if name == "br" else None, not inline, side or own, content, TEXT_TAG if name in TEXT_TAGS else OTHER_TAG)

    def close(self, name: str) -> None:
        _, side, content, *_ = self.stack[-1] if self.stack else ("", False, False)
        if self.open.get(name):
            while self.stack[-1][0] != name:
                self.pop()
            _, side, content, *_ = self.stack[-1]
            self.pop()
        self.put(f"/{name}", 1, None, name not in INLINE, side, content, TEXT_TAG if name in TEXT_TAGS else OTHER_TAG)

    def scan(self) -> None:
        """The contiguous run of items with the largest sum, in one pass; of equal ones the first."""
        best, total, began = 0.0, 0.0, 0
        for i, s in enumerate(self.scores):
            if total <= 0:
                total, began = 0.0, i
            total += s
            if total > best:
                best, self.start, self.end = total, began, i + 1

    def main_text(self) -> str:
        blocks: list[list[str]] = [[]]
        for text, block in self.texts[self.start : self.end]:
            if block:
                blocks.append([])
            if text is not None:
                blocks[-1].append(text)
        return "\n".join(b for x in blocks if (b := " ".join("".join(x).split())))


def labelled(page: str) -> dict[str, list[int]]:
    """What one page tells, if its own article or main element marks its content."""
    labels = Labels()
    return dict(labels.seen) if Page(page, {}, labels).content else {}


def extract_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds text (main text, empty if none) and n_chars (its code points) to pages with an html column.

    Null and empty html give empty text; broken and cut pages are read as far as they go, very long ones
    in time linear in their length. Rows and other columns stay, repeated rows too; columns named text
    and n_chars are replaced. An empty table gives no rows. Of runs with equal sums the first is taken.
    """

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([Page(x, weights).main_text() if x else "" for x in batch], dtype=object)

    return pages.withColumn("text", main_text(F.col("html"))).withColumn("n_chars", F.length("text").cast("long"))


#: Labelled pages that weights are learned from, at most, and keys of weights.
LABELLED, KEYS = 200, 20_000


def learn_weights(pages: DataFrame, n: int = LABELLED) -> dict[str, float]:
    """Weights from n labelled pages, drawn from all labelled pages by a hash of page_id and url.

    A bounded sample: n hashes and then at most KEYS counts reach the driver, the most frequent ones.
    Without labelled pages the result is empty, and fixed scores hold.
    """
    marked = pages.filter(F.col("html").rlike("(?i)<(article|main)[ >]")).select(F.xxhash64("page_id", "url").alias("h"), "html")
    first = [r["h"] for r in marked.select("h").distinct().orderBy("h").limit(n).collect()]
    chosen = marked.filter(F.col("h").isin(first)).groupBy("h").agg(F.min("html").alias("html"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *at) for x in batch["html"] for key, at in labelled(x).items()]
            yield pd.DataFrame(rows, columns=["key", "inside", "outside"])

    told = chosen.select("html").mapInPandas(count, "key string, inside long, outside long")
    told = told.groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    got = told.orderBy(F.desc(F.col("inside") + F.col("outside")), "key").limit(KEYS).collect()
    return weights_of({r["key"]: (r["inside"], r["outside"]) for r in got})


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract_text(pages, learn_weights(pages)).select("page_id", "url", "text", "n_chars")
