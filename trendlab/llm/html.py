"""Main text of web pages by sum-product message passing over their DOM trees."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlab.llm.common import slices, small_batches

#: Pages that train the model: those with the smallest hash of page_id.
TRAIN_PAGES = 1000

# Elements by what HTML makes of them.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
UNSEEN = {"script", "style", "head", "title", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button"}
#: Elements that a head holds; any other ends an open head.
HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "head", "html"}
#: An opening tag ends an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that a search for an element to end does not leave.
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "main", "aside", "nav", "footer", "header", "form"}

# Element names and words of class, id and role that name the parts of a page.
CONTENT_NAMES = {"article", "main", "post", "entry", "story", "content", "articlebody"}
OTHER_NAMES = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "aside", "sidebar", "widget", "related",
    "notice", "cookie", "consent", "banner", "alert", "popup", "modal", "newsletter", "subscribe", "ad", "ads", "advert", "advertisement",
    "sponsor", "sponsored", "promo", "promotion", "form", "search", "login", "comment", "comments", "reply", "replies", "disqus", "share",
    "social", "dialog", "complementary", "contentinfo",
}
#: Nodes that each name above counts for in training, besides those of the pages.
PRIOR = 2000
#: Elements around a whole page; their label says little about what they hold.
WHOLE = {"#page", "html", "body"}
#: Bounds of the log odds of a feature: a name or a naming element may decide alone, looks only tip the balance.
SURE, HINT, LOOK = 12.0, 1.0, 0.5
_NAME = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Block elements in page order (parents first), and text by the block that holds it."""

    tags: list[str] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    #: (block, text), a new entry wherever a block begins, ends or goes on
    texts: list[tuple[int, list[str]]] = field(default_factory=list)


class _Builder(HTMLParser):
    """Builds a :class:`Page`; inline elements belong to the block around them, unclosed and stray tags do no harm."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[tuple[str, int]] = []  # open elements and their block
        self.hidden = self.links = 0
        self._block("#page", [])
        self.open.append(("#page", 0))
        self.fresh = True

    def _block(self, tag: str, names: list[str]) -> int:
        page = self.page
        page.tags.append(tag)
        page.names.append(names)
        page.parents.append(self.open[-1][1] if self.open else -1)
        page.chars.append(0)
        page.linked.append(0)
        self.fresh = True
        return len(page.tags) - 1

    def _pop(self) -> None:
        tag, _ = self.open.pop()
        self.hidden -= tag in UNSEEN
        self.links -= tag == "a"
        self.fresh |= tag not in INLINE

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD:
            self._leave_head()
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            self.fresh |= tag == "hr"
            return
        if tag not in INLINE and tag not in UNSEEN and any(t == "p" for t, _ in self.open):
            self._end({"p"})
        if tag in ENDS:
            self._end(ENDS[tag])
        block = self.open[-1][1]
        if tag not in INLINE:
            block = self._block(tag, [w for k, v in attrs if k in ("class", "id", "role") and v for w in _NAME.findall(v.lower())])
        self.open.append((tag, block))
        self.hidden += tag in UNSEEN
        self.links += tag == "a"

    def _leave_head(self) -> None:
        """What a head can't hold ends it: its end tag may be left out."""
        if self.open[-1][0] == "head":
            self._pop()

    def _end(self, tags: set[str]) -> None:
        """Close the innermost open element of ``tags`` with all in it, unless a scope stands between."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in SCOPES:
                return

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open[1:]):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._leave_head()
        if self.hidden:
            return
        page, block = self.page, self.open[-1][1]
        if self.fresh or not page.texts or page.texts[-1][0] != block:
            page.texts.append((block, []))
            self.fresh = False
        page.texts[-1][1].append(data)
        page.chars[block] += len(data)
        page.linked[block] += len(data) * (self.links > 0)


def parse(html: str) -> Page:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.page


def features(page: Page, at: int) -> list[str]:
    chars, linked = page.chars[at], page.linked[at]
    size = "none" if not chars else "few" if chars < 40 else "some" if chars < 200 else "many"
    return [f"tag {page.tags[at]}", f"text {size}", f"links {0 if not chars else 3 * linked // chars}", *(f"name {n}" for n in sorted(set(page.names[at])))]


def weak_labels(page: Page) -> list[bool] | None:
    """Content or not for each block of a page that marks its article; None if it marks none."""
    if not {"article", "main"} & set(page.tags):
        return None
    out: list[bool] = []
    for tag, names, parent in zip(page.tags, page.names, page.parents, strict=True):
        if tag in ("article", "main"):
            out.append(True)
        else:
            out.append(parent >= 0 and out[parent] and tag not in OTHER_NAMES and not OTHER_NAMES & set(names))
    return out


def _apart(page: Page, at: int) -> bool:
    """Whether a block stands in the page itself or has a name of its own, and so may differ from what is around it."""
    named = {page.tags[at], *page.names[at]} & (CONTENT_NAMES | OTHER_NAMES)
    return bool(named) or page.tags[page.parents[at]] in WHOLE


@dataclass(frozen=True)
class Model:
    """Log odds of each feature and log potentials of (parent label, child label)."""

    odds: dict[str, float]
    root: float
    pairs: tuple[tuple[float, float], tuple[float, float]]
    #: the same where a block may well differ from the one around it
    outer: tuple[tuple[float, float], tuple[float, float]]

    @classmethod
    def of(cls, counts: dict[tuple[str, bool], int]) -> Model:
        """Naive Bayes emissions and smoothed transitions from counts, with the fixed names as further counts."""
        seen = Counter(counts)
        for names, label in ((CONTENT_NAMES, True), (OTHER_NAMES, False)):
            for name in names:
                seen[f"tag {name}", label] += PRIOR
                seen[f"name {name}", label] += PRIOR
        odds = {}
        for kind in ("tag", "text", "links", "name"):
            rows = {f for f, _ in seen if f.startswith(f"{kind} ")}
            all_of = {y: sum(seen[f, y] for f in rows) + len(rows) + 1 for y in (False, True)}
            for f in rows:
                named = f.partition(" ")[2] in CONTENT_NAMES | OTHER_NAMES
                bound = SURE if named and kind in ("tag", "name") else HINT if kind == "links" else LOOK
                value = log((seen[f, True] + 1) / all_of[True]) - log((seen[f, False] + 1) / all_of[False])
                odds[f] = max(-bound, min(bound, value))
        # a block mostly goes with the block around it, whatever the pages of the sample show
        seen.update({("pair 00", True): PRIOR, ("pair 11", True): PRIOR})
        log_share = lambda k, a, b: log(seen[f"{k} {a}{b}", True] + 1) - log(seen[f"{k} {a}0", True] + seen[f"{k} {a}1", True] + 2)
        inner, outer = (tuple(tuple(log_share(k, a, b) for b in (0, 1)) for a in (0, 1)) for k in ("pair", "outer"))
        return cls(odds, -4.0, inner, outer)

    def potentials(self, page: Page, at: int) -> tuple[tuple[float, float], tuple[float, float]]:
        """Log potentials of (label of the block around, label of the block)."""
        return self.outer if _apart(page, at) else self.pairs

    def marginals(self, page: Page) -> list[float]:
        """The probability of each block being content: messages go up from the leaves and down from the root."""
        n = len(page.tags)
        own = [sum(self.odds.get(f, 0.0) for f in features(page, k)) for k in range(n)]
        own[0] = self.root
        # log messages as pairs (not content, content)
        inward = [[0.0, v] for v in own]
        up: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for k in range(n - 1, 0, -1):
            pairs = self.potentials(page, k)
            m = tuple(_sum(inward[k][0] + pairs[a][0], inward[k][1] + pairs[a][1]) for a in (0, 1))
            up[k] = m
            parent = inward[page.parents[k]]
            parent[0] += m[0]
            parent[1] += m[1]
        belief = [inward[0]]
        for k in range(1, n):
            above = belief[page.parents[k]]
            rest = (above[0] - up[k][0], above[1] - up[k][1])
            pairs = self.potentials(page, k)
            down = [_sum(rest[0] + pairs[0][b], rest[1] + pairs[1][b]) for b in (0, 1)]
            belief.append([inward[k][0] + down[0], inward[k][1] + down[1]])
        return [1 / (1 + exp(max(-500.0, min(500.0, b[0] - b[1])))) for b in belief]


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + log1p(exp(-abs(a - b)))


def main_text(html: str, model: Model) -> str:
    """Texts of content blocks in page order: white space in a block is one space, blocks are joined by a newline."""
    page = parse(html)
    content = model.marginals(page)
    blocks = (" ".join("".join(parts).split()) for at, parts in page.texts if content[at] > 0.5)
    return "\n".join(b for b in blocks if b)


def train(pages: DataFrame, limit: int = TRAIN_PAGES) -> Model:
    """The model of the ``limit`` pages of smallest hash; pages that mark no article are left out. With no such page
    the fixed names alone decide."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: Counter[tuple[str, bool]] = Counter()
            for html in batch.column(0).to_pylist():
                page = parse(html or "")
                labels = weak_labels(page)
                if labels:
                    for k in range(1, len(labels)):
                        counts.update((f, labels[k]) for f in features(page, k))
                        kind = "outer" if _apart(page, k) else "pair"
                        counts[f"{kind} {int(labels[page.parents[k]])}{int(labels[k])}", True] += 1
            rows = [{"feature": f, "label": y, "n": n} for (f, y), n in counts.items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("feature", pa.string()), ("label", pa.bool_()), ("n", pa.int64())]))

    ids = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(limit)
    chosen = pages.select("page_id", "html").join(F.broadcast(ids), "page_id", "left_semi").select("html")
    counts = small_batches(chosen).mapInArrow(count, "feature string, label boolean, n long").groupBy("feature", "label").agg(F.sum("n").alias("n"))
    return Model.of({(r["feature"], r["label"]): r["n"] for r in counts.collect()})  # bounded by the pages in training


def extract(pages: DataFrame, model: Model | None = None, limit: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row; null and empty html give an empty text.

    Repeated rows come back each, an empty table gives no rows, other columns are not read.
    """
    model = model or train(pages, limit)
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(html.as_py() or "", model) for html in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return small_batches(rows).mapInArrow(run, "page_id long, url string, text string, n_chars long")
