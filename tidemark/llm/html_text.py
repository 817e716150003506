"""Main text of web pages: the maximum-scoring run of tokens, words positive and tags negative."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, with_text_columns

# Fixed values of HTML: elements by kind.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul video audio".split())
#: Elements that HTML itself sets apart from an article's text, the landmark roles that stand for them, and those that hold an article.
ASIDE = frozenset("nav aside form footer header menu button dialog".split())
ROLES = {"navigation": "nav", "complementary": "aside", "search": "form", "form": "form", "contentinfo": "footer", "banner": "header", "dialog": "dialog"}
CONTENT = frozenset(("article", "main"))
#: List items and table parts that end at the next one: by tag, what it ends. Blocks that don't keep a list item from ending.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
CELLS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}
UNBOUND = frozenset("address div p".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: Tags that have weights of their own; all others share one.
KNOWN = frozenset(BLOCK | VOID | CONTENT | frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var".split()))
OTHER, WORDS, CUT = "other", "#word", "#cut"
#: An element that lies outside the content with this chance is left out with all that it holds.
OUTSIDE = 0.8
#: What is known before any page is seen, as uses outside the content (of so many).
BEFORE = (0.1, 2.0)
#: Classes on fewer of the labelled pages have no weight, so at most the classes of 10,000 pages have one.
LEAST_SHARE = 1e-4


def marks(tag: str, attrs: str, within: bool) -> tuple[str, ...]:
    """What an element is known by: its classes and id as ``.name``, or else its tag; elements set apart (by tag or role) and hidden ones always.

    A header within an article or a main element, is the article's own, and known as any other tag is.
    """
    out, own = [], None
    for m in ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            out += [f".{c.lower()}" for c in value.split()]
        elif name == "role":
            own = ROLES.get(value.lower(), own)
        elif name == "hidden":
            out.append("#hidden")
    own = own or (tag if tag in ASIDE else None)
    if own and not (own == "header" and within):
        out.append(f"#{own}")
    return tuple(out) or (tag if tag in KNOWN else OTHER,)


@dataclass
class Weights:
    """The chance of each mark to lie outside the content; ``strength``: what a tag that always does costs, in words."""

    outside: dict[str, float]
    strength: float = 40.0

    def chance(self, mark: str) -> float:
        found = self.outside.get(mark)
        return found if found is not None else share_outside(mark, 0, 0)

    def cost(self, found: tuple[str, ...]) -> float:
        """What the element's tags cost: next to nothing for those of running text and unknown ones, ``strength`` words for the tags around content."""
        return 0.1 + self.strength * max(map(self.chance, found)) ** 2

    def left_out(self, found: tuple[str, ...]) -> bool:
        """Whether the element goes with all that it holds. Bare tags only cost: a plain div or list may hold anything."""
        return any(m[0] in ".#" and self.chance(m) >= OUTSIDE for m in found)


def share_outside(mark: str, inside: int, outside: int) -> float:
    """The chance from counts; elements set apart and hidden ones are no part of the content wherever they stand."""
    return 1.0 if mark[0] == "#" else (outside + BEFORE[0]) / (inside + outside + BEFORE[1])


@dataclass
class Element:
    tag: str
    marks: tuple[str, ...]
    bad: bool
    inside: bool  # within marked content
    claimed: bool  # within an element that has a class or id
    around: bool = False  # marked content lies in it


def tokens(page: str, weights: Weights, closed: Callable[[Element], None] | None = None) -> list[tuple[str, str, float]]:
    """The page as (kind, text, score): tags by name, text pieces as ``#word``, and ``#cut`` where an element is left out with all that it holds.

    A word scores 1, a tag what its element costs, negative, a left-out element next to nothing: it may stand within an article. An element
    that is never closed ends with its parent; a p, li, dt,
    dd, tr, td or th also ends at the next one beside it. ``closed`` is told of each element that ends and isn't within one left out.
    """
    out: list[tuple[str, str, float]] = []
    stack: list[Element] = []  # open elements
    places: dict[str, list[int]] = {}  # where each tag's open elements are in the stack
    within: list[int] = []  # where the block elements are, and those among them that bound a list item
    bounds: list[int] = []
    deep = content = named = 0

    def last(*names: str) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close(at: int) -> None:
        nonlocal deep, content, named
        while len(stack) > at:
            e = stack.pop()
            places[e.tag].pop()
            deep -= e.bad
            content -= e.tag in CONTENT
            named -= e.marks[0][0] == "."
            if closed and not deep:
                closed(e)
            for kept in (within, bounds):
                if kept and kept[-1] == len(stack):
                    kept.pop()

    for m in TOKEN.finditer(page):
        tag = m["tag"]
        if tag is None:
            if m["text"] is not None:
                if not deep:
                    out.append((WORDS, m["text"], float(len(m["text"].split()))))
            elif m["raw"]:
                out.append((CUT, "", -0.1))
            continue
        tag = tag.lower()
        if m["close"]:
            at = last(tag)
            if at < 0:
                continue
            found = stack[at].marks
            close(at)
            if not deep:
                out.append((tag, "", -weights.cost(found) if not weights.left_out(found) else -0.1))
            continue
        # An element whose end tag may be left out ends at the next one in the same parent
        if tag == "p":
            if within and stack[within[-1]].tag == "p":
                close(within[-1])
        elif tag in ENDS:
            if bounds and stack[bounds[-1]].tag in ENDS[tag]:
                close(bounds[-1])
        elif tag in CELLS:
            at = last(*CELLS[tag])
            if at > last("table"):
                close(at)
        found = marks(tag, m["attrs"], content > 0)
        bad = tag not in ("body", "html") and tag not in CONTENT and weights.left_out(found)
        if not deep:
            out.append((CUT, "", -0.1) if bad else (tag, "", -weights.cost(found)))
        e = Element(tag, found, bad, content > 0, named > 0)
        if tag in VOID or m["attrs"].endswith("/"):
            if closed and not deep and not bad:
                closed(e)
            continue
        if tag in CONTENT:
            e.around = True
            for x in reversed(stack):
                if x.around:
                    break
                x.around = True
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            within.append(len(stack))
            if tag not in UNBOUND:
                bounds.append(len(stack))
        stack.append(e)
        deep += bad
        content += tag in CONTENT
        named += found[0][0] == "."
    close(0)
    return out


def tally(page: str) -> Counter:
    """(mark, whether inside) of each element of a page with marked content, and one (``""``, True) for the page; empty for any other page.

    The content's own element counts as outside, since its tags stand at the border; what else holds content doesn't count. A bare tag
    outside counts only if no class, id or element set apart around it says why it is there.
    """
    out: Counter = Counter()
    labelled = False

    def closed(e: Element) -> None:
        nonlocal labelled
        labelled |= e.tag in CONTENT
        if e.tag in CONTENT or not e.around:
            for m in e.marks:
                if m[0] == "." or m[0] != "#" and (e.inside or not e.claimed):
                    out[m, e.inside] += 1

    tokens(page, Weights({}), closed)
    if not labelled:
        return Counter()
    out["", True] = 1
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum, (first, last exclusive), by one scan; of equals the first; empty if none is above 0."""
    best = now = 0.0
    run, start = (0, 0), 0
    for i, s in enumerate(scores):
        if now <= 0:
            now, start = 0.0, i
        now += s
        if now > best:
            best, run = now, (start, i + 1)
    return run


def main_text(page: str, weights: Weights) -> str:
    """The text of the page's best region."""
    parts = tokens(page, weights)
    a, b = best_run([s for *_, s in parts])
    pieces = [" " if k in BLOCK or k == CUT else html.unescape(t) for k, t, _ in parts[a:b]]
    return " ".join("".join(pieces).split())


def learn(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all pages that label their content with an article or main element.

    The driver gets two counts for each known tag, and for each class or id that is on at least ``LEAST_SHARE`` of these pages.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(counts: Counter) -> pa.RecordBatch:
            rows = sorted(counts.items())
            return pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in rows], pa.string()), pa.array([i for (_, i), _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["mark", "inside", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                counts += tally(page.as_py() or "")
                if len(counts) > 1 << 18:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    counted = pages.select(F.col(f"`{html_col}`").cast("string")).mapInArrow(run, "mark string, inside boolean, n long")
    counted = counted.groupBy("mark").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    counted = materialize(counted)
    labelled = counted.where("mark = ''").first()
    least = (labelled["a"] if labelled else 0) * LEAST_SHARE
    rows = counted.where((F.col("mark") != "") & (~F.col("mark").startswith(".") | (F.col("a") + F.col("b") >= F.lit(least)))).collect()
    release(counted)
    return Weights({r["mark"]: share_outside(r["mark"], r["a"], r["b"]) for r in rows})


def extract(pages: DataFrame, weights: Weights | None = None, html_col: str = "html", text_out: str = "text") -> DataFrame:
    """All columns of ``pages`` but the HTML, with the main text and its length in code points (``n_chars``).

    The page is read as a run of words, which score positive, and tags, which score negative, and one scan finds the run with the best
    score. What a tag costs is learned from the pages that label their content: from where its uses lie, by class or id where it has any.
    Classes that the labelled pages have outside the content are left out with all that they hold, wherever they stand, like the elements
    that HTML itself sets apart (navigation, asides, forms, footers, page headers), scripts, styles, comments and hidden elements. A
    label only costs, as the tags at the content's border do, so labelled and other pages are read alike.

    Character references are decoded, white space becomes single spaces, and blocks are joined by one space. A null page is empty and
    gives an empty text, as does a page where no run scores above 0. Of equal runs the first is taken. Pages cut off in the middle
    of a tag or script keep what comes before. Repeated rows each get their result. Columns named like the outputs are replaced; no other
    name clashes with any. An empty table gives no rows.
    """
    weights = learn(pages, html_col) if weights is None else weights
    keep = [c for c in pages.columns if c not in (html_col, text_out, "n_chars")]

    def work() -> Callable[[list[str]], list[tuple]]:
        return lambda texts: [(t, len(t)) for t in (main_text(p, weights) for p in texts)]

    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias(text_out))
    return with_text_columns(source, text_out, f"`{text_out}` string, n_chars long", work)
