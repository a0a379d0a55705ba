"""Main text of web pages by the maximum-scoring subsequence.

A page is read once as a stream of words and tags. Words score positive and tags negative; words in links, in boilerplate containers, or
outside the article of a page that marks one, score negative too. The weights are log ratios of how often a kind of token stands
inside and outside the main text of labelled pages: the examples below, and pages of the table that mark their article. One linear
scan finds the contiguous region of the highest sum; the text blocks in it, without those in boilerplate containers, are the result.

A form is a boilerplate container if it holds controls rather than paragraphs: no more than ``CONTROL_WORDS`` words a control.

Defined results: a null or empty page, and one without words in its body, give the empty text; unclosed tags, comments and
attributes end at the next tag or the page's end; pages are read whole, whatever their length; repeated rows are read one by one; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm.common import query, table

#: labelled rows that weights are fitted to, at most; pages come in the order of a hash of their ids
LABELLED_ROWS = 1000
#: bound of a weight, in plain words; words of boilerplate containers are left out anyway and only part what lies on either side
MOST, MOST_BOILER = 1.5, 0.3

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>?""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")

RAW = {"script", "style", "title", "textarea", "template", "iframe", "svg", "math", "canvas", "object", "xmp", "noscript", "select", "noembed", "noframes"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td",
          "tfoot", "th", "thead", "tr", "ul"}
CONTAINERS = {"a", "address", "article", "aside", "blockquote", "button", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "label", "legend",
              "main", "menu", "nav", "ol", "section", "span", "table", "td", "ul", "p"}
BOILER_TAGS = {"nav", "aside", "footer", "button", "dialog", "fieldset", "label", "legend", "menu"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: parts of class names and ids that mark a container as boilerplate, whatever stands beside them
BOILER_ALWAYS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "comment", "comments", "commentlist", "disqus", "reply", "replies",
                 "cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe", "subscription", "popup", "modal", "breadcrumb", "breadcrumbs"}
#: and those that do unless a content word stands beside them
BOILER_NAMES = {"banner", "footer", "foot", "header", "masthead", "menu", "nav", "navbar", "navigation", "notice", "notices", "alert", "alerts", "related", "recommended", "share", "sharing",
                "sidebar", "social", "toolbar", "topbar", "widget", "widgets", "pagination", "pager", "login", "signup", "copyright", "tags", "skip", "feedback", "toc", "links", "warning"}
CONTENT_NAMES = {"article", "body", "content", "entry", "main", "post", "story", "text"}
MODIFIERS = {"has", "no", "with", "without", "is"}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _is_boiler(name: str, attributes: str, inside: bool) -> bool:
    """Does this tag open a boilerplate container? ``inside``: an article is open."""
    if name in BOILER_TAGS or name == "header" and not inside:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, a, b, c, hidden in _ATTR.findall(attributes):
        if hidden:
            return True
        key, value = key.lower(), a or b or c
        if key == "role" and value.lower() in BOILER_ROLES or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id"):
            for one in value.split():
                parts = {p.lower() for p in _PART.findall(one)}
                if parts & MODIFIERS or name in ("html", "body", "main"):
                    continue
                if parts & BOILER_ALWAYS or name != "article" and parts & BOILER_NAMES and not parts & CONTENT_NAMES:
                    return True
    return False


#: plain words that outweigh one control of a form
CONTROL_WORDS = 10
_FORM_END = re.compile(r"</form", re.I)
_CONTROL = re.compile(r"<(?:input(?![^>]*type\s*=\s*[\"']?hidden)|select|textarea|button|label)[\s/>]", re.I)
_CONTROL_TEXT = re.compile(r"<(label|button|select|textarea|legend|script|style)[\s>].*?(?:</\1|\Z)", re.I | re.S)


def _is_input_form(page: str, at: int) -> bool:
    """Does the form whose content begins at ``at`` hold controls rather than paragraphs? One left open ends with the page."""
    end = _FORM_END.search(page, at)
    held = page[at:end.start() if end else len(page)]
    controls = len(_CONTROL.findall(held))
    return len(_TAG.sub(" ", _CONTROL_TEXT.sub(" ", held)).split()) <= CONTROL_WORDS * max(1, controls)


_BODY = re.compile(r"<body[\s>]", re.I)
_MARK = re.compile(r"<(article|main)(\s[^>]*)?>", re.I)
_CLOSE = {name: re.compile(f"</{name}", re.I) for name in RAW}


def marks_article(page: str) -> bool:
    """Is there an article or main element that is not a reader comment or the like?"""
    return any(not _is_boiler(m[1].lower(), m[2] or "", False) for m in _MARK.finditer(page))


def tokens(page: str, marks: bool):
    """The page as a stream: ("tag", name) and ("text", kind, text, block, labelled).

    kind is plain, link, boiler or, if the page ``marks`` its article, outside; block numbers the text's block; labelled: inside the
    marked article or the label of an example.
    """
    stack: list[tuple[str, str]] = []
    boiler = link = inside = block = 0
    size = len(page)
    body = _BODY.search(page)
    at = body.start() if body else 0
    while at < size:
        found = _TAG.search(page, at)
        end = found.start() if found else size
        if end > at:
            text = page[at:end]
            if not text.isspace():
                kind = "boiler" if boiler else "outside" if marks and not inside else "link" if link else "plain"
                yield "text", kind, text, block, bool(inside) and not boiler
            else:
                yield "text", "", " ", block, False
        if not found:
            return
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if name in BLOCKS:
            block += 1
        elif name == "br":
            yield "text", "", " ", block, False
        yield "tag", name
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                close = _CLOSE[name].search(page, at)
                at = (page.find(">", close.start()) + 1 or size) if close else size
            continue
        if name not in CONTAINERS:
            continue
        if closing:
            if any(s[0] == name for s in stack):
                while True:
                    gone, kind = stack.pop()
                    boiler -= kind == "boiler"
                    link -= kind == "link"
                    inside -= kind == "inside"
                    if gone == name:
                        break
        elif not attributes.endswith("/"):
            if name in BLOCKS:  # a paragraph, and a link left open, end at the next block
                while stack and stack[-1][0] in ("p", "a", "span"):
                    _, kind = stack.pop()
                    boiler -= kind == "boiler"
                    link -= kind == "link"
            # forms do not nest: one inside another is not weighed again
            controls = name == "form" and not any(x[0] == "form" for x in stack) and _is_input_form(page, at)
            kind = "boiler" if controls or _is_boiler(name, attributes, bool(inside)) else "link" if name == "a" else "inside" if name in ("article", "main") or "data-main" in attributes else ""
            boiler += kind == "boiler"
            link += kind == "link"
            inside += kind == "inside"
            stack.append((name, kind))


#: tags counted one by one; all others are one kind
KNOWN_TAGS = BLOCKS | {"a", "b", "br", "i", "em", "strong", "span", "img", "input", "button", "label", "code", "sub", "sup", "small", "u", "script", "style"}


def kind_of(name: str) -> str:
    return f"<{name if name in KNOWN_TAGS else '?'}>"


def counts(page: str) -> Counter:
    """(kind, inside) -> number, over the page's tokens."""
    found: Counter = Counter()
    labelled = False
    for t in tokens(page, marks_article(page)):
        if t[0] == "tag":
            found[kind_of(t[1]), labelled] += 1
        elif t[1]:
            labelled = t[4]
            found[t[1], labelled] += len(t[2].split())
    return found


#: hand-labelled pages whose layout marks no article; data-main labels the main text
EXAMPLES = [
    """<body><div class="header"><a href="/">Daily Example</a> <a href="/news">News</a> <a href="/sport">Sport</a></div><div id="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li>
<li><a href="/c">About us</a></li></ul></div><div data-main><h1>A quiet harbour town plans its winter</h1><p>The council met on Tuesday evening to discuss repairs of the old sea wall, which storms had
damaged two years in a row, and to hear what residents thought of the costs.</p><p>Most speakers agreed that waiting any longer would be worse, though few could say where <a href="/x">the money</a> should
come from.</p><blockquote>We have always lived with the sea</blockquote><p>A decision is expected before the end of the month, once the engineers have delivered their second report.</p></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten walks for a weekend</a></li><li><a href="/2">Ferry times change again</a></li></ul></div><div class="comments"><h3>Comments</h3><p>Anna: well
written, thank you</p><p>Ben: I do not agree with the mayor at all</p></div><div id="footer">Copyright Daily Example. <a href="/p">Privacy</a> <a href="/t">Terms</a></div></body>""",
    """<body><table><tr><td><a href="/1">Products</a></td><td><a href="/2">Support</a></td><td><a href="/3">Contact</a></td></tr></table><div data-main><h2>How to repot a house plant</h2><p>Choose a pot that is
only a little wider than the old one and has a hole in its bottom.</p><ol><li>Water the plant the day before, so that the roots come loose more easily.</li><li>Lift it out and shake off the old soil with
care.</li><li>Fill the new pot to a third, set the plant in and press the soil down lightly.</li></ol><p>Keep it out of bright sun for a week.</p></div><p><a href="/r1">Related: Ferns</a> | <a href="/r2">Related:
Cacti</a></p><form action="/s"><label>Search</label><input name="q"><button>Go</button></form><p><small>All rights reserved</small></p></body>""",
    """<body><p><a href="/in">Log in</a> <a href="/reg">Register</a> <a href="/help">Help</a></p><div class="cookie-notice">We use cookies to improve this site. <button>Accept</button></div><div data-main><p>When the
first trains reached the valley, people set their clocks by the whistle, and the station master was a man of some standing in the village.</p><p>Today the line is a path for walkers.<br>It begins behind
the mill and follows the river for nine miles.</p><p>There is a small museum in the old goods shed, open on Sundays.</p></div><div><a href="/prev">Previous</a> <a href="/next">Next</a></div><div
class="ad">Cheap tickets to everywhere, book now</div><ul><li><a href="/f1">Imprint</a></li><li><a href="/f2">Sitemap</a></li></ul></body>""",
]


def weights_from(total: Counter) -> dict[str, float]:
    """Log ratios of a kind's share inside and outside, in units of a plain word's; tags and other words stay below zero.

    No kind counts more than ``MOST`` plain words, so that one layout among the labelled pages does not cut content apart in others.
    """
    kinds = {k for k, _ in total} | {"plain", "link", "boiler", "outside"}
    inside = sum(v for (_, i), v in total.items() if i) + 0.5 * len(kinds)
    outside = sum(v for (_, i), v in total.items() if not i) + 0.5 * len(kinds)
    raw = {k: math.log((total[k, True] + 0.5) / inside) - math.log((total[k, False] + 0.5) / outside) for k in kinds}
    plain = max(0.1, raw["plain"])
    return {k: 1.0 if k == "plain" else max(-MOST_BOILER if k == "boiler" else -MOST, min(-0.05, v / plain)) for k, v in raw.items()}


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page; if the marked article is empty, that of the page as if it marked none."""
    if not page:
        return ""
    marks = marks_article(page)
    return _region(page, marks, weights) or (_region(page, False, weights) if marks else "")


def _region(page: str, marks: bool, weights: dict[str, float]) -> str:
    best = run = 0.0
    texts, lo, hi, begin = [], 0, -1, 0
    for t in tokens(page, marks):
        if t[0] == "tag":
            # a tag kind that no labelled page has counts like a rare tag
            run += weights.get(kind_of(t[1]), -0.5)
        else:
            if t[1]:
                text = html.unescape(t[2]) if "&" in t[2] else t[2]
                run += weights[t[1]] * len(text.split())
            else:
                text = " "
            texts.append((t[1], text, t[3]))
        if run <= 0:
            run, begin = 0.0, len(texts)
        elif run > best:
            best, lo, hi = run, begin, len(texts)
    blocks: dict[int, list[str]] = {}
    wanted = {b for k, _, b in texts[lo:hi] if k in ("plain", "link")} if best > 0 else set()
    for kind, text, block in texts:
        if block in wanted and kind not in ("boiler", "outside"):
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def fit_weights(pages: DataFrame, rows: int = LABELLED_ROWS) -> dict[str, float]:
    """Weights from the examples and up to ``rows`` pages that mark an article; the counts, one per kind of token, come to the driver."""
    total: Counter = Counter()
    for e in EXAMPLES:
        total.update(counts(e))

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found.update(counts(page))
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64())], names=["kind", "inside", "n"])
    # narrow rows find the sample, whose few ids are broadcast to fetch the pages
    key = F.xxhash64("page_id", "html")
    sample = pages.filter(F.lower("html").contains("<article")).select(key.alias("key")).orderBy("key").limit(rows).distinct()
    labelled = pages.select("html", key.alias("key")).join(F.broadcast(sample), "key", "left_semi").select("html")
    for r in labelled.mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect():
        total[r["kind"], r["inside"]] += r["n"]
    return weights_from(total)


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) to page_id, url, text; one pass, no shuffle."""
    weights = weights or fit_weights(pages.select("page_id", "html"))

    def run(batches):
        for batch in batches:
            pages_ = batch.column(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([extract(pages_[i].as_py(), weights) for i in range(batch.num_rows)], pa.string())], names=["page_id", "url", "text"])
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string")


@query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
