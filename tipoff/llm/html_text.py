"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags, and each has a score: words score positive and tags negative, and words score negative too where
what encloses them (names of sectioning elements, words of classes, ids and roles, being hidden) and the share of links among the words
of their block speak against them. One linear scan finds the contiguous region with the largest sum. The page's text is the words in
that region that score positive.

All scores are learned from labelled pages: pages whose own markup names the article (an <article> or <main> element), the LABELLED of
them with the least crc32 of their id and those equal to the last of them. Words get the logits of a logistic model of their enclosing
features, fitted by Newton steps under a Gaussian prior; tags get their log-odds to stand inside the article. The prior is what a feature
that no labelled page shows keeps: BAD for the names listed below, 0 for others. The label itself is no feature.

Null or empty html, or a page without text, gives the empty text. Pages are read whole, whatever their length. Repeated rows and ids
give a row each. Character references are decoded, white space inside a block becomes one space, blocks are joined by one newline in page
order. Truncated tags, comments and scripts end with the page. Of regions with equal sums the first and longest counts. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import map_batches

LABELLED = 1000
#: The model has weights of its own for so many features, those of most words; the others keep their prior.
FEATURES = 400
#: Prior logits of a word that nothing speaks against, of a listed name, and of a block of which most words are links.
WORD, BAD, LINKS = 1.0, -4.0, -2.0
#: A word scores within LIMITS; no stretch of negative words costs more than MOST: an advert inside an article must not cut it in two.
LIMITS, MOST = (-3.0, 3.0), -12.0

# Names of elements and of classes in HTML.
RAW = "script style noscript template svg math iframe object canvas video audio select textarea title head"
BLOCKS = "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
NESTING = "article aside blockquote center dd details dialog div dl dt fieldset figure footer form header li main menu nav ol section table ul button label a"
BAD_TAGS = "nav footer aside form button menu dialog fieldset"
BAD_NAMES = (
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo"
    " cookie cookies copyright disclaimer disqus dropdown foot footer form gdpr header hidden legal login masthead menu modal nav navbar navigation newsletter notice"
    " notices notification pager pagination popup promo promos promotion recommended related replies reply respond search share sharing sidebar signup skip social"
    " sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets"
)
#: Scores of tags before anything is learned.
TAGS = {"tag": -0.6, "p": -0.1, "br": -0.1, "b": -0.1, "i": -0.1, "em": -0.1, "strong": -0.1, "a": -0.3, "li": -0.3}

_RAW, _BLOCKS, _NESTING = (frozenset(x.split()) for x in (RAW, BLOCKS, NESTING))
#: Names of enclosing elements that are features.
_SECTIONS = frozenset(BAD_TAGS.split()) | frozenset("header label button address figcaption blockquote dl summary details".split())
_KNOWN = _BLOCKS | _NESTING | frozenset("a abbr b br cite code em font i img input span strong sub sup u".split())
PRIOR = {"links:most": LINKS, "hidden": 2 * BAD, "header": BAD} | {t: BAD for t in BAD_TAGS.split()} | {f".{n}": BAD for n in BAD_NAMES.split()}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)[^>]*(?:>|\Z)", re.S)
_MARKS = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def marks_of(tag: str, attrs: str, in_article: bool) -> frozenset[str]:
    """Features that an element of this name and these attributes gives to the words in it. The header of an article is part of it."""
    if tag in ("article", "main", "body", "html"):
        return frozenset()
    own = tag == "header" and in_article
    out = {tag} if tag in _SECTIONS and not own else set()
    for m in _MARKS.finditer(attrs or ""):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            out.add("hidden")
        elif name in ("class", "id", "role") and not own:
            out |= {f".{x.lower()}" for x in _PART.findall(value)}
    return frozenset(out)


def parse(html: str) -> list[tuple[str, str, int, bool, frozenset[str], bool]]:
    """Runs in page order: (tag's name, or empty for a run of text; text; number of the block; inside an article or main element;
    features of what encloses it; in a link)."""
    none: frozenset[str] = frozenset()
    runs: list[tuple[str, str, int, bool, frozenset[str], bool]] = []
    stack: list[tuple[str, frozenset[str], bool, bool]] = []  # name, features, link, article: of what is open, each with what encloses it
    block, at, end = 0, 0, len(html)
    marks, link, art = none, False, False
    while at < end:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else end]
        if text:
            runs.append(("", text, block, art, marks, link))
        if not m:
            break
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], "")
        if not tag:
            continue
        tag = tag.lower()
        if tag in _RAW:
            if not close and not (attrs or "").endswith("/"):
                over = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                if tag != "head" or over:
                    at = over.end() if over else end
            continue
        if tag in _BLOCKS or tag == "br":
            if tag in ("td", "th", "br"):
                runs.append(("", " ", block, art, marks, link))
            else:
                block += 1
        runs.append((tag if tag in _KNOWN else "tag", "", block, art, none, False))
        if tag in _NESTING:
            if close:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in ("article", "main", "nav", "aside", "footer", "header") and tag in ("a", "label", "button", "li", "dd", "dt"):
                        break
            elif not attrs.endswith("/"):
                own = marks_of(tag, attrs, art)
                stack.append((tag, marks | own if own else marks, link or tag == "a", art or tag in ("article", "main")))
            _, marks, link, art = stack[-1] if stack else ("", none, False, False)
    return runs


def blocks_links(runs) -> dict[int, str]:
    """Block -> whether none, some or most of its words are links; a heading may be one link."""
    words: dict[int, list[int]] = {}
    headings = set()
    for kind, text, block, _, _, link in runs:
        if not kind:
            n = words.setdefault(block, [0, 0])
            n[link] += len(text.split())
        elif kind[0] == "h" and kind[1:].isdigit():
            headings.add(block)
    return {b: "links:most" if linked > 2 * plain and b not in headings else "links:some" if linked else "links:none" for b, (plain, linked) in words.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest positive sum; the earliest and longest of equals; (0, 0) if none is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, k
        total += s
        if total > best or total == best and where[0] == start and best > 0:
            best, where = total, (start, k + 1)
    return where


class Scores:
    """Scores of words by their features and of tags by their names."""

    def __init__(self, word: float = WORD, features: dict[str, float] = PRIOR, tags: dict[str, float] = TAGS):
        self.word, self.features, self.tags = word, features, tags
        self.memo: dict[tuple[frozenset[str], str], float] = {}

    def of(self, marks: frozenset[str], links: str) -> float:
        key = marks, links
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            z = self.word + sum(sorted(self.features.get(f, 0.0) for f in (*marks, links)))
            self.memo[key] = min(LIMITS[1], max(LIMITS[0], z))
        return self.memo[key]

    def runs(self, runs) -> tuple[list[float], list[float]]:
        """(score of a word of each run, score of each run)."""
        links, other = blocks_links(runs), self.tags["tag"]
        each, total, paid = [], [], 0.0
        for kind, text, block, _, marks, _ in runs:
            if kind:
                each.append(0.0)
                total.append(self.tags.get(kind, other))
                continue
            z = self.of(marks, links[block])
            s, each_now = z * len(text.split()), z
            if s > 0:
                paid = 0.0
            elif s < 0:
                s = max(s, MOST - paid)
                paid += s
            each.append(each_now)
            total.append(s)
        return each, total


def main_text(html: str | None, scores: Scores | None = None, region: bool = True) -> str:
    """The text of one page; without `region`, of all blocks whose words score positive."""
    if not html:
        return ""
    runs = parse(html)
    each, total = (scores or Scores()).runs(runs)
    a, b = best_region(total) if region else (0, len(runs))
    blocks: dict[int, list[str]] = {}
    for (kind, text, block, *_), z in zip(runs[a:b], each[a:b], strict=True):
        if not kind and z > 0:
            blocks.setdefault(block, []).append(text)
    return "\n".join(t for t in (" ".join(unescape("".join(parts)).split()) for parts in blocks.values()) if t)


def fitted(rows: list[tuple[frozenset[str], float, float]], ridge: float = 0.02) -> tuple[float, dict[str, float]]:
    """rows: (features, words inside the article, words outside) -> (logit of a bare word, weight of each feature)."""
    n: dict[str, float] = {}
    for marks, i, o in rows:
        for f in marks:
            n[f] = n.get(f, 0) + i + o
    names = sorted(n, key=lambda f: (-n[f], f))[:FEATURES]
    place = {f: k + 1 for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    fixed = np.zeros(len(rows))
    for r, (marks, _, _) in enumerate(rows):
        for f in marks:
            if f in place:
                x[r, place[f]] = 1
            else:
                fixed[r] += PRIOR.get(f, 0.0)
    inside, outside = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    inside, outside = 500 * inside / max(1.0, inside.sum()), 500 * outside / max(1.0, outside.sum())  # both sides weigh alike
    prior = np.array([WORD] + [PRIOR.get(f, 0.0) for f in names])
    w = prior.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w + fixed, -30, 30)))
        g = x.T @ (p * (inside + outside) - inside) + ridge * (w - prior)
        h = (x * (p * (1 - p) * (inside + outside))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    # what a page's class names say for its words must not outweigh what a menu or a form says against them
    return float(np.clip(w[0], 0.5, 3.0)), PRIOR | {f: float(np.clip(w[k], -8.0, 0.5)) for f, k in place.items()}


def learned(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", labelled: int = LABELLED) -> Scores:
    """Scores from pages that name their article; those before anything is learned where no page does."""
    order, share = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)), 8 * labelled / max(1, pages.count())
    named = F.lower(html_col).rlike("<(article|main)[ >]")
    while True:
        # the least crc32 values lie in a thin slice of all; only these numbers meet in one task, no page does
        slice_ = pages.select(html_col, order.alias("o")).filter(F.col("o") < min(1.0, share) * 2**32).filter(named).select("o")
        found = slice_.orderBy("o").limit(labelled).agg(F.count("*").alias("n"), F.max("o").alias("last")).first()
        if share >= 1 or found["n"] >= labelled:
            break
        share *= 8
    if not found["n"]:
        return Scores()
    sample = pages.filter((order <= found["last"]) & named).select(html_col)

    def make():
        def step(batch):
            n: dict[tuple[str, bool], int] = {}
            for html in batch.column(0).to_pylist():
                runs = parse(html)
                links = blocks_links(runs)
                for kind, text, block, inside, marks, _ in runs:
                    if kind:
                        key, k = (kind, inside), 1
                    else:
                        key, k = (" ".join(["", links[block], *sorted(marks)]), inside), len(text.split())
                    if k:
                        n[key] = n.get(key, 0) + k
            return pa.RecordBatch.from_arrays([pa.array(k for k, _ in n), pa.array(i for _, i in n), pa.array(n.values(), pa.int64())], ["kind", "inside", "n"])

        return step

    rows = map_batches(sample, make, "kind string, inside boolean, n long").groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("o")).collect()
    tags = dict(TAGS)
    for r in rows:
        if not r["kind"].startswith(" "):
            tags[r["kind"]] = min(-0.05, max(-3.0, math.log((r["i"] + 1) / (r["o"] + 1))))
    words = sorted((r["kind"], r["i"], r["o"]) for r in rows if r["kind"].startswith(" "))
    word, features = fitted([(frozenset(k.split()), i, o) for k, i, o in words])
    return Scores(word, features, tags)


def page_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars (code points)."""
    scores = learned(pages, html_col, id_col)
    model = scores.word, scores.features, scores.tags

    def make():
        own = Scores(*model)

        def step(batch):
            texts = [main_text(h, own) for h in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

        return step

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return map_batches(pages.select(id_col, url_col, html_col), make, f"{id_col} {kind[id_col]}, {url_col} {kind[url_col]}, text string, n_chars long")
