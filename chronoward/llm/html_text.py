"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks at block-level tags and line breaks. Each block has its number of words, the share of
them inside links, the same two figures of the blocks before and after it, and three marks of where it stands (inside a
container that is not content, inside an article, a heading). A decision tree, grown from the labelled table below,
decides which blocks are main text.

Null or empty html gives an empty text of 0 characters. Repeated rows stay separate rows. An unterminated comment,
script or tag runs to the end of the page, as in browsers.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Names of HTML elements and of usual classes.
SKIPPED = frozenset("script style noscript template iframe svg canvas object audio video select option datalist head title button textarea map math".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog fieldset address".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HINT = re.compile(
    r"ad|ads|adbox|adslot|advert[a-z]*|banner|sponsor[a-z]*|promo[a-z]*|nav[a-z]*|menu[a-z]*|header|masthead|footer|sidebar|breadcrumb[a-z]*|cookie[a-z]*|consent|notice[a-z]*|alert|popup|modal|newsletter|subscribe[a-z]*|signup|login|"
    r"comment[a-z]*|disqus[a-z]*|respon[ds][a-z]*|replies|reply|share|sharing|social|related|recommend[a-z]*|widget[a-z]*|pagination|pager|toolbar|search[a-z]*|form|copyright|disclaimer|hidden"
)
#: Words that may stand beside such a name without changing what it says.
GENERIC = frozenset(
    "a all area bar block body bottom box button by card center col column container content desktop div el element fixed float full global grid group holder icon id in info inline inner item items js label large layout left line link links list main mobile "
    "my nav new no of on outer overlay page panel part popular position post posts primary region right row secondary section side site skip small sr only sticky sub super tag tags text thread title to top unit user visually web wrap wrapper x".split()
)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
IN_TAG = re.compile(r"=\s*([\"'])|>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: The labelled table. words, link share, words before, link share before, words after, link share after,
#: stands in a container that is not content, stands in an article, is a heading; 1 where the block is main text.
LABELLED = """
 12 0.00   0 0.0  80 0.0 0 1 1 1
  9 0.00   1 1.0 120 0.0 0 1 1 1
  3 0.00   5 0.0   2 0.0 0 1 0 1
  1 0.00  14 0.0  60 0.0 0 1 0 1
 80 0.00  12 0.0  70 0.0 0 1 0 1
140 0.05  80 0.0   4 0.0 0 1 0 1
 60 0.10  30 0.0   1 1.0 0 1 0 1
 25 0.30  90 0.0  60 0.0 0 1 0 1
 45 0.00   6 0.0   0 0.0 0 1 0 1
  6 0.00   0 0.0   7 0.0 0 1 0 1
  7 0.00   6 0.0   0 0.0 0 1 0 1
 10 0.00 200 0.0 150 0.0 0 1 0 1
  5 1.00  70 0.0   4 1.0 0 1 0 0
  4 1.00   5 1.0   0 0.0 0 1 0 0
  8 0.90  60 0.0   3 1.0 0 1 0 0
  3 1.00   4 1.0   5 1.0 0 1 0 0
  2 1.00  30 0.0   2 1.0 0 1 0 0
  6 1.00   2 1.0   3 0.0 0 1 0 0
  5 1.00  70 0.0  40 0.0 0 1 0 1
  3 1.00  12 0.0   9 0.0 0 1 0 1
  9 0.80  25 0.0  30 0.1 0 1 0 1
  3 0.00  50 0.0   2 1.0 0 1 0 1
  8 0.00   4 1.0   6 1.0 0 1 0 1
 20 0.00   2 1.0   1 1.0 0 1 0 1
  1 0.00   1 1.0   1 1.0 0 1 0 1
 12 0.00  30 0.0   4 1.0 0 1 0 1
  2 0.00   5 1.0   3 0.0 0 1 0 1
  5 0.00   1 1.0   1 0.5 0 1 1 1
 28 0.00   3 1.0   2 1.0 0 1 0 1
 15 0.30   6 0.9   4 1.0 0 1 0 1
  1 1.00   0 0.0   1 1.0 1 0 0 0
  1 1.00   1 1.0   1 1.0 1 0 0 0
  2 1.00   1 1.0  12 0.0 1 0 0 0
  9 0.00   1 1.0  11 0.0 1 0 0 0
 30 0.00   1 1.0  10 0.0 1 0 0 0
  8 0.00  90 0.0   0 0.0 1 0 0 0
 12 0.10 140 0.0   0 0.0 1 0 0 0
 40 0.00 100 0.0  35 0.0 1 0 0 0
 70 0.00  40 0.0  20 0.0 1 1 0 0
 15 0.00  60 0.0  30 0.0 1 1 0 0
  4 0.00  60 0.0  30 0.0 1 1 1 0
  6 0.50  20 0.0   2 1.0 1 0 0 0
  3 0.00   2 1.0   8 0.0 1 0 1 0
 90 0.00  10 0.0  85 0.0 0 0 0 1
 60 0.05  85 0.0  75 0.0 0 0 0 1
 45 0.10  20 0.0  50 0.0 0 0 0 1
 30 0.00  60 0.0   5 0.0 0 0 0 1
 24 0.00   3 1.0  70 0.0 0 0 0 1
 18 0.00  55 0.0  48 0.0 0 0 0 1
 14 0.00  40 0.0  36 0.0 0 0 0 1
  8 0.00   2 1.0  60 0.0 0 0 1 1
  7 0.00  50 0.0  70 0.0 0 0 1 1
  6 0.00  40 0.0  44 0.0 0 0 0 1
  3 1.00   2 1.0   4 1.0 0 0 0 0
  2 1.00   0 0.0   2 1.0 0 0 0 0
  5 0.80   4 1.0   6 1.0 0 0 0 0
 12 0.75   9 1.0   8 1.0 0 0 0 0
 30 0.70  20 0.8  18 0.9 0 0 0 0
  4 0.00   3 1.0   2 1.0 0 0 0 0
  6 0.00   5 0.9   0 0.0 0 0 0 0
  3 0.00   0 0.0   2 1.0 0 0 0 0
  5 0.00   2 1.0   4 0.0 0 0 0 0
  7 0.00   8 0.5   0 0.0 0 0 0 0
 60 0.00  80 0.0   0 0.0 0 0 0 1
 35 0.00  50 0.0   3 1.0 0 0 0 1
 50 0.00   4 1.0   2 1.0 0 0 0 1
100 0.00   0 0.0   0 0.0 0 0 0 1
 40 0.00   0 0.0   0 0.0 0 0 0 1
 26 0.00  40 0.0   4 0.0 0 0 0 1
  3 0.00   1 1.0   6 0.5 0 0 0 0
  4 0.00   2 1.0   9 0.9 0 0 0 0
  2 0.00   0 0.0   7 1.0 0 0 0 0
  5 0.00   3 0.0  12 1.0 0 0 0 0
  5 0.00   5 0.0   6 0.0 0 0 0 0
  9 0.00   1 1.0  90 0.0 1 0 0 0
 14 0.00   3 0.0  60 0.0 1 0 0 0
 50 0.00   8 0.0  45 0.0 1 0 0 0
 26 0.00  90 0.0  80 0.0 1 1 0 0
  7 0.00   4 0.0  55 0.0 1 1 0 0
  2 0.00   3 0.0  40 0.0 1 1 1 0
  1 0.00  70 0.0 120 0.0 1 1 0 0
  3 0.00 120 0.0   2 0.0 1 1 0 0
 20 0.00   2 0.0   8 0.0 1 1 0 0
110 0.00   6 0.0  18 0.0 1 1 0 0
 35 0.20  12 0.0   3 0.0 1 0 0 0
 10 0.00  10 0.0  10 0.0 1 0 0 0
  1 0.00   1 1.0   2 0.0 1 0 0 0
  4 0.25  20 0.0   6 0.0 1 1 0 0
 16 0.00  16 0.0  70 0.0 1 0 0 0
  2 0.00 100 0.0  50 0.0 0 1 0 1
  3 0.00   3 0.0   3 0.0 0 1 0 1
  1 0.00   1 0.0   1 0.0 0 1 0 1
  2 0.00   9 1.0   8 0.0 0 1 0 1
 17 0.00   2 0.0   9 0.0 0 1 0 1
 11 0.20  33 0.0  12 0.0 0 1 0 1
  4 0.00  40 0.0   9 0.0 0 1 1 1
  5 0.40  15 0.0  25 0.0 0 1 0 1
 30 0.00  30 0.0   8 0.0 0 1 0 1
 22 0.00  10 0.0   0 0.0 0 1 0 1
  1 0.00 300 0.0   0 0.0 0 1 0 1
 75 0.30  20 0.0  14 0.0 0 1 0 1
"""


def labelled() -> list[tuple[list[float], int]]:
    rows = [list(map(float, line.split())) for line in LABELLED.strip().splitlines()]
    return [(r[:-1], int(r[-1])) for r in rows]


def grow(rows: list[tuple[list[float], int]], depth: int = 6):
    """A decision tree by Gini impurity: a label, or (feature, cut, tree up to the cut, tree above it)."""
    ones = sum(y for _, y in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            cost = 0.0
            for side in ([y for x, y in rows if x[f] <= cut], [y for x, y in rows if x[f] > cut]):
                p = sum(side) / len(side)
                cost += 2 * p * (1 - p) * len(side)
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, cut
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] <= cut], depth - 1), grow([r for r in rows if r[0][f] > cut], depth - 1)


def decide(tree, x: list[float]) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def hinted(names: str) -> bool:
    """Whether one of the names of a class or id says that there is no content, and nothing else."""
    for name in names.split():
        pieces = [x.lower() for x in PIECES.findall(name)]
        hints = [bool(HINT.fullmatch(x)) for x in pieces]
        if any(hints) and all(h or x in GENERIC or x.isdigit() for h, x in zip(hints, pieces)):
            return True
    return False


def outside(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element holds no content: 2 by its kind, role or being hidden, 1 by its class or id, which an article
    inside it outweighs, else 0."""
    if name in OUTSIDE and not (name == "header" and in_article):
        return 2
    weak = 0
    if attributes.strip():
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return 2
            if key in ("class", "id") and name not in ("html", "body", "article", "main") and hinted(value):
                weak = 1
    return weak


def tag_end(page: str, at: int) -> int:
    """Where the tag that is open at `at` ends (its >), past quoted values; -1 if it does not. A quote that never closes is none."""
    while (m := IN_TAG.search(page, at)) is not None:
        if m.group(1) is None:
            return m.start()
        close = page.find(m.group(1), m.end())
        at = m.end() if close < 0 else close + 1
    return -1


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """Flat blocks in page order: text, words, words in links, outside, in an article, heading."""
    out: list[tuple[str, int, int, bool, bool, bool]] = []
    parts: list[tuple[str, bool]] = []
    open_: list[tuple[str, int]] = []  # elements that matter for what they hold, and whether they hold no content
    marks = {"out": 0, "weak": 0, "article": 0, "skip": 0, "a": 0}
    suspended: list[int] = []  # weak marks around each open article
    heading = False

    def close_block() -> None:
        if parts:
            words, linked = "".join(t for t, _ in parts).split(), sum(len(t.split()) for t, a in parts if a)
            if words:
                out.append((" ".join(words), len(words), min(linked, len(words)), marks["out"] + marks["weak"] > 0, marks["article"] > 0, heading))
            parts.clear()

    opened: Counter = Counter()

    def count(name: str, bad: int, by: int) -> None:
        opened[name] += by
        marks["out"] += by * (bad == 2)
        marks["weak"] += by * (bad == 1)
        marks["skip"] += by * (name in SKIPPED)
        if name in ("article", "main"):
            marks["article"] += by
            if by > 0:
                suspended.append(marks["weak"])
                marks["weak"] = 0
            else:
                marks["weak"] = suspended.pop()

    at, n = 0, len(page)
    while at < n:
        m = START.search(page, at)
        if not marks["skip"]:
            parts.append((entities.unescape(page[at : m.start() if m else n]), marks["a"] > 0))
        if m is None:
            break
        if m.group(1):
            end = page.find("-->", m.start() + 2)
            at = n if end < 0 else end + 3
            continue
        end = page.find(">", m.end()) if m.group(2) else tag_end(page, m.end())
        if end < 0:  # runs to the end of the page
            break
        at = end + 1
        if m.group(2):
            continue
        name, closing, attributes = m.group(4).lower(), bool(m.group(3)), page[m.end() : end]
        if name == "br" or name in BLOCK or name in SKIPPED:
            close_block()
        if name in BLOCK and name != "br":
            heading = name in HEADINGS and not closing
        if closing:
            if name == "a":
                marks["a"] = 0
            if opened[name]:
                while open_:
                    x, bad = open_.pop()
                    count(x, bad, -1)
                    if x == name:
                        break
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}[^>]*>?", re.I).search(page, at)
            if end is None:
                break
            at = end.end()
            continue
        if name == "a":
            marks["a"] = int(bool(re.search(r"\bhref\b", attributes, re.I)))
        if name in BLOCK and open_ and open_[-1][0] == "p":
            count(*open_.pop(), -1)
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        bad = outside(name, attributes, marks["article"] > 0)
        if bad or name in SKIPPED or name in BLOCK and name not in ("p", "li", "td", "tr", "th", "dd", "dt") and name not in HEADINGS:
            open_.append((name, bad))
            count(name, bad, 1)
    close_block()
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    kept = []
    for i, (text, words, linked, bad, article, heading) in enumerate(found):
        before, after = found[i - 1] if i else ("", 0, 0), found[i + 1] if i + 1 < len(found) else ("", 0, 0)
        x = [words, linked / words, before[1], before[2] / max(before[1], 1), after[1], after[2] / max(after[1], 1), float(bad), float(article), float(heading)]
        if decide(tree, x):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; other columns are not read."""
    tree = grow(labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
