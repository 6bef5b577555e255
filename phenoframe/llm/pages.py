"""Main text of web pages as the maximum-scoring subsequence of their words and tags.

A page is a sequence of words and tags. Tags score negative; words score the log odds that words in
such a place (block element, or kind of side matter they stand in) are main text. Both are learned from
pages that label themselves with an article or main element, on top of a prior for places that
these pages do not show. One linear scan finds the contiguous region with the highest sum. The region is
completed to the blocks and the article elements it touches, and side matter inside it is left out.

Side matter is what elements or names say it is, unless they wrap the page: a form or a name that holds most of
the page's words (and most of its articles' words) is a wrapper and says nothing. Null, empty and text-free pages have an empty
text; malformed, deeply nested and very long pages are read in one pass; repeated rows are rows of their own; only the columns
named are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoframe.llm.session import arrow_batches

# Element names of HTML.
RAW = frozenset("script style textarea title noscript template svg iframe select button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE = frozenset("nav header footer aside form menu dialog head".split())
ROOT = frozenset("article main".split())
# Names in class, id and role attributes that mark side matter.
NAMES = {
    "advert": "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs toc",
    "frame": "header masthead footer sidebar aside widget related recommended share sharing social",
    "notice": "notice cookie cookies consent gdpr popup modal overlay alert newsletter subscribe signup paywall disclaimer login",
    "comment": "comment comments reply replies respond disqus discussion reactions",
}
_NAMED = {name: kind for kind, names in NAMES.items() for name in names.split()}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_HIDDEN = re.compile(r"\shidden(?:[\s=>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

FIELDS = frozenset("form fieldset label legend".split())  # words right inside these are not what a form wraps

PRIOR_WEIGHT = 50.0  # words' worth of prior in each place
TAG = -0.5  # prior score of a tag
SIDE_WORDS = 1  # words of one piece of side matter that count: an advert must not split a long article


def side_kind(name: str, attributes: str) -> str | None:
    """Why an element is side matter, or None."""
    if name in SIDE:
        return name
    if "=" not in attributes and "hidden" not in attributes:
        return None
    if _HIDDEN.search(attributes):
        return "hidden"
    if name in ("body", "html"):
        return None
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for word in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", a or b or c).lower()):
            if word in _NAMED and (name not in ROOT or _NAMED[word] == "comment"):
                return _NAMED[word]
    return None


def may_wrap(name: str, why: str | None) -> bool:
    """Whether an element that counts as side matter may turn out to wrap the page."""
    return why is not None and (name == "form" or name not in SIDE and why not in ("hidden", "comment"))


class Piece:
    """Text between two tags: its block, its place (what it is scored by) and whether it is side matter.

    ``root`` numbers the innermost article (positive) or main element (negative) it lies in, ``aside`` the innermost element
    that may be side matter.
    """

    __slots__ = ("at", "stop", "text", "block", "place", "side", "tags", "root", "words", "aside")

    def __init__(self, at, stop, text, block, place, side, tags, root, aside=0):
        self.at, self.stop, self.text, self.block, self.place, self.side, self.tags, self.root = at, stop, text, block, place, side, tags, root
        self.words, self.aside = len(text.split()), aside


class Asides:
    """The elements of a page that may be side matter; number 0 is the page itself."""

    def __init__(self):
        self.why: list[str | None] = [None]
        self.above, self.wraps = [0], [False]

    def add(self, why: str, above: int, wraps: bool) -> int:
        self.why.append(why)
        self.above.append(above)
        self.wraps.append(wraps)
        return len(self.why) - 1

    def settle(self, parts: list[Piece]) -> list[str | None]:
        """For each element, why texts in it are side matter; wrappers of most of the page count as not there."""
        n = len(self.why)
        if not any(self.wraps):
            return self.why
        sure = [False] * n  # inside something that can't be a wrapper
        for k in range(1, n):
            sure[k] = not self.wraps[k] or sure[self.above[k]]
        held, rooted = [0] * n, [0] * n
        for p in parts:
            if not sure[p.aside] and p.place not in FIELDS:
                held[p.aside] += p.words
                rooted[p.aside] += p.words if p.root else 0
        for k in range(n - 1, 0, -1):
            held[self.above[k]] += held[k]
            rooted[self.above[k]] += rooted[k]
        why = list(self.why)
        for k in range(1, n):
            if self.wraps[k] and 2 * held[k] > held[0] and 2 * rooted[k] >= rooted[0]:
                why[k] = why[self.above[k]]
        return why


def pieces(page: str) -> list[Piece]:
    """All texts of a page in order, with the number of tags before each."""
    found: list[Piece] = []
    stack: list[tuple[str, int, str]] = [("", 0, "body")]  # open elements that hold blocks, innermost aside and block in each
    asides, opened = Asides(), Counter()
    roots: list[int] = []
    block = tags = n_roots = at = link = 0
    leaf = "body"

    def text(stop: int) -> None:
        nonlocal tags
        if stop > at:
            place = f"link:{leaf}" if link else leaf
            found.append(Piece(at, stop, html.unescape(page[at:stop]), block, place, False, tags, roots[-1] if roots else 0, stack[-1][1]))
            tags = 0

    def close(name: str) -> None:
        """Close the innermost open element of this name and what is open inside it."""
        while opened[name]:
            last = stack.pop()[0]
            opened[last] -= 1
            if last in ROOT:
                roots.pop()
            if last == name:
                return

    def settled() -> list[Piece]:
        why = asides.settle(found)
        for p in found:
            if why[p.aside]:
                p.side, p.place = True, f"side:{why[p.aside]}"
        return found

    n, pos = len(page), 0
    while True:
        match = _TOKEN.search(page, pos)
        if not match:
            text(n)
            return settled()
        text(match.start())
        at = pos = match.end()
        name = match[2].lower() if match[2] else ""
        if not name:
            continue
        tags += 1
        if name in RAW:
            if not match[1] and not match[3].endswith("/"):
                end = _RAW_END[name].search(page, pos)
                at = pos = end.end() if end else n
                tags += 1
            continue
        if match[1]:
            if name == "a":
                link = 0
            if name not in BLOCK and not opened[name]:
                continue
            block += name in BLOCK
            close(name)
            leaf = stack[-1][2]
            continue
        why = side_kind(name, match[3])
        if name in BLOCK:
            block += 1
            link = 0
            leaf = name
            if stack[-1][0] == "p":
                close("p")
            if name == "body":
                close("head")
            if name in ("li", "dd", "dt", "td", "th", "tr") and stack[-1][0] == name:
                close(name)
        elif name == "a":
            link = 1
        if (why or name in BLOCK) and name != "a" and name not in VOID and not match[3].endswith("/"):
            above = stack[-1][1]
            stack.append((name, asides.add(why, above, may_wrap(name, why)) if why else above, name if name in BLOCK else stack[-1][2]))
            opened[name] += 1
            if name in ROOT:
                n_roots += 1
                roots.append(n_roots if name == "article" else -n_roots)


def place_counts(page: str) -> Counter:
    """(place, inside the labelled region) word counts of a page, and tags as place ``<>``."""
    parts, counts = pieces(page), Counter()
    if not any(p.root for p in parts):
        return counts
    for p in parts:
        counts[p.place, bool(p.root)] += p.words
        counts["<>", bool(p.root)] += p.tags
    return counts


def prior(place: str) -> float:
    """Share of main text expected where labelled pages show nothing."""
    if place.startswith("side:"):
        return 0.02
    if place.startswith("link:"):
        return 0.2
    return 0.9 if re.fullmatch("p|pre|blockquote|article|main|h[1-6]", place) else 0.8


class Weights:
    """Scores of words by place, and of tags."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        self.known = {}
        for place in {place for place, _ in counts} - {"<>"}:
            self.known[place] = self._odds(place, counts.get((place, True), 0), counts.get((place, False), 0))
        words = sum(v for (place, inside), v in counts.items() if inside and place != "<>")
        # A tag costs less than the words around it earn in main text, and never nothing.
        self.tag = max(TAG, -0.25 * words / max(1, counts.get(("<>", True), 0))) if words else TAG

    @staticmethod
    def _odds(place: str, inside: float, outside: float) -> float:
        share = prior(place)
        total = inside + outside
        # Labelled words count up to a hundred priors, so no place becomes certain.
        scale = min(1.0, 100 * PRIOR_WEIGHT / total) if total else 0.0
        return float(np.log((inside * scale + PRIOR_WEIGHT * share) / (outside * scale + PRIOR_WEIGHT * (1 - share))))

    def __getitem__(self, place: str) -> float:
        return self.known[place] if place in self.known else self._odds(place, 0, 0)


def best_region(parts: list[Piece], weights: Weights) -> tuple[int, int]:
    """First and last text of the region with the highest sum, found in one scan; (0, -1) if none is positive."""
    best, answer, total, start = 0.0, (0, -1), 0.0, 0
    for i, p in enumerate(parts):
        total += p.tags * weights.tag
        if total <= 0:
            total, start = 0.0, i
        total += (min(p.words, SIDE_WORDS) if p.side else p.words) * weights[p.place]
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, answer = total, (start, i)
    return answer


def main_text(page: str, weights: Weights) -> tuple[str, int, int]:
    """Main text and the character span of its region in the page."""
    parts = pieces(page)
    first, last = best_region(parts, weights)
    if last < first:
        return "", 0, 0
    inside = Counter()
    for p in parts[first: last + 1]:
        if not p.side:
            inside[p.root] += p.words
    touched = {root for root, words in inside.items() if root and words}
    if touched and 2 * inside[0] <= inside.total():
        # Articles are completed; of a main element around them only the title is taken.
        kept = {root for root in touched if root > 0} or touched
        own = [p for p in parts if not p.side and (p.root in kept or p.root in touched and p.place == "h1")]
    else:
        while first and parts[first - 1].block == parts[first].block:
            first -= 1
        while last + 1 < len(parts) and parts[last + 1].block == parts[last].block:
            last += 1
        own = [p for p in parts[first: last + 1] if not p.side]
    if not own:
        return "", 0, 0
    lines, block = [], None
    for p in own:
        if p.block == block:
            lines[-1].append(p.text)
        else:
            lines.append([p.text])
            block = p.block
    # Texts of one block are joined as they stand; tags inside a block are no white space, line breaks are.
    kept = (" ".join("".join(x).split()) for x in lines)
    return "\n".join(x for x in kept if x), own[0].at, own[-1].stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = Counter()
        for page in batch.column(0).to_pylist():
            total.update(place_counts(page or ""))
        rows = [(place, inside, n) for (place, inside), n in total.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())],
            ["place", "inside", "n"])


def fit_weights(pages: DataFrame, page_id: str = "page_id", markup: str = "html", sample: int = 4000) -> Weights:
    """Learn from at most ``sample`` pages; those without an article or main element count nothing.

    Places are element names and kinds of side matter, so the result is a small table.
    """
    arrow_batches(pages.sparkSession, rows=500)
    chosen = pages.select(F.col(page_id).alias("page")).distinct().orderBy(F.xxhash64("page"), "page").limit(sample)
    some = pages.select(F.col(page_id).alias("page"), F.col(markup).alias("html")).join(F.broadcast(chosen), "page").select("html")
    counted = some.mapInArrow(_count, "place string, inside boolean, n long").groupBy("place", "inside").agg(F.sum("n").alias("n"))
    return Weights({(r.place, r.inside): r.n for r in counted.collect()})


def extract(pages: DataFrame, weights: Weights, markup: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of every page row with ``main`` (struct of text, start and stop of the region).

    Null, empty and text-free pages have an empty text; malformed markup is read as far as it goes.
    """
    arrow_batches(pages.sparkSession, rows=500)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page or "", weights) for page in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([x[0] for x in found], pa.string()), *(pa.array([x[k] for x in found], pa.int64()) for k in (1, 2))],
                [*keep, "text", "region_start", "region_stop"])

    return pages.select(*keep, markup).mapInArrow(run, f"{kinds}, text string, region_start long, region_stop long")
