"""Main text of a page from parser events: text-to-tag ratio per line, smoothed, clustered by a threshold.

The standard library's parser streams its events. Text between two block borders is a line; its ratio is
its characters over the tags met in it. Ratios are smoothed by a Gaussian over neighbouring lines, and the
lines above a threshold (a share of the standard deviation) form clusters. The content region is the innermost container
that holds most of the clusters' text, with the clusters and headings next to it; a marked article ends the descent.
Every line of the region is kept, short ones too. Menus, forms, notices and the like are left out of every region.

A class or an id leaves an element out only by a whole name, and never an article or main element. If a page
has no article or main element (or, without any, no main heading) outside the elements left out by name, one
that holds such and at least half of the text is a wrapper of the page and stays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML, and words by which pages name what is not their article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead title tr ul".split()
)
LEFT_OUT = frozenset(
    "aside audio button canvas datalist dialog embed footer form head header iframe input map math menu nav noframes noscript"
    " object optgroup option script search select style svg template textarea title video".split()
)
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OFF_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
OFF_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr"
    " header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies respond"
    " share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
# Compounds of these, joined by a hyphen or underscore, are such names too.
_COMPOUNDS = (
    ("site page-top global top left right blog", "header footer nav navbar navigation menu sidebar banner masthead"),
    ("main primary secondary", "nav navbar navigation menu sidebar"),
    ("comment comments", "list area section form thread wrapper block box container respond"),
    ("cookie cookies gdpr consent", "notice banner bar popup consent modal message overlay"),
    ("social share sharing", "links buttons icons bar box list media menu"),
    ("related", "posts articles links stories content items"),
    ("newsletter subscribe", "signup form box popup banner"),
    ("ad ads advert", "container wrapper slot banner unit box block"),
    ("nav menu", "bar menu list items links wrapper container"),
    ("breadcrumb breadcrumbs", "nav list trail wrapper container"),
    ("sidebar widget", "area wrapper container left right"),
    ("header footer", "nav menu links widgets"),
)
OFF_COMPOUNDS = frozenset(f"{a}-{b}" for first, second in _COMPOUNDS for a in first.split() for b in second.split())
# Articles below these are comments or teasers, not the page's own.
_OTHERS = re.compile(r"(comments?|replies|respond|related|promoted|sponsored|disqus)(-|$)")
# Elements whose start ends an open element of the same kind.
CLOSES = {
    "p": frozenset({"p"}),
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
}
_SPACE = re.compile(r"\s+")

# Standard deviation of the smoothing in lines, and the share of the smoothed ratios' deviation that a line must pass,
# smoothed, and by itself: a short line beside long ones is raised by them.
SIGMA = 1.0
THRESHOLD = 1.0
OWN_THRESHOLD = 0.8
# A container is the region if it holds this part of the text in clusters.
REGION_SHARE = 0.7


@dataclass
class Line:
    """A line of text: tags met since the line before, the container it lies in, and whether it is a heading."""

    text: str
    tags: int
    container: int
    heading: bool


class Lines(HTMLParser):
    """Collects lines, the tree of containers, and which of these are marked as article or main element.

    Text below an element left out by name is kept apart until the end shows whether it wraps the page. Trees are kept as
    lists of parents, which precede their children, so the work is linear however deep elements are nested.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Element, left out, in an article, innermost element left out by name, innermost container, in a heading.
        self.open: list[tuple[str, bool, bool, int, int, bool]] = [("", False, False, 0, 0, False)]
        self.counts: Counter[str] = Counter()  # open elements of each name
        self.raw: list[tuple[list[tuple[str, int]], int, int, bool]] = []
        self.parts: list[tuple[str, int]] = []
        self.tags = 0
        self.containers, self.marked = [0], [False]
        self.named = [0]  # parents of the elements left out by name; the first stands for the page
        self.others = [False]  # of each such element, whether articles below are not the page's own
        self.marks: dict[bool, set[int]] = {True: set(), False: set()}  # where articles and main headings are

    def _border(self) -> None:
        if any(data.strip() for data, _ in self.parts):
            _, _, _, _, container, heading = self.open[-1]
            self.raw.append((self.parts, self.tags, container, heading))
            self.tags = 0
        self.parts = []

    def _off(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in LEFT_OUT:
            # The heading of an article itself is a header that belongs to it.
            return not (tag == "header" and self.open[-1][2])
        for name, value in attrs:
            value = (value or "").lower()
            if name == "role" and value.strip() in OFF_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
        return False

    def _off_name(self, tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
        """The whole class or id that leaves an element out."""
        if tag not in ("html", "body", "main", "article") and ("role", "main") not in attrs and ("role", "article") not in attrs:
            for name, value in attrs:
                if name in ("class", "id"):
                    for token in (value or "").lower().replace("_", "-").split():
                        if token in OFF_NAMES or token in OFF_COMPOUNDS:
                            return token
        return None

    def _staying(self) -> list[bool]:
        """Of each element left out by name, whether it stays with all around it, as it holds the page's article,
        main element or heading and at least half of the text. Such elements lie in each other."""
        stay = [True] + [False] * (len(self.named) - 1)
        marks = self.marks[True] or self.marks[False]
        text, has_mark = [0] * len(stay), [False] * len(stay)
        for parts, _, _, _ in self.raw:
            for data, around in parts:
                text[around] += len(data.strip())
        for mark in marks:
            has_mark[mark] = True
        inside, children = has_mark.copy(), [[] for _ in stay]
        for n in range(len(stay) - 1, 0, -1):
            text[self.named[n]] += text[n]
            inside[self.named[n]] |= inside[n]
            children[self.named[n]].append(n)
        at = 0
        while marks and not has_mark[at] and children[at]:
            most = max(reversed(children[at]), key=text.__getitem__)
            if not inside[most] or 2 * text[most] < text[at]:
                break
            stay[most] = True
            at = most
        return stay

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append((" ", self.open[-1][3]))
        if tag in BLOCKS:
            self._border()
            closed = CLOSES.get(tag, frozenset({"p"}))
            if tag in CLOSES or tag != "body":
                self._end_open(closed)
        self.tags += 1
        if tag in VOID:
            return
        _, off, article, around, container, heading = self.open[-1]
        off = off or self._off(tag, attrs)
        own = tag in ("article", "main") or ("role", "main") in attrs or ("role", "article") in attrs
        if not off and (own or tag == "h1") and not self.others[around]:
            self.marks[own].add(around)
        if tag in CONTAINERS or own:
            self.containers.append(container)
            self.marked.append(own and not off)
            container = len(self.containers) - 1
        if not off and (name := self._off_name(tag, attrs)):
            self.named.append(around)
            self.others.append(self.others[around] or bool(_OTHERS.match(name)))
            around = len(self.named) - 1
        self.open.append((tag, off, article or own and not off, around, container, heading or tag in HEADINGS))
        self.counts[tag] += 1

    def _cut(self, at: int) -> None:
        for element in self.open[at:]:
            self.counts[element[0]] -= 1
        del self.open[at:]

    def _end_open(self, kinds: frozenset[str]) -> None:
        """End open elements of these kinds, down to the nearest container; formatting inside them ends too."""
        if not any(self.counts[kind] for kind in kinds):
            return
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name in kinds:
                self._cut(at)
            elif name in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._border()
        self.tags += 1
        if not self.counts[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self._cut(at)
                return
            if tag not in BLOCKS and self.open[at][0] in BLOCKS:
                return  # a stray end of formatting closes no block

    def handle_data(self, data: str) -> None:
        _, off, _, around, _, _ = self.open[-1]
        if not off:
            self.parts.append((data, around))

    def finish(self) -> list[Line]:
        self.close()
        self._border()
        stay, lines, carried = self._staying(), [], 0
        for parts, tags, container, heading in self.raw:
            text = _SPACE.sub(" ", "".join(data for data, around in parts if stay[around])).strip()
            if text:
                lines.append(Line(text, tags + carried, container, heading))
            # Tags of lines left out count for the next line.
            carried = 0 if text else carried + tags
        return lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian over neighbouring lines; at the ends the weights within the page are scaled up."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    if len(ratios) < len(kernel):  # a kernel longer than the page would make numpy swap the two
        ratios_, cut = np.concatenate((ratios, np.zeros(len(kernel)))), len(ratios)
        weights = np.concatenate((np.ones(cut), np.zeros(len(kernel))))
        return (np.convolve(ratios_, kernel, "same") / np.convolve(weights, kernel, "same").clip(1e-12))[:cut]
    return np.convolve(ratios, kernel, "same") / np.convolve(np.ones(len(ratios)), kernel, "same")


def clusters(lines: list[Line], sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """Which lines belong to a cluster: text-to-tag ratio, smoothed and own, above shares of the smoothed ones' deviation."""
    own = np.array([len(line.text) / max(1, line.tags) for line in lines])
    ratios = smoothed(own, sigma)
    above = (ratios >= threshold * ratios.std()) & (own >= min(threshold, OWN_THRESHOLD) * ratios.std())
    return above if above.any() else np.ones(len(lines), bool)


def _below(parents: list[int], tops: set[int]) -> list[bool]:
    """Of each container, whether it is or lies in one of ``tops``."""
    inside = [0 in tops]
    for n in range(1, len(parents)):
        inside.append(n in tops or inside[parents[n]])
    return inside


def region(lines: list[Line], parents: list[int], marked: list[bool], clustered: np.ndarray) -> list[int]:
    """The lines of the content region that the clusters select.

    From the page down, the container is entered that holds at least ``REGION_SHARE`` of the clusters' text, until none
    does or it is marked as the article. Where several marked ones hold that much together, they are the region. Lines
    next to the region within the container around it belong to it as long as they are in clusters, or headings before it.
    """
    weight = [0] * len(parents)
    for line, inside in zip(lines, clustered):
        weight[line.container] += len(line.text) * int(inside)
    children: list[list[int]] = [[] for _ in parents]
    for n in range(len(parents) - 1, 0, -1):
        weight[parents[n]] += weight[n]
        children[parents[n]].append(n)
    at = around = 0
    while not marked[at] and children[at]:
        most = max(children[at], key=weight.__getitem__)
        if weight[most] < REGION_SHARE * weight[0]:
            break
        # What surrounds the text by itself is no border of it.
        around = at if weight[most] < weight[at] or marked[most] else around
        at = most
    tops = {at}
    if not marked[at]:
        own = {n for n in range(1, len(parents)) if marked[n]}
        covered = _below(parents, own)
        outer = {n for n in own if weight[n] and not covered[parents[n]]}
        if outer and sum(weight[n] for n in outer) >= REGION_SHARE * weight[0]:
            tops = outer
    inside = _below(parents, tops)
    chosen = [i for i, line in enumerate(lines) if inside[line.container]]
    if tops != {at} or marked[at] or not chosen:
        return chosen
    near = _below(parents, {around})
    first, last = chosen[0], chosen[-1]
    while first > 0 and near[lines[first - 1].container] and (clustered[first - 1] or lines[first - 1].heading):
        first -= 1
    while last + 1 < len(lines) and near[lines[last + 1].container] and clustered[last + 1]:
        last += 1
    return list(range(first, last + 1))


def extract(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """Main text of a page: blocks in order, joined by an empty line; empty if there is none or null."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    kept = region(lines, parser.containers, parser.marked, clusters(lines, sigma, threshold))
    return "\n\n".join(lines[i].text for i in kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(html) for html in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages``; null and empty pages give empty text.

    Repeated rows give repeated results, null ids and urls stay null, other columns are not read.
    """
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        _extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
