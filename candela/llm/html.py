"""Main text of web pages from parser events, text-to-tag ratios and their smoothed clusters."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td template tfoot th
    thead title tr ul""".split())
SKIPPED = frozenset("""aside audio button canvas datalist dialog footer form head iframe menu nav noscript object script select style svg template
    textarea video""".split())
LEAF = frozenset("p li dt dd option h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal
    newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond replies social share
    sharing related recommended widget pagination pager toolbar skip""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())


class Events(HTMLParser):
    """Blocks as (text, tags inside, characters in links, outermost container or 0, whether a heading): a container is an article or main element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.depth = self.made = 0
        self.heading = False
        self.skip: str | None = None
        self.containers: list[tuple[str, int]] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:  # "<![...": never an error
        return self.parse_bogus_comment(i)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.tags, self.linked, self.containers[0][1] if self.containers else 0, self.heading))
        self.parts, self.tags, self.linked = [], 0, 0

    def unwanted(self, tag: str, attrs: list) -> bool:
        if tag in SKIPPED or tag == "header" and not self.containers:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        a = {k: (v or "").lower() for k, v in attrs}
        names = set(re.split(r"[^a-z0-9]+", a.get("class", "") + " " + a.get("id", "")))
        return (bool(names & NAMES) or a.get("role") in ROLES or "hidden" in a or a.get("aria-hidden") == "true"
                or "display:none" in a.get("style", "").replace(" ", ""))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skip:
            if self.skip in LEAF and tag in BLOCK:
                self.skip = None
            else:
                self.depth += tag == self.skip
                return
        if tag in BLOCK:
            self.flush()
            self.heading = tag in HEADINGS
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if self.unwanted(tag, attrs):
            self.skip, self.depth = tag, 1
        elif tag in ("article", "main"):
            self.made += 1
            self.containers.append((tag, self.made))
        elif tag == "a":
            self.links += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            self.depth -= tag == self.skip
            if not self.depth:
                self.skip = None
            return
        if tag in BLOCK:
            self.flush()
            self.heading = False
        self.tags += 1
        if tag == "a" and self.links:
            self.links -= 1
        elif tag in ("article", "main") and any(c[0] == tag for c in self.containers):
            while self.containers.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(ratios: list[float], radius: int = 2) -> list[float]:
    """Gaussian smoothing with a deviation of half the radius; the kernel is cut and normalised at the ends."""
    kernel = [math.exp(-2 * (d / radius) ** 2) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(ratios)):
        pairs = [(kernel[d + radius], ratios[i + d]) for d in range(-radius, radius + 1) if 0 <= i + d < len(ratios)]
        out.append(sum(w * r for w, r in pairs) / sum(w for w, _ in pairs))
    return out


def clustered(blocks: list[tuple[str, int, int, int, bool]], low: float = 0.1, gap: int = 3) -> tuple[list[int], list[int]]:
    """Numbers of the lines of the content cluster, from ratios alone, and of those whose own ratio reaches the core's threshold.

    Smoothed ratios over half their mean are its core. Around the core a lower threshold holds (``low`` of the first): a line
    next to a line of the cluster joins it if its smoothed ratio is over that, so it grows line by line and stops at the
    first line under it. Regions parted by at most ``gap`` lines are one. Headings join the line that follows. Lines
    that are mostly links never belong to it.
    """
    sharp = [max(0, len(t) - linked) / max(1, tags) for t, tags, linked, _, _ in blocks]
    ratios = smoothed(sharp)
    high = sum(ratios) / len(ratios) / 2
    plain = [2 * linked <= len(t) for t, _, linked, _, _ in blocks]
    own = [r >= high and p for r, p in zip(ratios, plain)]
    for order in (range(1, len(blocks)), range(len(blocks) - 2, -1, -1)):
        step = order.step
        for i in order:
            own[i] = own[i] or own[i - step] and plain[i] and ratios[i] >= low * high
    kept = [i for i, o in enumerate(own) if o]
    for a, b in zip(kept, kept[1:]):
        if b - a <= gap + 1:
            for i in range(a + 1, b):
                own[i] = plain[i]
    for i in range(len(blocks) - 2, -1, -1):
        own[i] = own[i] or own[i + 1] and blocks[i][4] and plain[i]
    kept = [i for i, o in enumerate(own) if o]
    return kept, [i for i in kept if sharp[i] >= high]


def main_text(html: str | None) -> str:
    """The main text; one line per block.

    Lines are the page's blocks outside parts that are no content by element, role or name. Each has a text-to-tag ratio (link
    text does not count); the cluster of smoothed ratios selects the content lines. Marked elements settle the lines that the ratios leave
    open: if most of the cluster lies in articles or main elements, each outermost one that holds a part of it stays with all
    that is nested in it, and the lines outside go; else the cluster is the result, but for articles without a line of a high
    ratio of its own (teasers).
    """
    parser = Events()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    blocks = parser.blocks
    if not blocks:
        return ""
    content, strong = clustered(blocks)
    weight = {marked: sum(len(blocks[i][0]) for i in content if bool(blocks[i][3]) == marked) for marked in (True, False)}
    if weight[True] and weight[True] >= weight[False]:
        held = {blocks[i][3] for i in content} - {0}
        return "\n".join(b[0] for b in blocks if b[3] in held)
    held = {0} | {blocks[i][3] for i in strong}
    return "\n".join(blocks[i][0] for i in content if blocks[i][3] in held)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, ``text`` and ``n_chars`` for every row; null or empty html gives the empty text. No shuffle."""
    rows = pages.select(*keep, F.col(html).alias("_html"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(len(keep))]
            columns = [*batch.columns[:len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(one, ", ".join([*fields, "text string", "n_chars long"]))
