"""Main text of web pages, by text-to-tag ratios of lines.

Events of the standard library's streaming parser turn a page into lines, one for each block
element, and a tree of the elements around them. A line's ratio is its characters outside links by
its tags. Ratios are smoothed by a Gaussian over the lines of the same container, and a threshold
between two clusters, PROSE at most, tells core lines from others. The smallest container around all
core lines bounds the regions that grow from them over neighbours of TEXTUAL or more, and end at
links and at boilerplate; so a page whose elements have no telling names has the same text. If most
of the region text lies in articles or main elements, these are the scope, else the smallest
container around all regions. Of the scope every part that holds region lines is kept whole, and so
is all other text between the first and the last region line.

Element names and words of class, id and role only mark leaves as boilerplate: an element that
holds the article, or most of the text, is none whatever it is called (see dead_nodes). A name counts
only if it says nothing else: related-posts is boilerplate, related-work and social-science are not.

Defined results: null or empty html, or a page with no text outside boilerplate, gives an empty
text with n_chars 0; a page with nothing but links gives these; a tag or reference cut off at the
end of the page is dropped or kept as text as HTML has it; bytes that are no UTF-8 become U+FFFD;
repeated pages give repeated rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, named

# Element names of HTML and the words by which class, id and role name boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
NO_TEXT = frozenset("script style noscript template title button select textarea iframe object svg math canvas audio video head".split())
ASIDE = frozenset("nav header footer aside dialog menu search".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer share sharing social related recommended toolbar pagination pager login search form complementary contentinfo".split()
)
COMMENTS = frozenset("comment comments commentlist commentary discussion disqus replies reply respond responses feedback talkback guestbook".split())
NEUTRAL = frozenset(
    "a an and the of for to in at by with box boxes block blocks container containers wrapper wrap outer inner area areas list lists item items link links bar bars panel pane column col row section sections group unit slot zone region content contents body text title top bottom left right center first last main primary secondary global local site page web post posts article articles story stories entry entries news more also read you your our us we button buttons btn icon icons image images img message msg form forms field input card cards small large big mobile desktop fixed sticky new old wide full js module component view template style class id google facebook twitter x email mail rss user users reader readers thread count tags tag author meta info policy privacy accept use site".split()
)
QUALIFIED = frozenset("no not non has have with without hide show is can enabled disabled open closed on off single".split())  # no-comments or has-sidebar name what is around
CONTAINERS = frozenset("div section td body blockquote main article".split())
PROSE, TEXTUAL = 60.0, 20.0  # characters a tag from which a line is core whatever the clusters are, and from which a region grows over it
GROUP, LOOSE = 3, 0.4  # lines of a container that make text beside it loose, and what the ratio of loose text is multiplied by
WRAPPER = 200  # characters that an element called boilerplate must hold at least to be taken for a wrapper without an article or a heading
PLAIN, BY_TAG, BY_NAME, BY_COMMENT = 0, 1, 2, 3
CLOSES_P = BLOCKS - {"html", "body", "head", "title"}
CUT_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
KERNEL = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
KERNEL /= KERNEL.sum()


def cue(tag: str, attrs: list) -> int:
    """How an element is called boilerplate, if it is."""
    if tag in ("html", "body"):
        return PLAIN
    out = BY_TAG if tag in ASIDE else BY_NAME if tag == "form" else PLAIN
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for token in value.split():
                words = {w.lower() for w in WORDS.findall(token)}
                if words & QUALIFIED:
                    continue
                if any(w not in NAMED and w not in COMMENTS and w not in NEUTRAL and not w.isdigit() for w in words):
                    continue
                if words & COMMENTS:
                    return BY_COMMENT
                if not out and words & NAMED:
                    out = BY_NAME
    return out


def concealed(attrs: list) -> bool:
    return any(name == "hidden" or (name == "style" and value and "display:none" in value.replace(" ", "").lower()) for name, value in attrs)


class Lines(HTMLParser):
    """A page as lines and a tree. lines: ([(node, in a link, data)], tags, node); of each node up, cue, whether it is an article or main, a first heading, and a container."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list, int, int]] = []
        self.up, self.cue, self.main, self.head, self.box = [0], [PLAIN], [False], [False], [True]
        self.cells: list[int] = []
        self.stack: list[tuple[str, int, bool]] = []
        self.parts: list[tuple[int, bool, str]] = []
        self.tags, self.link, self.hidden = 0, False, 0

    def node(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def flush(self) -> None:
        if any(not d.isspace() for _, _, d in self.parts):
            self.lines.append((self.parts, max(1, self.tags), self.node()))
        self.parts, self.tags, self.link = [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P and self.stack and self.stack[-1][0] == "p":
                self.pop()
            if tag == "body":
                while any(t == "head" for t, _, _ in self.stack):
                    self.pop()
            if tag == "li" and self.stack and self.stack[-1][0] == "li":
                self.pop()
        self.tags += 1
        self.link = self.link or tag == "a"
        if tag in VOID:
            if tag != "wbr" and self.parts:
                self.parts.append((self.node(), True, " "))
            return
        called, gone = cue(tag, attrs), tag in NO_TEXT or concealed(attrs)
        if tag in BLOCKS or called or gone:
            self.up.append(self.node())
            self.cue.append(called)
            self.main.append(tag in ("article", "main") or ("role", "main") in attrs or ("itemprop", "articleBody") in attrs)
            self.head.append(tag == "h1")
            self.box.append(tag in CONTAINERS or self.main[-1])
            if tag == "td":
                self.cells.append(len(self.up) - 1)
            self.stack.append((tag, len(self.up) - 1, gone))
            self.hidden += gone

    def pop(self) -> None:
        self.hidden -= self.stack.pop()[2]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        self.link = self.link and tag != "a"
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self.pop()
                break
            if tag not in BLOCKS and self.stack[k][0] in BLOCKS:  # an inline end tag doesn't leave its block
                break

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append((self.node(), self.link, data))


def parsed(html: str) -> Lines:
    html = CUT_TAG.sub("", html)
    for text in (html, html.replace("<![", "<!--")):
        page = Lines()
        try:
            page.feed(text)
            page.close()
            break
        except AssertionError:  # a malformed <![ section
            continue
    page.flush()
    parents = set(page.up[1:])
    for k in page.cells:  # a cell of data is no container, a cell of a layout is one
        page.box[k] = k in parents
    return page


def dead_nodes(page: Lines) -> list[bool]:
    """Of each element, whether it is boilerplate or lies in some.

    An element that is called so is spared where it holds the article or most of the text: free is
    the text outside all such elements (and inside spared ones). Comments are spared if nothing
    else is there, or only they hold an article; menus, headers, footers and the like by tag if
    only they hold an article; others also if they hold an article and more than what is free, or a
    first heading and more than half of that, or a text of WRAPPER characters and four times that.
    """
    n = len(page.up)
    own, up = [0] * n, page.up
    for parts, _, _ in page.lines:
        for node, link, data in parts:
            if not link:
                own[node] += len(data.strip())
    all_, free, comments, heads = own[:], own[:], [0] * n, [int(x) for x in page.head]
    mains = [int(m and c != BY_COMMENT) for m, c in zip(page.main, page.cue, strict=True)]
    free_mains = [int(m and not c) for m, c in zip(page.main, page.cue, strict=True)]
    for k in range(n - 1, 0, -1):
        all_[up[k]] += all_[k]
        comments[up[k]] += all_[k] if page.cue[k] == BY_COMMENT else comments[k]
        if page.cue[k] != BY_COMMENT:
            mains[up[k]] += mains[k]
            heads[up[k]] += heads[k]
        if not page.cue[k]:
            free[up[k]] += free[k]
            free_mains[up[k]] += free_mains[k]
    dead, outside, articles = [False] * n, free[0], free_mains[0]
    for k in range(1, n):
        called = page.cue[k]
        if dead[up[k]]:
            dead[k] = True
        elif called:
            held = all_[k] - comments[k]
            if called == BY_COMMENT:
                spared = not articles and (not outside or (mains[k] and 2 * held >= outside))
            elif called == BY_TAG:
                spared = mains[k] and not articles and 2 * held >= outside
            elif articles:
                spared = mains[k] > page.main[k] and held >= outside
            else:
                spared = (2 * held >= outside and held and (mains[k] or heads[k])) or (held > 4 * outside and held >= WRAPPER)
            if spared:
                outside += free[k]
                articles += free_mains[k] + (page.main[k] and not free_mains[k])
            dead[k] = not spared
    return dead


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian-weighted mean of each value and its neighbours."""
    if len(ratios) < 2:
        return ratios
    weight = np.convolve(np.ones(len(ratios)), KERNEL)[2:-2]
    return np.convolve(ratios, KERNEL)[2:-2] / weight


def threshold(values: np.ndarray) -> float:
    """Half way between the means of a low and a high cluster (two means, from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        above = values >= cut
        if above.all() or not above.any():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def smoothed_within(ratios: np.ndarray, box: np.ndarray) -> np.ndarray:
    """smoothed() over the lines of each container by themselves."""
    out = ratios.copy()
    for k in np.unique(box):
        some = np.flatnonzero(box == k)
        out[some] = smoothed(ratios[some])
    return out


def core_lines(ratios: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Which lines are core: smoothed above the threshold. ratios: 0 for links and boilerplate; box: the container of each line."""
    smooth = smoothed_within(ratios, box)
    return (smooth >= min(threshold(smooth), PROSE)) & (ratios > 0)


def regions(ratios: np.ndarray, box: np.ndarray, core: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Which lines are content: core lines, and their neighbours among the lines within as far as these are textual."""
    smooth = smoothed(ratios)
    grows = within & (smooth >= min(threshold(smoothed_within(ratios, box)), TEXTUAL)) & (ratios > 0)
    run = np.cumsum(np.concatenate(([True], grows[1:] != grows[:-1]))) if len(grows) else np.zeros(0, int)
    return core | (grows & np.isin(run, run[core & grows]))


def loose_lines(page: Lines, box: list[int], nodes: list[int], live: list[int]) -> np.ndarray:
    """Lines that are alone in a container without elements, beside a container of GROUP lines or more: so stand adverts and notices, not paragraphs."""
    n, parents = len(page.up), set(page.up[1:])
    size = [0] * n
    for i in live:
        size[nodes[i]] += 1
    for k in range(n - 1, 0, -1):
        size[page.up[k]] += size[k]
    beside = [False] * n
    for k in range(1, n):
        if page.box[k] and size[k] >= GROUP:
            beside[box[page.up[k]]] = True
    return np.array([page.box[k] and k not in parents and k > 0 and beside[box[page.up[k]]] for k in nodes])


def smallest_around(found: np.ndarray, nodes: list[int], box: list[int], page: Lines) -> int:
    """The innermost container that holds all the lines found."""
    count = [0] * len(page.up)
    for i in found:
        count[box[nodes[i]]] += 1
    for k in range(len(page.up) - 1, 0, -1):
        count[page.up[k]] += count[k]
    return max(k for k in range(len(page.up)) if count[k] == len(found) and page.box[k])


def main_text(html: str | None) -> str:
    page = parsed(html or "")
    dead, texts, ratios = dead_nodes(page), [], []
    for parts, tags, _ in page.lines:
        kept = [p for p in parts if not dead[p[0]]]
        texts.append(" ".join("".join(d for _, _, d in kept).split()))
        ratios.append(sum(len(d) for _, link, d in kept if not link and not d.isspace()) / tags if texts[-1] else 0.0)
    live = [i for i, t in enumerate(texts) if t]
    if not live:
        return ""
    plain, nodes = np.array(ratios), [line[2] for line in page.lines]
    n, up = len(page.up), page.up
    article, box = [0] * n, [0] * n
    for k in range(1, n):
        article[k] = article[up[k]] or (k if page.main[k] and not dead[k] else 0)
        box[k] = k if page.box[k] else box[up[k]]
    content = np.array([bool(t) for t in texts])
    if plain.any():
        of_line = np.array([box[k] for k in nodes])
        plain = np.where(loose_lines(page, box, nodes, live), plain * LOOSE, plain)
        core = core_lines(plain, of_line)
        if not core.any():
            return ""
        root = smallest_around(np.flatnonzero(core), nodes, box, page)
        under = [False] * n
        for k in range(root, n):
            under[k] = k == root or under[up[k]]
        content = regions(plain, of_line, core, np.array([under[k] for k in nodes]))
    found = np.flatnonzero(content)
    weight = np.array([len(t) for t in texts])
    inside = np.array([article[k] > 0 for k in nodes])
    if 2 * weight[content & inside].sum() >= weight[content].sum() > 0:
        spoken = {article[nodes[i]] for i in live if plain[i]} | {article[nodes[i]] for i in found}
        return "\n\n".join(texts[i] for i in live if inside[i] and article[nodes[i]] in spoken)
    root = smallest_around(found, nodes, box, page)
    part: list[int | None] = [None] * n
    for k in range(root, n):
        part[k] = root if k == root else None if part[up[k]] is None else k if part[up[k]] == root and page.box[k] else part[up[k]]
    of = [part[k] for k in nodes]
    chosen, speaking = {of[i] for i in found}, {of[i] for i in live if plain[i]}
    first, last = found[0], found[-1]
    return "\n\n".join(texts[i] for i in live if of[i] is not None and ((of[i] in chosen and (of[i] != root or plain[i] or first < i < last)) or (first < i < last and of[i] in speaking)))


def extract(df: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns keep of df (but those named like an output column), with text and n_chars."""
    keep, columns = carried(keep, ("text", "n_chars"))
    rows = df.select(*columns, F.make_valid_utf8(named(html_col).cast("string")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                texts = [main_text(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*part.schema.names[: len(keep)], "text", "n_chars"])

    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema).toDF(*keep, "text", "n_chars")
