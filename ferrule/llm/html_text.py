"""Main text of web pages (operator 7).

The standard library's parser is fed a piece at a time; its events give lines (runs of
text between block tags) with their text-to-tag ratio. The ratios are smoothed by a
Gaussian and split by a threshold into two clusters. The lines of the upper cluster
choose the content: a section of the page is content if it has such a line, or if it lies
in the article or main element that has most of them. Tags, roles and words of class and
id only veto inside: menus, forms, adverts, comments and the like. A veto that would
leave next to nothing of the chosen lines (a form or a `sidebar-left` around
the whole page) isn't heeded.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import small_batches

#: Fixed lists of HTML names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without text of the page; elements that aren't the article, unless they hold all of it (of these, NEVER).
SILENT = frozenset("head script style noscript template svg math textarea select iframe object canvas audio video map".split())
ASIDE = frozenset("nav footer aside form button input dialog menu fieldset".split())
NEVER = frozenset("nav footer button input menu".split())
SECTIONS = frozenset("article main section div td th body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table tbody thead div article section main body".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Parts of a word of class or id that mark what is no article text, such that take this back, and words that mark an article.
NOISE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice popup modal overlay sidebar side widget widgets menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments disqus respond replies share sharing social related recommended newsletter subscribe signup login search pagination pager tags toolbar skip".split())
BUT = frozenset("with no has without not".split())
GOOD = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|text|body)(?:$|[\s_-])", re.I)
#: Width of the smoothing in lines.
SIGMA = 1.0
#: Logarithm of the factor by which the clusters' ratios differ at least; characters a tag that are content whatever the rest of the page.
APART, PLENTY = 0.7, 50.0
#: Shares of the chosen text: an article or main element with this much is the content, regions marked by words
#: with this much are, and vetoes must leave this much. A list of links has so many items.
REAL_SHARE, MARKED_SHARE, LEFT, LINKS = 0.6, 0.8, 0.1, 3
_PIECE = 1 << 16


def is_noise(value: str) -> bool:
    """Whether a word of a class or id attribute begins or ends with a part that marks noise."""
    for word in value.lower().split():
        parts = [x for x in re.split(r"[_-]+", word) if x]
        if parts and (parts[0] in NOISE or parts[-1] in NOISE) and not BUT & set(parts):
            return True
    return False


class _Lines(HTMLParser):
    """Collects lines [pieces, tags, element, link characters] and what is known of each element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents, self.tags, self.marked, self.vetoed, self.blocks = [-1], ["#"], [False], [False], [True]
        self.open: list[tuple[str, int, bool]] = [("#", 0, False)]
        self.lines: list[list] = []
        self.pieces: list[str] = []
        self.count, self.links, self.in_link = 0, 0, 0

    def flush(self) -> None:
        if self.pieces:
            _, element, silent = self.open[-1]
            if not silent:
                self.lines.append([self.pieces, self.count, element, self.links])
                self.count = 0
            self.pieces, self.links = [], 0

    def _hidden(self, attrs: list) -> bool:
        return any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none", v or "", re.I) for k, v in attrs)

    def _vetoes(self, tag: str, attrs: list) -> bool:
        if tag in ASIDE or tag == "header" and not any(t in ("article", "main") for t, _, _ in self.open):
            return True
        for key, value in attrs:
            value = value or ""
            if key == "role" and value.lower() in ROLES:
                return True
            if key in ("class", "id") and tag not in ("body", "html", "article", "main") and is_noise(value):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.count += 1
        if tag == "br":
            self.pieces.append("\n")
        if tag == "a":
            self.in_link += 1
        if tag in INLINE and not (attrs and (self._vetoes(tag, attrs) or self._hidden(attrs)) and tag != "a"):
            return
        self.flush()
        if tag == "body" and any(t == "head" for t, _, _ in self.open):
            self._close("head")
        if tag != "p" and tag not in CLOSES and self.open[-1][0] == "p" or tag == "p" and self.open[-1][0] == "p":
            self.open.pop()
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.open[depth][0]
            if name in CLOSES.get(tag, ()):
                del self.open[depth:]
                break
            if name in STOPS:
                break
        if tag in VOID:
            return
        element = len(self.parents)
        self.parents.append(self.open[-1][1])
        self.tags.append(tag)
        self.vetoed.append(self._vetoes(tag, attrs))
        self.blocks.append(False)
        if tag not in INLINE:
            self.blocks[self.open[-1][1]] = True
        self.marked.append(tag in ("article", "main") or any(k in ("class", "id", "itemprop") and GOOD.search(v or "") or k == "role" and v in ("main", "article") for k, v in attrs))
        self.open.append((tag, element, self.open[-1][2] or tag in SILENT or self._hidden(attrs)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)

    def _close(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_endtag(self, tag: str) -> None:
        self.count += 1
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag in INLINE and not any(t == tag for t, _, _ in self.open):
            return
        self.flush()
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        if self.in_link:
            self.links += len(data.strip())


def _upper_cluster(values: np.ndarray) -> np.ndarray:
    """Two-means on one dimension; all of it where the two means are near each other, and all beyond PLENTY."""
    low, high = float(values.min()), float(values.max())
    if high <= low:
        return np.ones(len(values), dtype=bool)
    for _ in range(20):
        cut = (low + high) / 2
        upper = values > cut
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    if high - low < APART:
        return np.ones(len(values), dtype=bool)
    return values > min((low + high) / 2, float(np.log1p(PLENTY)))


def _chosen(lengths: np.ndarray, tags: np.ndarray, vetoed: np.ndarray) -> np.ndarray:
    """The lines of the upper cluster of smoothed text-to-tag ratios; those vetoed count as empty."""
    ratio = np.log1p(np.where(vetoed, 0.0, lengths / np.maximum(1, tags)))
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    smooth = (np.convolve(ratio, kernel)[3:-3]) / np.convolve(np.ones(len(ratio)), kernel)[3:-3]
    upper = _upper_cluster(smooth) & ~vetoed
    return upper if upper.any() else ~vetoed


class _Page:
    """The elements of a page and its lines of text."""

    def __init__(self, parser: _Lines):
        lines = [(" ".join("".join(pieces).split()), tags, element, links) for pieces, tags, element, links in parser.lines]
        lines = [x for x in lines if x[0]]
        self.texts = [x[0] for x in lines]
        self.lengths, self.line_tags, self.at, self.links = (np.array([len(x[0]) if k == 0 else x[k] for x in lines], dtype=np.int64) for k in range(4))
        self.parents, self.tags, self.marked = np.array(parser.parents), parser.tags, np.array(parser.marked)
        self.own_veto, self.blocks = np.array(parser.vetoed), parser.blocks

    def under(self, which: np.ndarray) -> np.ndarray:
        """The elements at or below one of these."""
        out = which.copy()
        for element in range(1, len(out)):  # children come after their parents
            out[element] |= out[self.parents[element]]
        return out

    def outermost(self, which: np.ndarray) -> np.ndarray:
        below = self.under(which)
        return which & ~np.array([p >= 0 and below[p] for p in self.parents])

    def votes(self, chosen: np.ndarray) -> np.ndarray:
        """For each element, how much text of the chosen lines it holds."""
        out = np.zeros(len(self.parents), dtype=np.int64)
        np.add.at(out, self.at[chosen], self.lengths[chosen])
        for element in range(len(out) - 1, 0, -1):
            out[self.parents[element]] += out[element]
        return out

    def vetoes(self) -> np.ndarray:
        """Lines that are vetoed, after sparing the elements that hold nearly all that would be chosen."""
        own = self.own_veto.copy()
        real = self.under(np.array([t in ("article", "main") for t in self.tags]))
        if (real & ~self.under(own))[self.at].any():
            return self.under(own)[self.at]
        wraps = np.array([t not in NEVER for t in self.tags])
        all_votes = self.votes(_chosen(self.lengths, self.line_tags, np.zeros(len(self.at), dtype=bool)))
        while own.any():
            vetoed = self.under(own)
            outer = self.outermost(own)
            most = int(np.argmax(np.where(outer & wraps, all_votes, -1)))
            if all_votes[0] - all_votes[outer].sum() >= LEFT * all_votes[0] or not (outer & wraps)[most]:
                return vetoed[self.at]
            own[most] = False
        return np.zeros(len(self.at), dtype=bool)

    def section(self, element: int) -> int:
        """The nearest part of the page that holds blocks (a cell of mere text is part of its table)."""
        while element > 0 and not (self.tags[element] in SECTIONS and (self.tags[element] not in ("td", "th") or self.blocks[element])):
            element = int(self.parents[element])
        return element

    def menus(self) -> np.ndarray:
        """Lines in a list of nothing but links."""
        of = self.at.copy()
        for i, element in enumerate(self.at.tolist()):
            while element > 0 and self.tags[element] not in ("ul", "ol"):
                element = int(self.parents[element])
            of[i] = element
        plain = self.lengths - np.array([t.count(" ") for t in self.texts], dtype=np.int64)
        lists, which = np.unique(of, return_inverse=True)
        items = np.bincount(which)
        menu = (lists > 0) & (items >= LINKS) & (np.bincount(which, weights=self.links >= plain) == items)
        return menu[which]

    def content(self) -> np.ndarray:
        """Lines of the article."""
        vetoed = self.vetoes()
        chosen = _chosen(self.lengths, self.line_tags, vetoed)
        votes = self.votes(chosen)
        real = np.array([t in ("article", "main") for t in self.tags])
        of_real = self.outermost(real & (votes >= REAL_SHARE * max(1, votes[0])))
        if of_real.any():
            return self.under(of_real)[self.at] & ~vetoed
        marked = self.outermost(self.marked & (votes > 0) & ~np.array([t in ("body", "html", "#") for t in self.tags]))
        region = self.under(marked) if votes[marked].sum() >= MARKED_SHARE * votes[0] else np.zeros(len(votes), dtype=bool)
        inside = region[self.at] if region.any() else np.ones(len(self.at), dtype=bool)
        chosen &= inside
        sections = [self.section(e) for e in self.at.tolist()]
        with_content = {s for s, c in zip(sections, chosen.tolist(), strict=True) if c}
        for section in list(with_content):  # in a marked region, also what stands around its sections
            while region[section]:
                with_content.add(section)
                section = int(self.parents[section])
        keep = np.array([s in with_content for s in sections]) & inside & ~vetoed
        if chosen.any():
            # lists of links around the chosen lines are menus; those between them are the article's
            first, last = np.flatnonzero(chosen)[[0, -1]]
            place = np.arange(len(keep))
            keep &= ~(self.menus() & ((place < first) | (place > last)))
        for i in range(len(keep) - 2, -1, -1):  # a heading belongs to what follows it
            if self.tags[self.at[i]] in HEADINGS and not vetoed[i] and inside[i] and keep[i + 1]:
                keep[i] = True
        return keep


def main_text(html: str | None) -> str:
    """The article's text; empty if there is none."""
    if not html:
        return ""
    parser = _Lines()
    for start in range(0, len(html), _PIECE):
        parser.feed(html[start : start + _PIECE])
    parser.close()
    parser.flush()
    page = _Page(parser)
    if not page.texts:
        return ""
    return " ".join(t for t, kept in zip(page.texts, page.content().tolist(), strict=True) if kept)


def html_extraction(pages: DataFrame) -> DataFrame:
    """Operator 7: page_id, url, text, n_chars of every page's whole html.

    Null and empty html gives the empty text; repeated rows give repeated rows; an
    empty table gives no rows; other columns are ignored.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
