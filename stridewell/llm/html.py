"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Elements that start a block, elements whose content is never text of the article, and void elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template head title iframe object embed svg math canvas audio video textarea select button input datalist map".split())
BOILERPLATE = frozenset("nav footer header aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind closes an open element of the second kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A start tag closes no element outside the innermost of these.
LISTS = ("ul", "ol", "dl", "table", "select", "menu")
#: Words in a class, an id or a role that name something other than the article.
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising|orial)?|sponsor(?:ed|s)?|promo(?:s|tion)?|banner|cookies?|consent|gdpr|notice|notices|popup|modal|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|header|masthead|comments?|commentlist|disqus|replies|respond|related|recommended|share|sharing|social|tags|tagcloud|pagination|pager|widget|toolbar|search|skip|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: Frequent words of English, German, French and Spanish.
STOP = frozenset(
    "the and of to in a is that it for was on are as with his they be at one have this from or had by not but what all were we when your can said there an if will how their which do "
    "der die das und ist nicht ein eine zu den von mit sich auf für im dem des auch es an als wie bei oder aus nach wird sind einer um am "
    "le la les de des du et un une est que qui dans en pour pas sur au avec par ce il elle ne se plus son sont aux ou "
    "el los las y que en del se un una por con para es su al lo como más no o pero sus ha".split()
)
SPACE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """Blocks of a page in order: [pieces of text, characters in links, boilerplate by markup, number of the article around it, heading].

    Each tag takes constant time, however deep it stands: `at` holds where in the stack each kind of element is open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int]] = []  # element, skipped, boilerplate, article
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[list] = []
        self.articles = 0
        self.fresh = True

    def nearest(self, tags: Iterable[str]) -> int:
        """Place in the stack of the innermost open element of these kinds; -1 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, place: int | None = None) -> None:
        """Closes the element at a place of the stack and all inside it; without a place, the page."""
        if place is None:
            super().close()
            return
        while len(self.open) > place:
            self.at[self.open.pop()[0]].pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.fresh = True
        if tag in CLOSES and (k := self.nearest(CLOSES[tag])) > self.nearest(LISTS):
            self.close(k)
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.close(len(self.open) - 1)
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        _, skipped, boiler, article = self.open[-1] if self.open else ("", False, False, 0)
        own = dict(attrs)
        if tag in ("article", "main") and not boiler and not article:
            self.articles += 1
            article = self.articles
        named = " ".join(str(own.get(k) or "") for k in ("class", "id", "role"))
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", str(own.get("style") or ""))
        if tag not in ("html", "body", "main") and (tag != "article" or self.at["article"]):
            boiler = boiler or (tag in BOILERPLATE and not (tag == "header" and article)) or bool(hidden) or bool(named.strip() and NAMES.search(named))
        self.at[tag].append(len(self.open))
        self.open.append((tag, skipped or tag in SKIPPED, boiler, article))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.fresh = True
        if self.at.get(tag):
            self.close(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        _, skipped, boiler, article = self.open[-1] if self.open else ("", False, False, 0)
        if skipped:
            return
        if self.fresh or not self.blocks:
            if not data.strip():
                return
            self.blocks.append([[], 0, boiler, article, self.nearest(HEADINGS) >= 0])
            self.fresh = False
        self.blocks[-1][0].append(data)
        if self.at["a"]:
            self.blocks[-1][1] += len(data.strip())


def decided(html: str, short: int = 70, long: int = 200, link_density: float = 0.2, stop_low: float = 0.05, stop_high: float = 0.15) -> list[tuple[str, bool, str]]:
    """text, whether it belongs to the article, and the rule that says so, of each block of a page.

    First pass, the same for all blocks: `markup` (bad: the element says navigation, footer, form, advert and the like),
    `outside` (bad: there are <article> or <main> elements, and this stands outside the outermost one with the most text, the first of
    equals), `links` (bad: link density is high, or a short block holds links), `stop words` (good: a block longer than `long`
    in which they are frequent; bad: a block longer than `short` with hardly any). Standing in an article is one vote: such a block may hold
    more links, and one with hardly any stop words is undecided. What is left is undecided: short blocks, headings, and those of middling
    length or frequency.

    Second pass, `neighbour`: undecided blocks take the label of the nearest block that its text has decided, the earlier of two at the same
    distance; headings look ahead first. Markup says nothing about neighbours. Where no text has decided, `alone`: blocks longer than `short`
    with some stop words are good, and if there are none, all undecided ones in an article, or those with some stop words.
    """
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    found = []
    for pieces, linked, boiler, article, heading in parser.blocks:
        text = SPACE.sub(" ", "".join(pieces)).strip()
        if text:
            words = [w.strip(".,;:!?\"'()[]%*#&$|").lower() for w in text.split()]
            found.append((text, linked / len(text), sum(w in STOP for w in words) / len(words), boiler, article, heading))
    sizes = Counter()
    for text, _, _, boiler, article, _ in found:
        sizes[article] += len(text) if article and not boiler else 0
    chosen = max(sizes, key=lambda k: (sizes[k], -k), default=0)
    inside = sizes[chosen] > 0

    def first(text: str, links: float, stop: float, boiler: bool, article: int, heading: bool) -> tuple[str, str]:
        size, vote = len(text), inside and article == chosen
        if boiler:
            return "bad", "markup"
        if inside and not vote:
            return "bad", "outside"
        if links > (0.9 if vote and size >= short else 0.5 if vote else link_density) or (links and size < short and not vote):
            return "bad", "links"
        if heading or size < short:
            return "", ""
        if stop >= stop_high and size > long:
            return "good", "stop words"
        return ("bad", "stop words") if stop < stop_low and not vote else ("", "")

    labels = [first(*x) for x in found]
    known = [i for i, (_, why) in enumerate(labels) if why in ("links", "stop words")]
    if not any(labels[i][0] == "good" for i in known):
        open_ = [i for i, (label, _) in enumerate(labels) if not label]
        most = [i for i in open_ if len(found[i][0]) >= short and not found[i][5] and found[i][2] >= stop_low]
        for i in most or [i for i in open_ if inside or (found[i][2] >= stop_low and not known)]:
            labels[i] = ("good", "alone")
        known = [i for i, (_, why) in enumerate(labels) if why in ("links", "stop words", "alone")]
    out, k = [], 0
    for i, (label, why) in enumerate(labels):
        while k < len(known) and known[k] < i:
            k += 1
        if not label:
            before, after = known[k - 1] if k else None, known[k] if k < len(known) else None
            ahead = after is not None and (before is None or found[i][5] or after - i < i - before)
            near = after if ahead else before
            label, why = "bad" if near is None else labels[near][0], "neighbour"
        out.append((found[i][0], label == "good", why))
    return out


def main_text(html: str | None, between: str = "\n\n", **rules) -> str:
    """The blocks of a page that belong to its article, by the rules of `decided`, joined by `between`. A null or empty page gives an empty text."""
    return between.join(text for text, good, _ in decided(html, **rules) if good) if html else ""


def extract(pages: DataFrame, **rules) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page, in one map over the table; other columns are ignored.

    Blocks are joined by two newlines. A null or empty html gives an empty text; repeated rows are pages of their own; an empty table gives an empty result.
    """
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, **rules) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
