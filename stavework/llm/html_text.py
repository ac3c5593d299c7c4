"""Main text of web pages by maximum-scoring subsequence.

A page is a row of tokens. Words score by how much more often words of their context (the blocks they stand in) are content than not;
tags score below zero, the more the less often they stand inside content. The contiguous run of tokens with the greatest
sum is the content region, found in one linear scan. Weights are log odds counted on labelled pages: pages that mark
their article themselves. Inside the region, blocks of contexts that are never content (menus, adverts, forms, comments) are left out.
Words of a class, id or role name such a context only where the element is not a wrapper of the page's text; a marking word
that is part of a longer name is evidence with a fitted weight.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

#: Labelled pages that weights are fitted on at most (those with the least hash of their key), and pseudo-counts.
SAMPLE, PRIOR = 2000, 4.0
#: Elements whose text is never main text, whatever the page.
DROPPED = frozenset("script style nav header footer aside form noscript template iframe svg button select textarea head title object canvas dialog menu".split())
#: Words in class, id or role that mark such parts.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent notice alert popup modal newsletter subscribe signup login share social related comment comments respond reply replies disqus pagination pager widget "
    "complementary contentinfo toolbar search".split()
)
#: Words in class or id of reader comments; one of them as a part of a word is enough.
COMMENTS = frozenset("comment comments respond reply replies disqus".split())
#: Elements that show where a page has its content; the first of each kind counts.
CONTENT = ("h1", "main", "article")
#: Elements that end the block they stand in; void elements; elements that HTML closes by itself before these.
BLOCKS = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements whose content is not HTML, or never text of the page; it is passed over as a whole.
RAW = frozenset("script style noscript template iframe textarea svg".split())
#: Elements that aren't HTML, which a slash at the end of their tag closes.
FOREIGN = frozenset(("svg", "math"))
_NAME = re.compile(r"</?[A-Za-z][A-Za-z0-9:-]*")
_ENDS = re.compile("[>\"']")
_CLOSES = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
#: Attributes one after another, each a name and perhaps a value; only whole names count.
_ATTRIBUTE = re.compile(r"([^\s=\"'>/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
#: Attributes that end in a slash which is no part of a value. It closes elements that aren't HTML; HTML elements ignore it.
_SLASH = re.compile(r"(?:^|[\s\"'])/$")


class _Scanner:
    """A page's texts and tags in one pass. What once was not found to the end of the page is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.quotes, self.cdata = page, True, True

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag; quoted values may hold others. Once a quote is left open, quotes no longer count."""
        page, i = self.page, at
        while self.quotes:
            m = _ENDS.search(page, i)
            if m and m[0] == ">":
                return m.start()
            if not m:
                self.quotes = False
                break
            before = m.start()
            while before > at and page[before - 1].isspace():
                before -= 1
            if page[before - 1] == "=":
                closing = page.find(m[0], m.end())
                if closing < 0:
                    self.quotes = False
                    break
                i = closing + 1
            else:
                i = m.end()
        return page.find(">", at)

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """("text", text, ""), ("open", tag, attributes) and ("close", tag, "")."""
        page, i, last = self.page, 0, self.page.rfind(">")
        while i < len(page):
            at = page.find("<", i)
            if at < 0 or at > last:
                yield "text", html.unescape(page[i:]), ""
                return
            if at > i:
                yield "text", html.unescape(page[i:at]), ""
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                i = end + 3 if end >= 0 else len(page)
                continue
            if self.cdata and page.startswith("<![CDATA[", at):
                end = page.find("]]>", at + 9)
                if end >= 0:
                    yield "text", page[at + 9 : end], ""
                    i = end + 3
                    continue
                self.cdata = False
            if page[at + 1 : at + 2] in ("!", "?"):
                i = page.find(">", at) + 1
                continue
            name = _NAME.match(page, at)
            end = self.tag_end(name.end()) if name else -1
            if end < 0:
                yield "text", "<", ""
                i = at + 1
                continue
            i = end + 1
            tag = name[0].lower().lstrip("</")
            if name[0][1] == "/":
                yield "close", tag, ""
                continue
            attributes = page[name.end() : end]
            if tag in RAW and not (tag in FOREIGN and _SLASH.search(attributes)):
                close = _CLOSES[tag].search(page, i)
                i = close.end() if close else len(page)
                continue
            yield "open", tag, attributes


def _drops(tag: str, attributes: str, inside: bool) -> tuple[int, str]:
    """2: the element's tag or a hidden attribute says that it is never main text; 3: a part of a word of its class or id says that it holds
    reader comments; 1: a word of its class, id or role says that it isn't main text (each of its parts does); 0: none of these. And a marking word that is only part of such a word: evidence that is weighed. The header of an
    article is a part of it."""
    if tag in DROPPED and not (tag == "header" and inside):
        return 2, ""
    marked, hint, seen = 0, "", set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name in seen:
            continue  # HTML takes the first of attributes with one name
        seen.add(name)
        if name == "hidden" or (name == "aria-hidden" and value.strip() == "true"):
            return 2, ""
        if name in ("class", "id", "role") and tag not in ("body", "html", "main") and (inside or tag != "article"):
            for word in value.split():
                parts = [x for x in re.split(r"[^a-z]+", word) if x]
                if name != "role" and not COMMENTS.isdisjoint(parts):
                    return 3, ""
                if tag == "article":
                    continue
                if parts and MARKED.issuperset(parts):
                    marked = 1
                hint = hint or next((x for x in parts if x in MARKED), "")
    return marked, "" if marked else hint


def tokens(page: str) -> list[tuple[str, str, str, bool, bool]]:
    """(kind, what, context, dropped, labelled) of every token: kind is "tag" or "text"; context names the innermost block, whether a
    link is open, and the innermost hint; dropped: inside a part that is never main text; labelled: inside an article or main element.

    An element that words of its class, id or role mark is a wrapper, and not dropped for them, if it holds more than half
    of the page's words: those in article and main elements if there are any, without what tags and hidden attributes drop. One
    marked as reader comments is a wrapper only if it holds the page's first h1, main or article element, however long it is.
    An article inside an article can be a comment; the outer one can't.
    Work and memory grow in proportion to the page: counts of open elements take the place of walks over them.
    """
    found: list[tuple[str, str, str, bool, bool, int]] = []
    open_: list[tuple[str, bool, int, str]] = []
    blocks: list[int] = []  # places of open blocks
    by_tag: Counter = Counter()
    dropping = 0
    # marked elements: the marked one around each, and their words, outside and inside article and main; 0 is the page
    around, words = [0], [[0, 0]]
    comments, holds, seen = {}, set(), set()  # marked elements of comments, those that hold content, and kinds of content seen

    def close_to(at: int) -> None:
        nonlocal dropping
        while len(open_) > at:
            tag, drops, _, _ = open_.pop()
            by_tag[tag] -= 1
            dropping -= drops
        while blocks and blocks[-1] >= at:
            blocks.pop()

    for kind, what, attributes in _Scanner(page):
        inside, (marked, hint) = bool(by_tag["article"] or by_tag["main"]), open_[-1][2:] if open_ else (0, "")
        block = open_[blocks[-1]][0] if blocks else ""
        if kind == "text":
            if not dropping:
                words[marked][inside] += len(what.split())
            found.append(("text", what, block + (">a" if by_tag["a"] else "") + (f"~{hint}" if hint else ""), dropping > 0, inside, marked))
            continue
        if kind == "close":
            found.append(("tag", "/" + what, "", dropping > 0, inside, marked))
            if by_tag[what]:
                at = len(open_) - 1
                while open_[at][0] != what:
                    at -= 1
                close_to(at)
            continue
        while blocks and what in ENDED_BY.get(open_[blocks[-1]][0], ()):
            close_to(blocks[-1])
        inside, (marked, hint) = bool(by_tag["article"] or by_tag["main"]), open_[-1][2:] if open_ else (0, "")
        own, own_hint = _drops(what, attributes, inside)
        if own in (1, 3):
            around.append(marked)
            words.append([0, 0])
            marked = len(around) - 1
            comments[marked] = own == 3
        if what in CONTENT and what not in seen and own not in (2, 3) and not dropping:
            seen.add(what)
            holder = marked
            while holder:
                holds.add(holder)
                holder = around[holder]
        found.append(("tag", what, "", dropping > 0 or own == 2, inside, marked))
        if what not in VOID and not (what in FOREIGN and _SLASH.search(attributes)):
            open_.append((what, own == 2, marked, own_hint or hint))
            by_tag[what] += 1
            dropping += own == 2
            if what in BLOCKS:
                blocks.append(len(open_) - 1)
    for i in range(len(around) - 1, 0, -1):  # an element comes after those around it
        for j in (0, 1):
            words[around[i]][j] += words[i][j]
    page_words = [sum(words[0]), words[0][1]]
    gone = [False]
    for i in range(1, len(around)):
        if comments[i]:
            wrapper = i in holds
        else:
            wrapper = 2 * words[i][1] > page_words[1] if page_words[1] else 2 * sum(words[i]) > page_words[0]
        gone.append(gone[around[i]] or not wrapper)
    return [(kind, what, context, dropped or gone[marked], inside) for kind, what, context, dropped, inside, marked in found]


def count_page(page: str) -> Counter:
    """Counts of (kind, tag or context, dropped, in content) of a labelled page; an unlabelled page counts nothing."""
    seen = tokens(page)
    if not any(x[4] for x in seen):
        return Counter()
    out: Counter = Counter()
    for kind, what, context, dropped, labelled in seen:
        n = 1 if kind == "tag" else len(what.split())
        if n:
            out[kind, what if kind == "tag" else context, dropped, labelled and not dropped] += n
    return out


class Weights:
    """Scores from counts of labelled pages. Words never score above 1 or below -4, tags between -6 and -0.1."""

    def __init__(self, counts: dict[tuple[str, str, bool, bool], int]) -> None:
        self.known: dict[tuple[str, str, bool], float] = {}
        pairs: dict[tuple[str, str, bool], list[int]] = {}
        for (kind, what, dropped, inside), n in counts.items():
            pairs.setdefault((kind, what, dropped), [0, 0])[inside] += n
        for k, (out, inside) in pairs.items():
            odds = math.log((inside + self.prior(k)[1]) / (out + self.prior(k)[0]))
            self.known[k] = max(-4.0, min(1.0, odds)) if k[0] == "text" else max(-6.0, min(-0.1, odds - 2.0))

    @staticmethod
    def prior(key: tuple[str, str, bool]) -> tuple[float, float]:
        """Pseudo-counts (outside, inside): links and what is marked lean out, text of blocks leans in."""
        kind, what, dropped = key
        if dropped:
            return PRIOR * 50, PRIOR / 50
        return (PRIOR * 4, PRIOR) if ">a" in what or kind == "tag" else (PRIOR, PRIOR * 4)

    def score(self, kind: str, what: str, dropped: bool) -> float:
        found = self.known.get((kind, what, dropped))
        if found is None and "~" in what:
            return self.score(kind, what.partition("~")[0], dropped)  # a hint not seen on labelled pages says nothing
        if found is None:
            out, inside = self.prior((kind, what, dropped))
            found = math.log(inside / out)
            found = max(-4.0, min(1.0, found)) if kind == "text" else -0.3  # a tag not seen on labelled pages
        return found


def extract(page: str | None, weights: Weights) -> str:
    """The main text: blocks of the region with the greatest score, two newlines between."""
    items = tokens(page or "")
    best, start, here, region = 0.0, 0, 0.0, (0, 0)
    inside = any(x[4] for x in items)
    for i, (kind, what, context, dropped, labelled) in enumerate(items):
        if dropped:
            gain = -0.1 if kind == "tag" else 0.0  # left out wherever the region lies; it should not cut an article in two
        elif kind == "tag":
            gain = weights.score("tag", what, dropped)
            if inside and labelled:
                gain = max(gain, -0.1)  # the page says that its content goes on here
        else:
            gain = len(what.split()) * weights.score("text", context, dropped)
            if inside and not labelled:
                gain = min(gain, -abs(gain))
        here += gain
        if here <= 0:
            here, start = 0.0, i + 1
        elif here > best:
            best, region = here, (start, i + 1)
    blocks, parts = [], []
    for kind, what, _, dropped, _ in [*items[region[0] : region[1]], ("tag", "p", "", False, False)]:
        if kind == "text":
            if not dropped:
                parts.append(what)
        elif what.lstrip("/") in BLOCKS and what != "br":
            text = _SPACE.sub(" ", "".join(parts)).strip(" ")
            if text:
                blocks.append(text)
            parts = []
        elif what == "br":
            parts.append(" ")
    return "\n\n".join(blocks)


def fit(pages: DataFrame, key: str = "page_id", text: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from at most sample pages: labelled ones, those with the least hash of key and text, equal rows once. Pages are counted in tasks.
    Keys may be null or repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for page in b.column("t").to_pylist():
                total.update(count_page(page))
        rows = [(*k, n) for k, n in total.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "what", "dropped", "inside", "n"), r, strict=True)) for r in rows], schema)

    schema = pa.schema([("kind", pa.string()), ("what", pa.string()), ("dropped", pa.bool_()), ("inside", pa.bool_()), ("n", pa.int64())])
    labelled = pages.select(F.xxhash64(key, text).alias("h"), F.col(text).alias("t")).where(F.col("t").rlike("(?i)<(article|main)\\b"))
    # hashes first: pages themselves don't meet in one task, and the greatest hash taken says which pages are
    taken = labelled.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = labelled.where(F.col("h") <= F.lit(taken)).groupBy("h").agg(F.any_value("t").alias("t")).select("t")
    counts = chosen.mapInArrow(run, "kind string, what string, dropped boolean, inside boolean, n long").groupBy("kind", "what", "dropped", "inside").agg(F.sum("n").alias("n")).collect()
    return Weights({(r["kind"], r["what"], r["dropped"], r["inside"]): r["n"] for r in counts})


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """One row per row of pages: key, url, text, n_chars. Null and empty pages give the empty text.

    Null and repeated keys are kept as they come. A page without any tag is one block. Other columns are dropped.
    """
    weights = pages.sparkSession.sparkContext.broadcast(fit(pages, key, text))
    kind, kind_url = (pages.schema[c].dataType.simpleString() for c in (key, url))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "t", 4_000_000):
            found = [extract(page, weights.value) for page in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("u"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["k", "u", "text", "n_chars"])

    out = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, u {kind_url}, text string, n_chars long")
    return out.withColumnRenamed("k", key).withColumnRenamed("u", url)
