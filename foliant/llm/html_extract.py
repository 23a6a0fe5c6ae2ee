"""Main-text extraction from HTML by tree scoring.

A page is read once, in linear time and without recursion, into a tree of nodes. Parts that are never the article go at
once with all below them: scripts, styles, forms, navigation, footers, asides, the page's own header, and boxes whose
class, id or role names a menu, advert, notice, sidebar, share box or comment list. A name speaks against a box only if
all its words are of that kind ("related-posts", not "related-work"; "has-sidebar" and the like name none); ids of
sections, paragraphs and headings are anchors and need a plainer name; headings and code are never judged by name. Where
names take nearly all of a page's text, it is read again without regard to them.

Every remaining block of text passes points to its container: one, one more per comma, one per 100 characters of it that
are no link; every further ancestor gets half of what the one below it got. A container's score is discounted by its
link density and raised for article-like names. The best container (the whole ``article`` where it lies in one) is kept
with all other containers of prose that score near it, wherever they stand, with the headings and paragraphs between
them, and with those siblings that are paragraphs of prose or headings; inside, boxes of short links go. Text comes out
by block: character references decoded, white space as one space, blocks joined by \n.

Defined results: null, empty or text-free html gives an empty string and 0; html without tags is one block; "<" before
anything but a letter, "/", "!" or "?" is text; a quote that is never closed ends with its tag; an unclosed comment,
script or tag hides the rest, as browsers have it; formulas keep their text, drawings that of their ``text`` elements; a
null page_id or url is passed on; repeated rows are pages of their own. No text of the article is dropped or capped.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import small_batches, table

MARK = re.compile(r"<(?=[a-zA-Z!?/])")
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag up to its ">"; possessive throughout, so that no input makes it go back.
INSIDE = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|["'])*+""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
RAW = frozenset({"script", "style", "textarea", "title", "noscript", "template", "iframe", "object", "noframes", "desc", "metadata", "defs", "symbol", "annotation", "annotation-xml"})
#: Of those, the ones that hide their content only inside a drawing or formula.
FOREIGN_RAW = frozenset({"desc", "metadata", "defs", "symbol", "annotation", "annotation-xml"})
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
VOID = frozenset({"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"})
DROPPED = frozenset({"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "canvas", "audio", "video", "label"})
INLINE = frozenset({"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "math", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "wbr", "img", "br", "nobr"})
FOREIGN = frozenset({"math", "svg"})
#: What a start tag closes if it is open, and the elements across which it doesn't look.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
KEPT = frozenset({"html", "body", "main", "pre", "code"}) | HEADINGS
PROSE = frozenset({"p", "pre", "blockquote", "td", "th", "li", "dd", "dt", "figcaption", "caption"}) | HEADINGS
BOXES = frozenset({"ul", "ol", "dl", "div", "table", "section", "header"})
#: Elements that are too small a container by themselves.
PARTS = frozenset({"li", "dd", "dt", "p", "pre", "blockquote", "figcaption", "caption", "figure", "tr", "tbody", "thead", "tfoot"}) | HEADINGS
#: Elements whose id is an anchor in the text.
ANCHORED = frozenset({"section", "p", "li", "dd", "dt", "blockquote", "td", "th", "tr", "table", "figure", "figcaption", "article"})
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense outbrain taboola sponsored comment comments commentlist disqus "
    "sidebar navbar breadcrumb breadcrumbs newsletter pagination pager contentinfo masthead skiplink submenu".split()
)
NEVER = STRONG | frozenset(
    "sponsor sponsors promo promos promotion promoted cookie cookies consent gdpr respond reply replies discussion rail widget widgets menu nav navigation "
    "footer foot share sharing social related recommended recommendations subscribe subscription signup login popup modal overlay toolbar copyright "
    "complementary search skip topbar toc notice notices notification notifications alert alerts disclaimer legal dialog".split()
)
#: Names of a page's header, unless it stands in the article.
HEADERS = frozenset("header head banner".split())
GOOD = frozenset("article post entry content main story body text blog page column hentry prose".split())
#: Words that say nothing about what a box holds.
FRAME = GOOD | HEADERS | frozenset(
    "box boxes list area section wrapper wrap container block unit slot inner outer top bottom left right articles posts stories links link item items "
    "group panel pane bar bars button buttons title heading icon icons row col columns region zone module component holder form input field primary "
    "secondary site global mobile desktop sticky fixed inline more you may like also read reading next previous prev latest popular trending recent new "
    "see our the us thread count counter center full width large small first last".split()
)
#: Words after which the rest of a name tells what the page has or lacks, not what the element is.
ABOUT = frozenset("has no with without".split())
#: A result shorter than this, and than a quarter of the text that went by name, is held against one without names.
LITTLE = 250
BONUS = {"article": 40.0, "main": 30.0}
#: Links of a list or box are a menu if they are shorter than this on average.
SHORT_LINK = 40


def names_in(value: str) -> Iterator[list[str]]:
    """The words of each name in a class, id or role."""
    for token in value.split():
        words = []
        for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", token):
            if x.lower() in ABOUT:
                break
            words.append(x.lower())
        if words:
            yield words


class Element:
    """What a start tag says of its element: hidden, names against it, names for it."""

    __slots__ = ("hidden", "bad", "good", "banner")

    def __init__(self, tag: str, attributes: str) -> None:
        self.hidden = self.bad = self.good = self.banner = False
        if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
            return
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden":
                self.hidden |= value.lower() != "until-found"
            elif name == "aria-hidden":
                self.hidden |= value.lower() == "true"
            elif name in ("class", "id", "role"):
                for words in names_in(value):
                    self.good |= not GOOD.isdisjoint(words)
                    against, known = [w for w in words if w in NEVER], all(w in NEVER or w in FRAME for w in words)
                    if tag in INLINE:
                        self.bad |= bool(against) and known and any(w in STRONG and w[:7] != "comment" for w in against)
                    elif name == "id" and tag in ANCHORED:
                        self.bad |= bool(against) and known and tag in ("section", "article") and (len(words) > 1 or words[0] in STRONG)
                    elif tag == "article":
                        self.bad |= bool(against) and known and any(w in STRONG or w in ("reply", "replies", "promo", "promoted", "sponsor") for w in against)
                    else:
                        self.bad |= bool(against) and (known or any(w in STRONG for w in against))
                    self.banner |= not HEADERS.isdisjoint(words) and known and name != "role" or words == ["banner"]


class Page:
    """Nodes in page order: tag, parent, last node below; blocks of text with the node that owns them."""

    def __init__(self, html: str, names: bool = True) -> None:
        self.names, self.lost = names, 0  # lost: characters that went by name
        self.tag, self.up, self.good = ["html"], [-1], [False]
        self.blocks: list[tuple[int, str, int]] = []  # owner, text, characters of it in links
        self.read(html)

    def read(self, html: str) -> None:
        named = False
        stack, drop, links, foreign = [0], 0, 0, 0  # drop: depth in the stack from which everything is unwanted; links, foreign: how many are open
        opened: Counter[str] = Counter()  # open elements by tag
        parts: list[str] = []
        linked = at = 0
        tag, up, good = self.tag, self.up, self.good

        def owner() -> int:
            return next((n for n in reversed(stack) if tag[n] not in INLINE), 0)

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((owner(), text, min(linked, len(text))))
                parts.clear()
            linked = 0

        def say(text: str) -> None:
            nonlocal linked
            if drop and named:
                self.lost += len(text.strip())
            if text and not drop:
                if opened["svg"] and not opened["text"] and not opened["foreignobject"]:
                    return
                text = entities.unescape(text)
                parts.append(text)
                if links:
                    linked += len(text.strip())

        def pop_to(depth: int) -> None:
            nonlocal drop, links, foreign
            gone = [tag[n] for n in stack[depth:]]
            if any(t not in INLINE for t in gone):
                flush()
            for t in gone:
                opened[t] -= 1
                links -= t == "a"
                foreign -= t in FOREIGN
            del stack[depth:]
            if drop and len(stack) < drop:
                drop = 0

        while True:
            m = MARK.search(html, at)
            if m is None:
                say(html[at:])
                break
            say(html[at : m.start()])
            at = m.start()
            head = OPEN.match(html, at)
            if head is None:  # a comment, declaration or something like them
                if html.startswith("<!--", at):
                    if html.startswith((">", "->"), at + 4):
                        end = html.index(">", at + 4) + 1
                    else:
                        found = re.compile(r"--!?>").search(html, at + 4)
                        end = found.end() if found else len(html)
                elif html.startswith("<![CDATA[", at):
                    stop = html.find("]]>", at)
                    say(entities.escape(html[at + 9 : stop if stop >= 0 else len(html)]))
                    end = stop + 3 if stop >= 0 else len(html)
                else:
                    end = html.find(">", at) + 1 or len(html)
                at = end
                continue
            name = head[2].lower()
            stop = INSIDE.match(html, head.end()).end()
            if stop >= len(html):
                break
            attributes, at = html[head.end() : stop], stop + 1
            if head[1]:
                if name == "p" and not opened["p"]:
                    flush()
                if opened[name]:
                    for depth in range(len(stack) - 1, 0, -1):
                        if tag[stack[depth]] == name:
                            pop_to(depth)
                            break
                        if tag[stack[depth]] in ("table", "td", "th") and name in INLINE:
                            break
                continue
            if name in ("html", "body"):
                if name == "body":
                    if len(stack) > 1 and tag[stack[1]] == "head":
                        pop_to(1)
                    good[0] |= Element(name, attributes).good
                continue
            if name == "br" or name == "wbr":
                say(" " if name == "br" else "")
                continue
            inline = name in INLINE or foreign and name not in ("text", "foreignobject")
            if not inline:
                for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    t = tag[stack[depth]]
                    if t == "p":
                        pop_to(depth)
                        break
                    if t not in INLINE:
                        break
                if name in CLOSES:
                    ends, walls = CLOSES[name]
                    if any(opened[t] for t in ends):
                        for depth in range(len(stack) - 1, 0, -1):
                            if tag[stack[depth]] in ends:
                                pop_to(depth)
                                break
                            if tag[stack[depth]] in walls:
                                break
                if stack[-1] and tag[stack[-1]] == "head" and name not in RAW and name not in VOID:
                    pop_to(len(stack) - 1)
                flush()
            if name in VOID:
                continue
            if name in RAW and (foreign or name not in FOREIGN_RAW):
                if attributes.endswith("/") and foreign:
                    continue
                end = RAW_END[name].search(html, at)
                at = html.find(">", end.end()) + 1 or len(html) if end else len(html)
                continue
            if foreign and attributes.endswith("/"):
                continue
            bad = fine = by_name = False
            if not drop:
                own = Element(name, attributes)
                inside = opened["article"] or opened["main"]
                fine, bad = own.good, name in DROPPED or own.hidden and name not in ("html", "body", "main", "article")
                if not bad and self.names and name not in KEPT and not opened["pre"] and not opened["code"]:
                    banner = not inside and (name == "header" and not opened["section"] or own.banner)
                    bad = by_name = own.bad or banner
            if bad and inline and not parts:
                flush()
            tag.append(name if not foreign or name in ("text", "foreignobject") else "span")
            up.append(stack[-1])
            good.append(fine)
            stack.append(len(tag) - 1)
            opened[tag[-1]] += 1
            links += name == "a"
            foreign += name in FOREIGN and tag[-1] == name
            if bad:
                drop, named = len(stack), by_name
            if attributes.endswith("/") and (name in FOREIGN or not inline and name not in ("p", "div")):
                pop_to(len(stack) - 1)
        pop_to(1)
        flush()

    def main_text(self) -> str:
        tag, up, n = self.tag, self.up, len(self.tag)
        if not self.blocks:
            return ""
        own, size, link, count, last = [0.0] * n, [0] * n, [0] * n, [0] * n, list(range(n))
        for owner, text, linked in self.blocks:
            size[owner] += len(text)
            link[owner] += linked
            count[owner] += 1
            points = (1 + text.count(",") + text.count("，") + len(text) / 100) * (1 - linked / len(text))
            own[up[owner] if tag[owner] in PROSE and up[owner] >= 0 else owner] += points / 4 if tag[owner] in HEADINGS else points
        score = list(own)
        for i in range(n - 1, 0, -1):
            size[up[i]] += size[i]
            link[up[i]] += link[i]
            count[up[i]] += count[i]
            score[up[i]] += score[i] / 2
            last[up[i]] = max(last[up[i]], last[i])
        plain = [1 - link[i] / max(size[i], 1) for i in range(n)]
        score = [(s + BONUS.get(tag[i], 0.0) + 15.0 * self.good[i]) * plain[i] if s else 0.0 for i, s in enumerate(score)]
        home = [-1] * n  # the article, or else the main element, that a node lies in
        for i in range(n):
            above = home[up[i]] if i else -1
            home[i] = i if tag[i] == "article" and (above < 0 or tag[above] == "main") or tag[i] == "main" and above < 0 else above
        best = max(range(n), key=lambda i: (score[i], -i))
        if home[best] >= 0 and tag[home[best]] == "article":
            best = home[best]
        while up[best] > 0 and tag[best] in PARTS:
            best = up[best]
        near = max(10.0, 0.2 * max(score[best], own[best]))
        inside = lambda i, a: a <= i <= last[a]

        def belongs(i: int) -> bool:
            if home[best] < 0:
                return True
            return home[i] >= 0 and tag[home[i]] == "article" if tag[home[best]] == "article" else home[i] == home[best]

        keep = [best]
        keep += [i for i in range(1, n) if own[i] * plain[i] >= near and plain[i] > 0.5 and not inside(i, best) and not inside(best, i) and belongs(i)]
        if home[best] >= 0 and tag[home[best]] == "article":
            keep = list(dict.fromkeys(home[i] for i in keep))
        whole = set(keep)
        if best:
            direct: dict[int, list[str]] = {}
            for owner, text, _ in self.blocks:
                direct.setdefault(owner, []).append(text)
            first, final = min(keep), max(last[i] for i in keep)
            top = best
            while top and not (top <= first and final <= last[top]):
                top = up[top]
            held = [False] * n
            for a in keep:
                held[a : last[a] + 1] = [True] * (last[a] + 1 - a)
            beside = {up[i] for i in whole if up[i] >= 0 and home[i] != i}
            for i in range(top, last[top] + 1) if len(whole) > 1 else range(up[best] + 1, last[up[best]] + 1):
                if held[i] or up[i] not in beside and not first < i < final or not belongs(i):
                    continue
                short = size[i] <= 80
                ends = re.search(r"[.!?](?:\s|$)", " ".join(direct.get(i, []))) is not None
                prose = tag[i] == "p" and size[i] and (not link[i] and ends if short else plain[i] > 0.75)
                between = first < i < final and tag[i] in PROSE and size[i] and plain[i] > 0.5
                title = tag[i] in HEADINGS and size[i] and not link[i] and (i < final or tag[i] in ("h1", "h2"))
                if up[i] in beside and score[i] >= near and plain[i] > 0.5 or prose or between or title:
                    keep.append(i)
        wanted = [False] * n
        for a in keep:
            wanted[a : last[a] + 1] = [True] * (last[a] + 1 - a)
        skip = 0
        for i in range(n):
            if i >= skip and tag[i] in BOXES and i not in whole and size[i] and plain[i] < 0.5 and size[i] < SHORT_LINK * count[i]:
                skip = last[i] + 1
                wanted[i:skip] = [False] * (skip - i)
        return "\n".join(text for owner, text, _ in self.blocks if wanted[owner])


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    text = page.main_text()
    if len(text) < LITTLE and 4 * len(text) < page.lost:
        again = Page(html, names=False).main_text()
        if len(again) >= LITTLE:
            return again
    return text


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    small_batches(pages.sparkSession)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text = [main_text(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
