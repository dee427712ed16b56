"""Operator 3: main text of pages by consensus paths of their hosts.

A page is scanned into text blocks and the containers around them; menus, headers, footers, sidebars, notices,
adverts, forms, scripts and comments are left out by tag, class, id and role. A class or id counts by whole tokens: one
marks boilerplate only if all of its words do, or are neutral (_is_boilerplate). A tag or token only marks an element; it
is kept as a container if it is the page's wrapper (Page._left_out). Hidden elements are always left out. A container
scores the text of its blocks, less that of link lists; the outermost article or main that holds most of it scores as
the page. Each page votes for all its containers' generalised paths (tags with first classes, digits as N) in proportion
to their scores; votes are summed per host, and pages are read again with the path that won on their host. A page
without that path uses its own best container. Paths go by 128-bit hashes, chained from the root on, so that a page's
paths take memory in proportion to its containers however deep they lie.

Tags are read by a cursor as browsers do: a quote inside an unquoted value is a part of it, one that is never closed
too; a tag or comment that never ends takes the rest of the page. Time is linear in a page's length.

Defined results: null, empty and textless pages give an empty text; urls without a host vote as one host; ties go to
the deeper path, then the lower hash; rows are extracted one by one, repeated page_ids too; texts of any length are
read whole, one page at a time; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import lean, table, written
from docloom.llm.op1_url_filter import url_host

#: The unit of a vote: sums stay whole numbers.
UNIT = 1000
#: Bytes of winning paths up to which they are broadcast; beyond that pages are joined by host.
BROADCAST_BYTES = 8 << 20
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_NAME = re.compile(r"[^\s/>]+")
_SPACE = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_IS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
# Kinds of elements.
_RAW = {"script", "style", "template", "textarea", "title", "iframe", "object", "svg", "canvas", "audio", "video", "select", "xmp", "annotation", "annotation-xml"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_MATH = {"math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "mpadded", "mstyle", "mspace", "merror", "menclose", "mmultiscripts", "semantics"}
_INLINE = _MATH | {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "picture", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "br", "wbr"}
_OUT_TAGS = {"head", "nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "datalist", "noscript"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CONTAINERS = {"body", "article", "main", "section", "div", "td", "center", "table", "details", "figure"}
_OUT_WORDS = frozenset("nav navbar navigation menu masthead footer sidebar aside ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent notice notices notification gdpr popup modal overlay newsletter subscribe subscription signup share sharing social comment comments commentlist disqus reply replies respond discussion related recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar login search searchbox form contact hidden skip header topbar".split())
_NEUTRAL = frozenset("site page post posts entry article articles story stories main global primary secondary top bottom left right upper lower inner outer area bar box block body list item items link links button buttons container wrap wrapper section module region holder panel unit slot label title toggle media text meta count author date icon icons tags group row col column".split())
_ARTICLE_WORDS = {"post", "entry", "article", "story"}
_CONTENT = frozenset("content main article post entry story post-content entry-content article-content article-body post-body story-body main-content page-content".split())
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
_ROLE = "role=out"  # counts as a word
_TALK = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion"}
_ADS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted cookie cookies consent gdpr popup newsletter subscribe subscription signup".split())
# Of these words, those that name a part of a page's layout, an advert or a consent, and nothing of an article's own.
_PARTS = frozenset("nav navbar navigation masthead footer sidebar topbar breadcrumb breadcrumbs pagination pager ad ads adv advert adverts advertisement advertising adsense sponsored cookie cookies consent gdpr".split())
_READ = {"class", "id", "role", "hidden", "aria-hidden", "style", "itemprop"}
_TITLED = re.compile(r"(?i)\b(?:page|title|content|main)[-_]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd div section article aside header footer nav main table tr td th pre blockquote form figure hr address fieldset".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "p": (*sorted(_CONTAINERS), "li", "blockquote")}
_END_OF_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}


def path_key(parts: str | list[str], above: bytes = b"") -> bytes:
    """The hash of a path of parts, given as a list or apart by >."""
    for part in parts.split(">") if isinstance(parts, str) else parts:
        above = hashlib.blake2b(above + part.encode("utf-8", "replace"), digest_size=16).digest()
    return above


_BODY = path_key("body")


class Page:
    """Blocks (text, link characters, heading: 0, 1 or 2 for h1, container) in order; containers (parent, path)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int, int]] = []
        self._places: list[tuple[int, bool]] = []  # of each block: mark, below an article or main
        self._within: list[int] = [-1]  # of each container: mark
        self._marks: list[tuple[int, bool, bool, frozenset[str], str]] = []  # outer mark, a header, of a title, words, tag where words alone mark it below an article or main
        self._landmarks: list[tuple[str, int]] = []  # article or main, mark
        self.parents: list[int] = [-1]
        self._weights: list[float] = []  # of each block in scores, where words lower any
        self._leads: dict[int, float] = {}  # outermost containers of content: share of the text they must hold
        # Paths are numbered; of each container its path's number (-1: left out), of each path its hash and depth.
        self.of: list[int] = [0]
        self.keys: list[bytes] = [_BODY]
        self.depths: list[int] = [0]
        self._scan(source)
        if self._marks:
            self._left_out()

    def _attributes(self, source: str, at: int, last: dict[str, int]) -> tuple[int, dict[str, str]]:
        """The place after the tag whose attributes begin at `at` (its > or the end), and the attributes that count."""
        found: dict[str, str] = {}
        end = len(source)
        while True:
            at = _SPACE.match(source, at).end()
            if at >= end:
                return end, found
            if source[at] == ">":
                return at + 1, found
            key = _KEY.match(source, at)
            at, value = key.end(), ""
            equals = _IS.match(source, at)
            if equals:
                at = equals.end()
                quote = source[at : at + 1]
                if quote in last and at < last[quote]:
                    close = source.find(quote, at + 1)
                    value, at = source[at + 1 : close], close + 1
                else:
                    bare = _BARE.match(source, at)
                    value, at = bare[0], bare.end()
            name = key[0].lower()
            if name in _READ:
                found.setdefault(name, value)

    def _scan(self, source: str) -> None:
        # tag, container, hidden, inside an article's header, mark, below an article or main, in content
        stack: list[tuple[str, int, bool, bool, int, bool, bool]] = []
        open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag
        held: list[str] = []
        none = (0, False, False, -1, False, False)
        state = none
        links, in_link, at, heading = 0, False, 0, 0
        last = {q: source.rfind(q) for q in "\"'"}
        last_end = source.rfind(">")
        endless: set[str] = set()  # raw elements that are closed nowhere further on
        numbers: dict[tuple[int, str], int] = {}
        paths = [0]  # path numbers of containers, those left out too

        def flush() -> None:
            nonlocal links
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((text, links, heading, state[0]))
                    self._places.append((state[3], state[4]))
                held.clear()
            links = 0

        def close(k: int) -> None:
            for entry in stack[k:]:
                open_at[entry[0]].pop()
            del stack[k:]

        def innermost(tags: tuple[str, ...]) -> int:
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

        end = len(source)
        while at < end:
            found = _OPEN.search(source, at) if at < last_end else None
            start = found.start() if found and found.start() < last_end else end
            if start > at and not state[1] and (heading or not state[2]):
                piece = source[at:start]
                held.append(entities.unescape(piece) if "&" in piece else piece)
                if in_link:
                    links += len(piece.strip())
            if start == end:
                break
            first = source[start + 1]
            if first in "!?":
                stop = source.find("-->", start + 2) if source.startswith("<!--", start) else source.find(">", start)
                at = end if stop < 0 else stop + (3 if source.startswith("<!--", start) else 1)
                continue
            closing = first == "/"
            name = _NAME.match(source, start + 1 + closing)
            if closing and not (name and "a" <= name[0][0].lower() <= "z"):
                at = source.find(">", start) + 1
                continue
            tag = name[0].lower()
            at, attributes = self._attributes(source, name.end(), last)
            if not closing:
                if tag in _RAW:
                    if tag not in endless:
                        stop = _END_OF_RAW[tag].search(source, at)
                        if stop:
                            at = stop.end()
                            continue
                        endless.add(tag)
                    if tag in ("script", "style", "title", "textarea", "xmp"):
                        at = end
                    continue
                if tag in _INLINE or tag == "noscript" and state[4]:
                    if tag == "a":
                        in_link = True
                    elif tag == "br":
                        held.append(" ")
                    continue
                flush()
                in_link = False
                if tag in _VOID or tag == "html":
                    continue
                if tag in _BLOCKS and stack and (stack[-1][0] == "p" or stack[-1][0] in _HEADINGS):
                    close(len(stack) - 1)
                if tag in _SIBLINGS:
                    k = innermost(_SIBLINGS[tag])
                    if k >= 0 and k > innermost(_SCOPE.get(tag, ())):
                        close(k)
                container, out, only, mark, inside, content = stack[-1][1:] if stack else none
                suffix, words, hidden, story, lead = _names(*(attributes.get(x) for x in ("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop"))) if attributes else ("", frozenset(), False, False, False)
                outer = mark
                if tag == "body":
                    out, only, mark, inside, content = False, False, -1, False, False
                    close(0)
                elif (tag == "header" and not words or words == {"header"}) and (story or open_at.get("article") or open_at.get("main")):
                    only = True
                elif hidden:
                    out = True
                elif not out and (tag in _OUT_TAGS or words):
                    self._marks.append((mark, tag == "header" or words == {"header"}, bool(_TITLED.search(f"{attributes.get('class', '')} {attributes.get('id', '')}")), words, "" if not inside or tag in _OUT_TAGS or _ROLE in words else tag))
                    mark = len(self._marks) - 1
                landmark = tag in ("article", "main") and not out and (tag == "main" or mark == outer or story and not words & _TALK)
                if landmark:
                    self._landmarks.append((tag, mark))
                    inside = True
                if tag in _CONTAINERS and not out and tag != "body":
                    part = tag + suffix
                    above = paths[container]
                    number = numbers.setdefault((above, part), len(self.keys))
                    if number == len(self.keys):
                        self.keys.append(path_key([part], self.keys[above]))
                        self.depths.append(self.depths[above] + 1)
                    self.parents.append(container)
                    self.of.append(number)
                    paths.append(number)
                    self._within.append(mark)
                    container = len(self.parents) - 1
                    if (landmark or lead) and not content:
                        self._leads[container] = 0.5 if landmark else 0.8
                        content = True
                open_at.setdefault(tag, []).append(len(stack))
                stack.append((tag, container, out, only, mark, inside, content))
            else:
                if tag in _INLINE or tag == "noscript" and state[4]:
                    if tag == "a":
                        in_link = False
                    continue
                flush()
                k = innermost((tag,))
                if k >= 0 and k >= innermost(("body",)):
                    close(k)
            state = stack[-1][1:] if stack else none
            top = stack[-1][0] if stack else ""
            heading = 2 if top == "h1" else int(top in _HEADINGS)
        flush()

    def _left_out(self) -> None:
        """Leave out what lies in marked elements, but for those that wrap the page's text.

        A marked element is such a wrapper if it contains main; or an article or h1, where none stands outside, and
        at least as much running text as stands outside; or if it holds more than half of all running text, over four
        times as much as stands outside, and no article or main outside has any (not adverts and consents; comments
        only where no paragraph stands outside). Below an article or main other words than _PARTS leave nothing out,
        however short it is: they lower the weight of its text in scores. There, what is left out by its class is named
        for a part of the page and doesn't hold most running text, or is mostly links, or holds comments: elements of that
        name inside one another, or several alike side by side. Outside
        is what is in no marked element, or in wrappers alone. A page's header with its only h1 keeps its headings.
        Outer elements are decided first.
        """
        # Of each mark, with what is below it and alone; the last is what no mark holds: running text, that of
        # headings, of paragraphs, that below articles and main, h1s, articles and main, main, all text, that of links.
        own = [[0] * 9 for _ in range(len(self._marks) + 1)]
        for block, (m, inside) in zip(self.blocks, self._places, strict=True):
            n, heading = _running(block), block[2] > 0
            for k, x in ((0, n), (1, n * heading), (2, n * (not heading)), (3, n * inside), (4, int(block[2] == 2)), (7, len(block[0])), (8, block[1])):
                own[m][k] += x
        for tag, m in self._landmarks:
            own[m][5] += 1
            own[m][6] += tag == "main"
        below = [list(x) for x in own]
        for m in range(len(self._marks) - 1, -1, -1):
            outer = below[self._marks[m][0]]
            outer[:] = map(sum, zip(outer, below[m], strict=True))
        total, free = below[-1][0], own[-1]
        kept, titles = [False] * len(self._marks) + [True], [False] * (len(self._marks) + 1)
        weight, talks = [1.0] * (len(self._marks) + 1), self._comments()
        for m, (outer, header, titled, words, named) in enumerate(self._marks):
            if not kept[outer]:
                continue
            if named:
                text, every, linked = below[m][0], below[m][7], below[m][8]
                most = 2 * text > total
                kept[m] = not (m in talks or 2 * linked > every or words & _PARTS and not most)
                weight[m] = weight[outer] if most else min(weight[outer], 0.25)
                if kept[m]:
                    free = [x + y for x, y in zip(free, own[m], strict=True)]
                continue
            weight[m] = weight[outer]
            text, headings, _, _, h1, landmarks, mains, _, _ = below[m]
            led = (h1 or landmarks) and not free[5] and not free[4]
            wraps = 2 * text > total and text > 4 * free[0] and not free[3] and not words & _ADS
            titles[m] = header and titled and bool(led)
            if not (words & _TALK and free[2]):
                kept[m] = bool(mains or (wraps or led and text >= free[0]) and not (header and 2 * headings >= text))
            if kept[m]:
                free = [x + y for x, y in zip(free, own[m], strict=True)]
        places = [(b, m) for b, (m, _) in zip(self.blocks, self._places, strict=True) if kept[m] or b[2] and titles[m]]
        self.blocks = [b for b, _ in places]
        self._weights = [weight[m] for _, m in places]
        self.of = [p if kept[m] or titles[m] else -1 for p, m in zip(self.of, self._within, strict=True)]

    def _comments(self) -> set[int]:
        """Marks named as comments that hold or lie in others, or stand beside others of the same tag and words."""
        named = [m for m, mark in enumerate(self._marks) if mark[4] and mark[3] & _TALK]
        alike: dict[tuple[int, str, frozenset[str]], list[int]] = {}
        found = set()
        for m in named:
            outer, _, _, words, tag = self._marks[m]
            alike.setdefault((outer, tag, words), []).append(m)
            if outer >= 0 and self._marks[outer][4] and self._marks[outer][3] & _TALK:
                found |= {m, outer}
        return found.union(*(x for x in alike.values() if len(x) > 1))

    def scores(self) -> list[int | None]:
        """Each path's characters of running text, less those of link lists, below its containers (null: left out)."""
        own, h1 = [0] * len(self.parents), [0] * len(self.parents)
        for block, weight in zip(self.blocks, self._weights or itertools.repeat(1.0)):
            own[block[3]] += -len(block[0]) if 2 * block[1] > len(block[0]) else int(weight * _running(block))
            h1[block[3]] += block[2] == 2
        for k in range(len(own) - 1, 0, -1):
            own[self.parents[k]] += own[k]
            h1[self.parents[k]] += h1[k]
        total: list[int | None] = [None] * len(self.keys)
        leads: dict[int, list[float]] = {}
        for k, path in enumerate(self.of):
            if path < 0:
                continue
            total[path] = (total[path] or 0) + own[k]
            if k in self._leads:
                lead = leads.setdefault(path, [0, 0, 0.0])
                lead[:] = [lead[0] + own[k], lead[1] + h1[k], max(lead[2], self._leads[k])]
        top = max((x for x in total if x is not None), default=0)
        for path, (text, titles, share) in leads.items():
            if top > 0 and text >= share * top and titles == h1[0]:
                total[path] = top
        return total

    def best(self, scores: list[int | None]) -> bytes:
        return min((-s, -d, key) for s, d, key in zip(scores, self.depths, self.keys, strict=True) if s is not None)[2]

    def votes(self) -> Iterator[tuple[bytes, int, int]]:
        """The hashes, depths and votes of all paths with a score above 0."""
        scores = self.scores()
        top = max(x for x in scores if x is not None)
        for key, depth, score in zip(self.keys, self.depths, scores, strict=True):
            if score is not None and score > 0:
                yield key, depth, score * UNIT // top

    def text(self, path: bytes | None) -> str:
        """The blocks below all containers with that path, or with this page's best if none has it."""
        has = {self.keys[p] for p in self.of if p >= 0}
        if path not in has:
            path = self.best(self.scores())
        won = [False] * len(self.parents)
        for k, p in enumerate(self.of):
            won[k] = p >= 0 and self.keys[p] == path or k > 0 and won[self.parents[k]]
        return "\n\n".join(b[0] for b in self.blocks if won[b[3]])


def _running(block: tuple[str, int, int, int]) -> int:
    """A block's characters of running text: short lines count a quarter, link lists nothing."""
    text, links, heading, _ = block
    n = len(text)
    return 0 if 2 * links > n else n if heading or n >= 25 or text[-1] in ".!?:" else n // 4


def _is_boilerplate(words: list[str]) -> bool:
    """Whether a token of these words marks boilerplate: sidebar-left does, has-sidebar and related-work don't."""
    return any(w in _OUT_WORDS for w in words) and all(w in _OUT_WORDS or w in _NEUTRAL for w in words)


@functools.lru_cache(4096)
def _names(classes: str | None, name: str | None, role: str | None, hidden: str | None, aria: str | None, style: str | None, prop: str | None) -> tuple[str, frozenset[str], bool, bool, bool]:
    """The path's suffix by first class or id, words of boilerplate, whether the element is hidden, of an article, content."""
    out, all_words, lead = set(), set(), prop == "articleBody" or (role or "").lower() == "main"
    for token in f"{classes or ''} {name or ''}".split():
        words = [w.lower() for w in _WORD.findall(token)]
        all_words.update(words)
        if _is_boilerplate(words):
            out.update(w for w in words if w in _OUT_WORDS)
        lead = lead or token.lower() in _CONTENT
    if (role or "").lower() in _OUT_ROLES:
        out.add(_ROLE)
    unseen = hidden is not None or (aria or "").lower() == "true" or bool(style and _UNSEEN.search(style))
    suffix = next((sign + re.sub(r"\d+", "N", value.split()[0]) for sign, value in ((".", classes or ""), ("#", name or "")) if value.split()), "")
    return suffix, frozenset(out), unseen, bool(all_words & _ARTICLE_WORDS), lead


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning path of every host (host, path: its hash)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, rows = [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = list(Page(source.as_py() or "").votes())
                hosts.extend([host] * len(mine))
                rows.extend(mine)
            keys, depths, votes = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "path": pa.array(keys, pa.binary()), "depth": pa.array(depths, pa.int32()), "votes": pa.array(votes, pa.int64())})

    cast = pages.select(url_host(F.col("url")).alias("host"), "html").mapInArrow(lean(vote), "host string, path binary, depth int, votes long")
    sums = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.max("depth").alias("depth"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("depth"), "path")).alias("path"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    winners = written(host_paths(pages), "op3-paths")
    size = winners.agg(F.sum(F.length("host") + 80)).collect()[0][0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source.as_py() or "").text(path) for source, path in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    hosted = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    joined = hosted.join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners.hint("merge"), "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(lean(read), joined.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLE: dict[str, str] = {}
