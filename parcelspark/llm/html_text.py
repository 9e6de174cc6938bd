"""Operator 5: main text of web pages by consensus host paths.

Each page votes for the lowest container that holds its running text, links left
aside.  A container is known by its generalised path: tags with their classes,
digits replaced.  Spark adds up the votes for each path of a host; then every
page is read again and gives the blocks under the winning path of its host, or
under its own vote where it lacks that path.  A page whose template is broken or
short so follows its host.  A page without running text gives all its blocks.

Boilerplate (menus, headers outside an article, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) is known by tag, role, and
words of class or id, and is left out under any path, but for elements that
hold the page's article or most of its running text (see ``_judge``).  A name
that only contains such a word, and a paragraph of an article named by one word
that also has other meanings, is weak evidence: it has no vote, and its running
text stays where it lies within the winning container.

Reading takes time in proportion to a page's length, also of malformed ones:
an attribute's quote without an end closes with its tag, an unclosed comment
ends at the next ``>``, and elements beyond ``DEEPEST`` open ones lie beside
each other.

Rows: null or empty html gives an empty text; a null url counts as one host;
one row per input row, repeated rows included; only ``page_id``, ``url`` and
``html`` are read.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import cut, lookup, map_texts

#: Elements without text of the page; what the raw ones hold is no markup.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas textarea select".split())
RAW = frozenset("script style noscript iframe textarea".split())
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
READ = frozenset("class id role hidden aria-hidden style href".split())
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
OPEN_QUOTE = re.compile(r"""=\s*(["'])""")
#: Open elements of a page; browsers have such a bound too.
DEEPEST = 128
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body div article section main aside nav header footer form td th table tbody tr ul ol dl blockquote figure center fieldset dialog details".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption thead tfoot summary legend title option".split())
#: An open element of these ends where one of its kind, or what holds it, begins or ends.
SELF_CLOSING = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
DROPPED_TAGS = frozenset("head nav footer aside form button label menu dialog title fieldset".split())
HEAD = frozenset(["head", "title"])
#: Tags that hold no article, however much text they have.
LINK_TAGS = frozenset("nav menu button label".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar rail footer masthead topbar toolbar banner ad ads advert adverts advertisement advertising "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments reply replies respond disqus share sharing social related recommended recommendations widget pagination pager skip hidden".split()
)
#: Those of them that have other meanings: in a longer name they are weak evidence.
AMBIGUOUS = frozenset("nav navigation menu sidebar rail footer masthead banner ad ads notice alert overlay login comment reply social related recommended recommendations widget pager skip hidden toolbar topbar header".split())
#: Words that say where or how an element stands, not what it is.
FURNITURE = frozenset(
    "box bar list item items wrap wrapper container block inner outer left right top bottom main site page global primary secondary section area content links link posts post articles "
    "stories buttons button icons icon panel card cards slot unit row col column group holder region zone inline body text head title more mobile desktop sticky fixed the my js sm md lg xl".split()
)
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
KEPT_AS_HEADER = frozenset(["article", "main", "section"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of an article that no page votes for.
PARTS = frozenset("ul ol dl blockquote figure details".split())
#: Least share of a page's running text that keeps a container beside the one with the rest.
BESIDE = 0.1
#: Class names that tell of the layout or state of an element, not of what it is.
STATE = re.compile(r"(?:has|no|not|with|without|is)[-_].*|.*[-_](?:open|closed|enabled|disabled|fixed)", re.I)
SPLIT_WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw) if raw else ():
        if (name := m[1].lower()) in READ:
            out.setdefault(name, m[2] or m[3] or m[4] or "")
    return out


NO, WEAK, STRONG = range(3)


def _dropped(tag: str, attrs: dict[str, str], above: dict[str, int]) -> int:
    """How plainly an element is boilerplate; ``above`` counts the open elements."""
    in_article = above.get("article") or above.get("main")
    header_kept = in_article or above.get("section")
    if tag in DROPPED_TAGS or attrs.get("role", "").lower() in DROPPED_ROLES or (tag == "header" and not header_kept):
        return STRONG
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return STRONG
    if tag in ("html", "body", "article", "main"):
        return NO
    worst = NO
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {w.lower() for w in SPLIT_WORDS.split(name) if w} if not STATE.fullmatch(name) else ()
        told = DROPPED_WORDS.intersection(words) | ({"header"} & set(words) if not header_kept else set())
        if told:
            plain = told - AMBIGUOUS or (words <= told | FURNITURE and not (in_article and tag in TEXT_TAGS))
            worst = max(worst, STRONG if plain else WEAK)
    return worst


def _step(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted(set(re.sub(r"\d+", "0", attrs.get("class", "")).split()))
    return ".".join([tag, *classes]).replace(">", "~")


def blocks_of(html: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """Blocks in page order: container path, text, and how much of the text is links."""
    return [b[:3] for b in _blocks(html) if not b[4]]


class _Finder:
    """First place of a mark at or after ever later positions; each stretch is searched once."""

    def __init__(self, html: str):
        self.html, self.found = html, {}

    def at(self, mark: str, start: int) -> int:
        """The place, or the length of the page where there is none."""
        place = self.found.get(mark, -1)
        if place < start:
            place = self.html.find(mark, start)
            place = self.found[mark] = len(self.html) if place < 0 else place
        return place

    def tag_end(self, start: int) -> int:
        """The ``>`` of the tag whose attributes begin at ``start``, outside quoted values.

        A quoted value that holds a ``>`` must end before a space or the end of the
        tag; else its quote is taken as unbalanced.
        """
        html, n = self.html, len(self.html)
        end = self.at(">", start)
        while end < n and (q := OPEN_QUOTE.search(html, start, end)):
            close = self.at(q[1], q.end())
            if close == n or (close > end and html[close + 1 : close + 2] not in ("", " ", "\n", "\t", "\r", "/", ">")):
                return end
            start = close + 1
            end = self.at(">", start)
        return end


def _skip_ends(html: str, tag: str) -> dict[int, int]:
    """Start of each closed element ``tag`` -> the place of its end tag."""
    ends: dict[int, int] = {}
    open_at: list[int] = []
    find = _Finder(html)
    for m in re.finditer(rf"<(/?){tag}\b", html, re.I):
        if not m[1]:
            if tag in ("svg", "math") and html[find.at(">", m.start()) - 1] == "/":
                ends[m.start()] = m.start()
            else:
                open_at.append(m.start())
        elif open_at:
            # A raw element ends at the first end tag after it, others pair up.
            if tag in RAW:
                ends |= dict.fromkeys(open_at, m.start())
                open_at.clear()
            else:
                ends[open_at.pop()] = m.start()
    return ends


def _tokens(html: str):
    """``(kind, value, attributes)`` outside skipped elements: text, start tags and end tags.

    Of an unclosed skipped element only the start tag goes, and a script's or style's own text.
    """
    find, ends, at, n = _Finder(html), {}, 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", html[at:lt], ""
        if lt == n:
            return
        at = lt + 1
        after = html[at : at + 1]
        if after == "!" or after == "?":
            if html.startswith("<![CDATA[", lt):
                close = find.at("]]>", lt)
                if close < n:
                    yield "text", html[lt + 9 : close], ""
                at = close + 3 if close < n else lt + 9
                continue
            close = find.at("-->", lt + 4) if html.startswith("<!--", lt) else n
            at = close + 3 if close < n else find.at(">", lt) + 1
            continue
        m = NAME.match(html, at + (after == "/"))
        end = n if not m else find.at(">", m.end()) if after == "/" else find.tag_end(m.end())
        if end == n:
            yield "text", "<", ""
            continue
        tag, at = m[0].lower(), end + 1
        if tag not in SKIPPED:
            yield ("end" if after == "/" else "start"), tag, html[m.end() : end]
        elif after != "/":
            if tag not in ends:
                ends[tag] = _skip_ends(html, tag)
            close = ends[tag].get(lt)
            if close is not None:
                at = max(at, find.at(">", close) + 1)
            elif tag in ("script", "style"):
                at = find.at("<", at)


class _Dropped:
    """An element that looks like boilerplate, and what it holds."""

    __slots__ = ("above", "articles", "goes", "heading", "links", "main", "n", "weak")

    def __init__(self, above: _Dropped | None, weak: bool, links: bool):
        self.above, self.weak, self.links, self.n, self.articles, self.main, self.heading, self.goes = above, weak, links, 0, 0, False, False, True

    def chain(self):
        at = self
        while at:
            yield at
            at = at.above

    def gone(self) -> bool:
        return any(d.goes for d in self.chain())

    def gone_for_good(self) -> bool:
        return any(d.goes and not d.weak for d in self.chain())


def _judge(dropped: list[_Dropped], articles: list[tuple[_Dropped | None, list[int]]], headings: list[_Dropped | None], total: int) -> None:
    """Elements that hold the page's article stay, and what they hold is judged by itself.

    An element stays if a main element is inside; if no article is left on the page
    without it, and it holds most of the running text, or the longest article, longer
    than all that stays; or if it
    holds most of the running text and the first-level heading, which else would go.
    """
    longest = max(articles, key=lambda x: x[1][0], default=None)

    def left() -> tuple[int, int, int]:
        """Articles, first-level headings and running text that stay as things are."""
        outer = sum(d.n for d in dropped if d.goes and not (d.above and d.above.gone()))
        return sum(not (d and d.gone()) for d, _ in articles), sum(not (d and d.gone()) for d in headings), total - outer

    free, titles, rest = left()
    for d in dropped:
        if d.above and d.above.gone():
            continue
        most = 2 * d.n > total and not d.links
        if d.main or (not free and (most or (d.articles and longest[1][0] > rest and longest[0] and d in longest[0].chain()))) or (most and d.heading and not titles):
            d.goes = False
            free, titles, rest = left()


def _blocks(html: str | None) -> list[tuple[tuple[str, ...], str, int, bool, bool]]:
    """The same, and whether the block is a heading, and whether weak evidence speaks against it."""
    found: list[tuple[tuple[str, ...], list[tuple[str, bool, _Dropped | None]], bool]] = []
    stack: list[tuple[str, tuple[str, ...], _Dropped | None]] = []  # tag, container path, innermost element that looks like boilerplate
    above: dict[str, int] = {}  # tag -> open elements of it
    beyond: dict[str, int] = {}  # the same of those too deep to hold
    paths: dict[tuple[tuple[str, ...], str], tuple[str, ...]] = {}
    dropped: list[_Dropped] = []
    articles: list[tuple[_Dropped | None, list[int]]] = []
    headings: list[_Dropped | None] = []
    open_articles: list[tuple[int, list[int]]] = []
    text: list[tuple[str, bool, _Dropped | None]] = []
    link: int | None = None  # how many elements were open where the link began
    total = mains = 0

    def path() -> tuple[str, ...]:
        return stack[-1][1] if stack else ("page",)

    def end_block():
        nonlocal total
        if text:
            found.append((path(), text.copy(), any(above.get(h) for h in HEADINGS)))
            for piece, linked, d in text:
                if not linked and (n := len(" ".join(piece.split()))):
                    total += n
                    for _, sizes in open_articles:
                        sizes[0] += n
                    while d:
                        d.n += n
                        d = d.above
            text.clear()

    def close(to: int):
        nonlocal link
        while len(stack) > to:
            if stack[-1][0] in BLOCKS:
                end_block()
            above[stack.pop()[0]] -= 1
            while open_articles and open_articles[-1][0] >= len(stack):
                open_articles.pop()
        if link is not None and len(stack) < link:
            link = None

    def last(tags) -> int:
        """Place of the innermost open element of ``tags``; -1 where there is none."""
        if not any(above.get(t) for t in tags):
            return -1
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in tags)

    def inner() -> _Dropped | None:
        return stack[-1][2] if stack else None

    def drop_here(how: int, links: bool = False) -> _Dropped:
        dropped.append(_Dropped(inner(), how == WEAK, links))
        return dropped[-1]

    def push(tag: str, to: tuple[str, ...], d: _Dropped | None):
        stack.append((tag, to, d))
        above[tag] = above.get(tag, 0) + 1

    for kind, tag, raw in _tokens(html or ""):
        if kind == "text":
            if not any(above.get(t) for t in HEAD):
                text.append((tag, link is not None, inner()))
            continue
        ends = kind == "end"
        if tag == "a":
            # A link ends with the element that it began in; a mere anchor is none.
            link = None if ends or "href" not in _attributes(raw) else len(stack)
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                text.append((" ", False, inner()))
            continue
        if ends and beyond.get(tag):
            beyond[tag] -= 1
            continue
        deep = len(stack) >= DEEPEST
        if tag not in BLOCKS and tag not in DROPPED_TAGS:
            if not ends and tag not in VOID and raw and not raw.endswith("/"):
                if _dropped(tag, _attributes(raw), above) == STRONG and not deep:
                    push(tag, path(), drop_here(STRONG))
                elif above.get(tag):  # what its end tag would close is a dropped one of the same kind
                    if deep:
                        beyond[tag] = beyond.get(tag, 0) + 1
                    else:
                        push(tag, path(), inner())
            elif ends and (at := last((tag,))) >= 0:
                close(at)
            continue
        if ends:
            if (at := last((tag,))) < 0:
                end_block()
            else:
                close(at)
            continue
        if tag not in HEAD and (at := last(HEAD)) >= 0:  # an unclosed head ends where the body begins
            while (at := last(HEAD)) >= 0:
                close(at)
        if stack and tag in SELF_CLOSING.get(stack[-1][0], ()):
            close(len(stack) - 1)
        end_block()
        if tag in VOID:
            continue
        if deep and len(stack) >= DEEPEST:
            beyond[tag] = beyond.get(tag, 0) + 1
            continue
        attrs = _attributes(raw)
        here = inner()
        if tag not in HEAD and (how := _dropped(tag, attrs, above)):
            here = drop_here(how, tag in LINK_TAGS)
        to = path()
        if tag in CONTAINERS:
            to = paths.setdefault((to, step := _step(tag, attrs)), (*to, step))
        push(tag, to, here)
        if tag in ("article", "main"):
            articles.append((here, sizes := [0]))
            open_articles.append((len(stack) - 1, sizes))
            mains += tag == "main"
            for d in here.chain() if here else ():
                d.articles += 1
                d.main |= tag == "main" and mains == 1
        elif tag == "h1":
            headings.append(here)
            for d in here.chain() if here else ():
                d.heading = True
    end_block()
    _judge(dropped, articles, headings, total)
    gone = {id(d): (d.gone(), d.gone_for_good()) for d in dropped}
    out = []
    for to, pieces, heading in found:
        kept = [(piece, linked, d) for piece, linked, d in pieces if d is None or not gone[id(d)][1]]
        if joined := " ".join(unescape("".join(p for p, _, _ in kept)).split()):
            weak = any(d is not None and gone[id(d)][0] for _, _, d in kept)
            out.append((to, joined, min(sum(len(p) for p, linked, _ in kept if linked), len(joined)), heading, weak))
    return out


def main_path(blocks) -> str | None:
    """The lowest container that holds all running text of a page (blocks that are not mostly links).

    Within an article or main element it is that element, so that titles, leads
    and sections beside a body container stay.  Elsewhere a child stands for its
    parent if the parent has no text or heading outside it but other containers
    with less than ``BESIDE`` of the page's running text.
    """
    blocks = [b for b in blocks if not b[4]] or blocks
    running = [(b[0], len(b[1]) - b[2], b[3]) for b in blocks if 2 * b[2] <= len(b[1])]
    if not running:
        running = [(b[0], len(b[1]), b[3]) for b in blocks if _article(b[0])]
    if not running:
        return None
    total = sum(n for _, n, _ in running)
    while True:
        low, high = min(p for p, _, _ in running), max(p for p, _, _ in running)
        depth = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        path = low[:depth]
        if at := _article(path):
            return ">".join(path[:at])
        if any(len(p) == depth for p, _, _ in running):
            break
        inside: dict[str, int] = {}
        for p, n, _ in running:
            inside[p[depth]] = inside.get(p[depth], 0) + n
        child = max(inside, key=lambda c: (inside[c], c))
        if total - inside[child] >= BESIDE * total or any(heading and p[depth] != child for p, _, heading in running):
            break
        running = [r for r in running if r[0][depth] == child]
    while len(path) > 1 and path[-1].split(".", 1)[0] in PARTS:
        path = path[:-1]
    return ">".join(path)


def _article(path) -> int:
    """How many steps lead to the innermost article or main element of ``path``; 0 where there is none."""
    return next((i for i in range(len(path), 0, -1) if path[i - 1].split(".", 1)[0] in ("article", "main")), 0)


def text_under(blocks, path: str | None) -> str | None:
    """Blocks under ``path`` joined by blank lines; None where the page lacks the path.

    With weak evidence against it a block stays if it is running text.  Without a
    path, all blocks that nothing speaks against.
    """
    if path is None:
        return "\n\n".join(b[1] for b in blocks if not b[4]) or None
    steps = tuple(path.split(">"))
    return "\n\n".join(b[1] for b in blocks if b[0][: len(steps)] == steps and (not b[4] or 2 * b[2] <= len(b[1]))) or None


def _host(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, pages, path``: each host's container path of most votes; of equal ones the outer.

    A page has one vote, for the container that holds its running text.  Votes
    are summed before they are shuffled, so a host of many pages is no burden.
    """

    def make():
        def step(host, html):
            votes = [(h, p) for h, p in zip(host, (main_path(_blocks(x)) for x in html)) if p is not None]
            return {"host": [h for h, _ in votes], "path": [p for _, p in votes]}

        return step

    votes = map_texts(pages.select(_host("url").alias("host"), "html"), ["host", "html"], make, "host string, path string")
    totals = votes.groupBy("host", "path").agg(F.count("*").alias("votes"))
    order = F.struct(F.col("votes"), -F.size(F.split("path", ">")), F.col("path"))
    return totals.groupBy("host").agg(F.sum("votes").alias("pages"), F.max_by("path", order).alias("path"))


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, path`` of each page."""
    winners = cut(host_paths(pages))
    keyed = lookup(pages.select("page_id", "url", "html", _host("url").alias("host")), winners, "host", "pages")

    def make():
        def one(html, path):
            blocks = _blocks(html)
            if path is not None and (text := text_under(blocks, path)) is not None:
                return text, path
            own = main_path(blocks)
            return text_under(blocks, own) or "", own

        def step(page, url, html, path):
            found = [one(h, p) for h, p in zip(html, path)]
            return {"page_id": page, "url": url, "text": [t for t, _ in found], "n_chars": [len(t) for t, _ in found], "path": [p for _, p in found]}

        return step

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_texts(keyed, ["page_id", "url", "html", "path"], make, f"page_id {kind}, url string, text string, n_chars long, path string")
