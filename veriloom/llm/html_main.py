"""Main text of web pages by site template removal.

Every element's subtree gets a hash of its tags and text. Spark counts, per host, the distinct pages that hold a subtree,
and subtrees that recur on a large part of a host's pages are its template: they are deleted. A second hash is of a
subtree's shape alone: tags, class, id, share of linked text and place under its parents. What stands in one shape on
most pages of a host goes as well, if it is links, or if its wording differs little from page to page (a counter, a date, a
name in an else constant notice): 32 one-bit minhashes of its words are summed as signs over the host's pages, and the
mean square of those sums is the mean Jaccard similarity of the pages' wordings. Shapes delete nothing inside an article,
nothing that holds most of what the other rules leave of a page's prose, and never all of it. What marks itself as no
article (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts) goes as well, since on hosts with
few pages nothing recurs. A mark is a whole class or id; headings, tables and what holds most of a page's prose are never
deleted for theirs, and inside an article words that authors use as well are none. Prose inside an ``article`` or ``main`` is deleted only when most pages of a large host have
it, so a quoted passage or a copied page isn't taken for a template.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.base import in_arrow, maybe_broadcast, only, staged

#: A subtree is a template's if so many distinct pages, and such a share of the host's, hold it; the second pair holds
#: inside an article.
TEMPLATE = (10, 0.3)
TEMPLATE_IN_ARTICLE = (20, 0.5)
#: A shape is a template's if so many distinct pages, and such a share of the host's, have it, and it is of links or the
#: mean Jaccard similarity of its wordings is the third number or more.
TEMPLATE_SHAPE = (10, 0.5, 0.5)
LINKED = 0.8
#: A page counts as this over the number of its copies, so sums over pages are whole numbers.
WEIGHT = 1 << 30
SIGNS = 32
_MIX = np.random.default_rng(1).integers(1, 1 << 63, SIGNS, dtype=np.uint64) | np.uint64(1)

_PLAIN_TAG = (
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
)
_TAG, _TAG_OR_DATA = (re.compile(x, re.S) for x in (_PLAIN_TAG, rf"<!\[CDATA\[.*?\]\]>|{_PLAIN_TAG}"))
_ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)

_DIGITS = re.compile(r"\d+")

# HTML element names by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"p": frozenset("article aside body button div footer form header main nav section table td th li blockquote".split()), "li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "option": frozenset(("select",))}
NO_TEXT = frozenset(
    "script style noscript template head nav footer aside form button select textarea input svg iframe object canvas audio video dialog menu map datalist noembed noframes".split()
)
_MARKS = (
    "ads?|advert\\w*|adsense|adbox|sponsor\\w*|promo\\w*|nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|widgets?|footer|topbar|cookies?|consent|gdpr|popup|"
    "modal|newsletter|subscribe|subscription|signup|login|share|sharing|social|comments?|commentlist|disqus|respond|replies|reply|pagination|pager|toolbar|copyright"
)
#: Layout outside an article, but words of authors inside: titles, warnings, tables side by side.
_OUTSIDE = "banner|side|masthead|header|notices?|notification|alert|overlay|related|recommend\\w*|skip|search"
_PLAIN = "bar|bars|box|boxes|buttons?|icons?|links?|list|area|wrap|wrapper|container|section|block|panel|posts?|articles?|form|site|page|main|top|bottom|left|right|global|primary|secondary"


def _class(marks: str) -> re.Pattern:
    """Whole classes of which a part is a mark and every other part a mark or a plain word of layout."""
    return re.compile(rf"(?=(?:[a-z0-9]+[_-]+)*(?:{marks})(?:[_-]|$))(?:(?:{_MARKS}|{_OUTSIDE}|{_PLAIN})(?:[_-]+|$))+", re.I)


MARKED, MARKED_OUTSIDE = _class(_MARKS), _class(f"{_MARKS}|{_OUTSIDE}")
#: An id may be the slug of a title, so only single words mark.
MARKED_ID, MARKED_ID_OUTSIDE = re.compile(_MARKS, re.I), re.compile(f"{_MARKS}|{_OUTSIDE}", re.I)
UNMARKED = frozenset("h1 h2 h3 h4 h5 h6 hgroup table caption thead tbody tfoot tr td th colgroup col".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())

_BLOCKS = {t: i for i, t in enumerate(sorted(BLOCK))}
P, Q, MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


@functools.lru_cache(1 << 12)
def _kind(tag: str, names: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{tag} {names}".encode("utf-8", "surrogatepass"))


class Page:
    """The elements of a page, as far as text needs them."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.hash, self.names = ["#root"], [-1], [0], [""]
        #: Hidden or by role; by class or id; by class or id outside an article.
        self.marked, self.named, self.named_outside = [False], [False], [False]
        self.pieces: list[tuple[int, str]] = []
        self._stack, self._open = [0], {}
        at = 0
        text = source
        # nothing closes after these, so no opening one is looked at beyond: broken markup takes linear time
        stop, data = source.rfind(">") + 1, source.rfind("]]>")
        for m in iter(lambda: (_TAG_OR_DATA if at < data else _TAG).search(text, at, stop), None):
            if m.start() > at:
                self._text(text[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(text)
                if m[0].startswith("<![CDATA[") and m[0].endswith("]]>"):
                    self._text(m[0][9:-3], plain=True)
                continue
            if m[1] or m[4]:
                self._end(name)
                continue
            self._start(name, m[3] or m[6] or "")
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(text, at)
                end = close.start() if close else len(text)
                self._text(text[at:end])
                at = end
        rest = text[at:].partition("<!--")[0]
        if rest:
            self._text(rest)
        while len(self._stack) > 1:
            self._pop()

    def _text(self, raw: str, plain: bool = False) -> None:
        node = self._stack[-1]
        value = raw if plain or "&" not in raw else html.unescape(raw)
        self.pieces.append((node, value))
        words = " ".join(value.split())
        if words:
            self.hash[node] = (self.hash[node] * P + xxhash.xxh3_64_intdigest(words.encode("utf-8", "surrogatepass"))) & MASK

    def _pop(self) -> None:
        node = self._stack.pop()
        tag = self.tag[node]
        self._open[tag] -= 1
        if tag in BLOCK:
            self.pieces.append((node, " "))
        if self.hash[node]:
            self.hash[node] = (self.hash[node] * Q + xxhash.xxh3_64_intdigest(tag.encode())) & MASK or 1
            up = self._stack[-1]
            self.hash[up] = (self.hash[up] * P + self.hash[node]) & MASK

    def _close(self, tags: tuple[str, ...], scope: frozenset[str]) -> None:
        """Close an open element of ``tags`` unless an element of ``scope`` stands between."""
        if not any(self._open.get(t) for t in tags):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[i]]
            if tag in tags:
                while len(self._stack) > i:
                    self._pop()
                return
            if tag in scope:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._close(("p",), SCOPES["p"])
        if name in SIBLINGS:
            self._close(SIBLINGS[name], SCOPES[name])
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(self._stack[-1])
        self.hash.append(0)
        marked = named = outside = False
        names = []
        if attributes and name not in ("html", "body"):
            for k, v in _ATTRIBUTE.findall(attributes):
                k, v = k.lower(), v.strip("\"'")
                if k in ("class", "id"):
                    names.append(_DIGITS.sub("0", f"{k}={v}"))
                if k == "class":
                    named = named or any(map(MARKED.fullmatch, v.split()))
                    outside = outside or any(map(MARKED_OUTSIDE.fullmatch, v.split()))
                elif k == "id":
                    named = named or bool(MARKED_ID.fullmatch(v.strip()))
                    outside = outside or bool(MARKED_ID_OUTSIDE.fullmatch(v.strip()))
                elif k == "role":
                    marked = marked or v.lower() in ROLES
                elif k == "hidden" or k == "aria-hidden" and v.lower() == "true":
                    marked = True
                elif k == "style":
                    marked = marked or "display:none" in v.lower().replace(" ", "")
        self.names.append(" ".join(names))
        self.marked.append(marked)
        self.named.append(named and name not in UNMARKED)
        self.named_outside.append(outside and name not in UNMARKED)
        if name in BLOCK:
            self.pieces.append((node, " "))
        if name not in VOID:
            self._stack.append(node)
            self._open[name] = self._open.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if self._open.get(name):
            while self.tag[self._stack[-1]] != name:
                self._pop()
            self._pop()
        elif name == "br":
            self.pieces.append((self._stack[-1], " "))

    def subtrees(self) -> set[int]:
        """Signed hashes of the subtrees with text, down from the body."""
        skip = ("#root", "html", "body", "head", "title", "script", "style")
        return {h - (1 << 64) if h >> 63 else h for t, h in zip(self.tag, self.hash) if h and t not in skip}

    def _around(self) -> tuple[list[bool], list[bool]]:
        """Whether an element holds an article or the body; whether it is in an article."""
        n = len(self.tag)
        holds, article = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            if holds[i] or self.tag[i] in ("article", "main", "body"):
                holds[self.parent[i]] = True  # a wrapper of the article isn't dropped for its name
        for i in range(1, n):
            article[i] = article[self.parent[i]] or self.tag[i] in ("article", "main")
        return holds, article

    def shapes(self) -> dict[int, tuple[int, int]]:
        """Of each element with text outside articles two signed hashes of its shape, its place among like elements under
        the parent being counted from the front and from the back. The lowest bit says that its text is of links."""
        n = len(self.tag)
        holds, article = self._around()
        path, inside, out = [0] * n, [False] * n, [False] * n
        front, kinds, like = [0] * n, [0] * n, {}
        for i in range(1, n):
            up = self.parent[i]
            out[i] = out[up] or article[i] and not holds[i] or self.tag[i] in ("head", "script", "style", "template")
            if out[i]:
                continue
            kinds[i] = kind = _kind(self.tag[i], self.names[i])
            path[i] = (path[up] * P + kind) & MASK
            inside[i] = inside[up] or self.tag[i] == "a"
            front[i] = like.get((up, kind), 0)
            like[up, kind] = front[i] + 1
        letters, linked, blocks = [0] * n, [0] * n, [0] * n
        for node, value in self.pieces:
            if not out[node]:
                size = len(value.strip())
                letters[node] += size
                linked[node] += size if inside[node] else 0
        for i in range(n - 1, 0, -1):
            if not out[i]:
                up, tag = self.parent[i], self.tag[i]
                letters[up] += letters[i]
                linked[up] += linked[i]
                if tag in BLOCK:
                    blocks[i] |= 1 << _BLOCKS[tag]
                blocks[up] |= blocks[i]
        got = {}
        for i in range(1, n):
            tag = self.tag[i]
            if out[i] or not letters[i] or article[i] or holds[i] or tag in ("html", "body"):
                continue
            links = linked[i] >= LINKED * letters[i]
            base = (path[i] * P + (blocks[i] * Q ^ blocks[i] >> 64)) & MASK
            both = []
            for side, place in enumerate((front[i], like[self.parent[i], kinds[i]] - 1 - front[i])):
                h = ((base * P + 2 * place + side + 1) * Q & MASK) >> 1 << 1 | links
                both.append(h - (1 << 64) if h >> 63 else h)
            got[i] = both[0], both[1]
        return got

    def signs(self, nodes: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
        """One-bit minhashes, as signs, of the words of each subtree of ``nodes``, by shape; a shape that a page has
        several times has the words of all."""
        least: dict[int, np.ndarray] = {}
        words: list[int] = []
        owners: list[int] = []
        starts: list[int] = []

        def put() -> None:
            mixed = np.array(words, np.uint64)[:, None] * _MIX
            mixed ^= mixed >> np.uint64(32)
            for node, found in zip(owners, np.minimum.reduceat(mixed * np.uint64(Q), starts)):
                least[node] = np.minimum(least[node], found) if node in least else found
            for x in (words, owners, starts):
                x.clear()

        for node, value in self.pieces:
            own = list(set(value.split())) if node in nodes else ()
            for a in range(0, len(own), 4096):
                owners.append(node)
                starts.append(len(words))
                words += [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in own[a : a + 4096]]
                if len(words) >= 4096:
                    put()
        if words:
            put()
        for i in sorted(nodes, reverse=True):
            up = self.parent[i]
            if i in least and up in nodes:
                least[up] = np.minimum(least[up], least[i]) if up in least else least[i]
        shaped: dict[int, np.ndarray] = {}
        for i, both in nodes.items():
            for h in both if i in least else ():
                shaped[h] = np.minimum(shaped[h], least[i]) if h in shaped else least[i]
        if not shaped:
            return {}
        bits = (np.array(list(shaped.values())) >> np.uint64(17)) & np.uint64(1)
        return dict(zip(shaped, bits.astype(np.int64) * 2 - 1))

    def main_text(self, template: set[int], in_article: set[int], shapes: set[int] = frozenset(), marks: bool = True) -> str:
        """The text of what is left, white space as one space. Without ``marks`` the templates alone decide: neither
        articles, nor names, roles and layout elements count."""
        n = len(self.tag)
        holds, article = self._around()
        gone = [False] * n
        letters, linked, links = [0] * n, [0] * n, [0] * n
        inside, silent, apart = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or self.tag[i] == "a"
            silent[i] = silent[self.parent[i]] or self.tag[i] in NO_TEXT or self.marked[i]
            apart[i] = apart[self.parent[i]] or self.tag[i] == "article"
        articles = "article" in self.tag
        prose = [0] * n
        for node, value in self.pieces:
            size = len(value.strip())
            letters[node] += size
            linked[node] += size if inside[node] else 0
            prose[node] += 0 if inside[node] or silent[node] else size
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            letters[up] += letters[i]
            linked[up] += linked[i]
            prose[up] += prose[i]
            links[up] += links[i] + (self.tag[i] == "a")
        for i in range(1, n):
            up, tag = self.parent[i], self.tag[i]
            bad = gone[up] or tag in ("head", "script", "style", "template")
            if marks and not bad:
                bad = tag in NO_TEXT or tag == "header" and not article[up] and not holds[i]
                bad = bad or self.marked[i] and not holds[i]
                if not bad and not holds[i] and (self.named[i] or self.named_outside[i] and not article[i]):
                    # what holds most of the prose is the text, whatever its name, unless it stands beside an article
                    bad = prose[i] * 2 <= prose[0] or articles and not apart[i]
            h = self.hash[i]
            if h and not bad and tag not in ("html", "body", "article", "main"):
                signed = h - (1 << 64) if h >> 63 else h
                bad = signed in (in_article if article[i] else template)
            if marks and not bad and not article[i] and tag in ("ul", "ol", "table", "div", "p", "section") and links[i] >= 3 and linked[i] * 10 >= letters[i] * 8:
                bad = True  # a list of links is a menu
            gone[i] = bad
        scoped = marks and any(article[node] and not gone[node] and value.strip() for node, value in self.pieces)
        plain = self._left(gone, article, scoped)
        if not shapes or not plain or scoped:  # what stands in an article, shapes never touch
            return plain
        left = [0] * n
        for node, value in self.pieces:
            left[node] += 0 if gone[node] or inside[node] else len(value.strip())
        for i in range(n - 1, 0, -1):
            left[self.parent[i]] += left[i]
        shaped = self.shapes()
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.parent[i]]
            if not gone[i] and i in shaped and left[i] * 2 <= left[0]:
                gone[i] = any(s in shapes for s in shaped[i] if not (s & 1 and self.tag[i] in UNMARKED))
        return self._left(gone, article, scoped) or plain  # shapes never empty a page

    def _left(self, gone: list[bool], article: list[bool], scoped: bool) -> str:
        return " ".join("".join(v for node, v in self.pieces if not gone[node] and (article[node] or not scoped)).split())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, html, weight -> the weights of a batch's pages by host and hash; for shapes with the sums of signs."""
    for b in batches:
        texts: dict[tuple, int] = {}
        shapes: dict[tuple, np.ndarray] = {}
        hosts, weights = b.column(0).to_pylist(), b.column(2).to_pylist()
        for host, source, w in zip(hosts, b.column(1), weights):
            page = Page(source.as_py())
            for h in page.subtrees():
                texts[host, h] = texts.get((host, h), 0) + w
            for h, signs in page.signs(page.shapes()).items():
                row = np.append(signs, 1) * w
                shapes[host, h] = shapes[host, h] + row if (host, h) in shapes else row
        keys = [*texts, *shapes]
        sums = [None] * len(texts) + [r[:-1] for r in shapes.values()]
        n = [*texts.values(), *(int(r[-1]) for r in shapes.values())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
            ["host", "h", "n", "sums"],
        )


def templates(pages: DataFrame) -> DataFrame:
    """``host, template, in_article, shapes``: the recurring hashes of each host that has some, of subtrees with their
    text and of shapes. Copies of a page count as one page. A host's lists are bounded by its mean number of subtrees a
    page over the least share."""
    known = pages.where("html is not null").select("host", "html", F.xxhash64("html").alias("content"))
    each = staged(known.groupBy("host", "content").agg(F.count("*").alias("copies")), "contents")
    size = each.groupBy("host").agg(F.count("*").alias("pages"))
    several = maybe_broadcast(each.where("copies > 1"), 80)
    weight = F.floor(F.lit(WEIGHT) / F.coalesce("copies", F.lit(1))).cast("long")
    weighed = known.join(several, ["host", "content"], "left").select("host", "html", weight.alias("weight"))
    seen = staged(weighed.transform(in_arrow, _counted, "host string, h long, n long, sums array<long>"), "subtrees")
    n = F.round(F.sum("n") / WEIGHT).alias("n")
    # only hashes pass here, each host's rows spread over all of them
    texts = seen.where("sums is null").groupBy("host", "h").agg(n).where(F.col("n") >= TEMPLATE[0]).join(size, "host")
    (_, share), (least, most) = TEMPLATE, TEMPLATE_IN_ARTICLE
    strong = (F.col("n") >= least) & (F.col("n") >= most * F.col("pages"))
    texts = texts.where(F.col("n") >= share * F.col("pages")).select("host", F.col("h").alias("t"), F.when(strong, F.col("h")).alias("a"), F.lit(None).cast("long").alias("s"))
    least, share, alike = TEMPLATE_SHAPE
    sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(SIGNS)]
    shapes = seen.where("sums is not null").groupBy("host", "h").agg(n, F.sum("n").alias("w"), *sums).where(F.col("n") >= least).join(size, "host")
    square = sum(((F.col(f"s{k}") / F.col("w")) ** 2 for k in range(SIGNS)), F.lit(0.0)) / SIGNS
    similar = (square * F.col("n") - 1) / (F.col("n") - 1)
    links = F.pmod("h", F.lit(2)) == 1
    none = F.lit(None).cast("long")
    shapes = shapes.where((F.col("n") >= share * F.col("pages")) & (links | (similar >= alike))).select("host", none.alias("t"), none.alias("a"), F.col("h").alias("s"))
    lists = {"t": "template", "a": "in_article", "s": "shapes"}
    return texts.unionByName(shapes).groupBy("host").agg(*(F.collect_list(c).alias(name) for c, name in lists.items()))


def _extracted(marks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            known: dict = {}
            hosts = b.column(2).to_pylist()
            for i, source in enumerate(b.column(3)):
                if hosts[i] not in known:
                    known[hosts[i]] = tuple(set(b.column(c)[i].as_py() or ()) for c in (4, 5, 6))
                s = source.as_py()
                texts.append(Page(s).main_text(*known[hosts[i]], marks=marks) if s else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, marks: bool = True) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``page_id, url, text, n_chars`` for every row.

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
    one space. A null or empty page gives the empty text; pages without a valid host share one nameless host; repeated
    rows are each extracted; an empty table gives no rows; extra columns are ignored. Without ``marks`` the templates of
    the hosts alone decide what goes.
    """
    host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))
    one = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    found = staged(templates(one), "templates")
    size = found.agg(F.sum((F.size("template") + F.size("shapes")) * 16 + 100)).first()[0] or 0
    # sent to every task only when its measured size is small; else joined by host, where Spark splits large hosts
    found = F.broadcast(found) if size <= 32 << 20 else found
    joined = one.join(found, "host", "left").select("page_id", "url", "host", "html", "template", "in_article", "shapes")
    return joined.transform(in_arrow, _extracted(marks), "page_id long, url string, text string, n_chars long")
