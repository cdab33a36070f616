"""Main text of web pages with a site style tree.

The DOMs of each host are merged by path (tags with their classes and ids). For every path
the tree holds on how many pages it is, the styles (sequences of child tags) it takes there
and the contents that it carries. Presentation is as important as styles differ (their
entropy to the base of the pages), a content as important as few different pages share it
(one less the logarithm of these to that base). Pages count as different by the least hash
of their blocks, so copies and near copies of one article count once: what they share is
still an article, what different articles share is furniture.

A leaf's importance is that of its contents, unless it has a name. The composite importance of a branch with l styles
is (1 - g^l) of its presentation's importance and g^l of its parts', weighed by their text; g is
``DAMPING``. A branch is noise, and goes, if neither it nor any branch or content in it
reaches ``LOW_TEXT``. What markup says is a prior that multiplies it: nothing for navigation, footers,
asides, forms, scripts and the like; a third for names that only say advert, comments, cookie
notice and the like; more than half for names that may say so. As far as a path's presentation
varies from page to page, as articles' does and templates' doesn't, the prior counts for less.
Below ``LOW`` a plainly named branch goes as a whole, one of a doubtful name if all in it is as
low. A path on few pages has one style and important contents; contents in named branches count
as wholly important from ``LOW / DOUBTFUL`` on, others from ``LOW_TEXT`` on.

The article is what remains of ``article`` elements, else of ``main``, else of an element
named as content, else of the page.

Only statistics by path are shuffled; a page itself moves only if a filter of fixed size
says that one of its branches may be of low importance, and is then joined by salted host.

Defined cases: null or empty html gives an empty text; broken markup is closed as browsers
do, as far as blocks matter, in time that grows with the page; a tag that is never closed by
``>`` is text; pages without a url share one host; repeated rows are repeated; input columns
named like an appended one give way to it.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, replace_columns
from .textnp import IdFilter, id_filter

#: Paths on fewer different pages of a host have no statistics to speak of.
MIN_PAGES = 8
#: Branches below the first with their prior, or below the second without it, go; how little further styles take from the weight of what is in a branch.
LOW, LOW_TEXT, DAMPING = 0.3, 0.1, 0.9
#: Priors by markup: for plain and for doubtful names.
PLAIN, DOUBTFUL = 0.33, 0.6
SALTS = 16

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/><]*))")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "caption", "dd", "dt", "head", "html", "li", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"} | {"li", "dd", "dt"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
_KEEPS_P = frozenset("td th button caption object article section div li blockquote main body".split())
# Markup that is no part of an article.
_GONE = frozenset("head script style noscript template svg math canvas nav footer aside button select textarea input iframe object embed applet audio video dialog menu".split())
_GONE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog status menu menubar toolbar form note".split())
#: Names of readers' comments: an article in them isn't the page's own.
_COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: Plain names of what is no part of an article.
_NAMES = _COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos cookie cookies consent gdpr notice notices alert alerts "
    "newsletter subscribe subscription signup signin login paywall popup modal overlay sidebar sidebars menu menus nav navbar navigation topnav breadcrumb breadcrumbs footer footers masthead topbar toolbar "
    "share sharing social trending pagination pager widget widgets disclaimer".split()
)
#: Names that may also be an article's own.
_DOUBTS = frozenset("related recommended recommendations promotion discussion skip search form forms toc teaser".split())
#: Words that say nothing about what they name.
_NEUTRAL = frozenset("area areas bar box block bottom button buttons container global group header inner item items left link links list main middle outer page panel right row section site slot top unit wrap wrapper".split())
_NOT_ARTICLES = frozenset("ad ads advert related sponsored promo teaser".split()) | _COMMENTS
_LAYOUT = frozenset("sidebar sidebars menu navbar header footer".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CONTAINER_WORDS = frozenset("content article post entry story main body text".split())
_HEADING = re.compile(r"h[1-6]|hgroup")


class Node:
    __slots__ = ("attrs", "children", "holds", "parent", "path", "prior", "sign", "tag", "top")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []
        self.holds = frozenset()
        self.prior, self.top = 1.0, False
        self.path = ""
        self.sign = tag
        if attrs:
            names = [x for k in ("class", "id") if attrs.get(k) for x in attrs[k].split()]
            if names:
                self.sign = tag + "." + ".".join(sorted(re.sub(r"\d+", "#", x) for x in names))


def _attributes(text: str) -> dict:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


class _Tags:
    """Where tags end: at the first ``>`` outside quotes, or any once quotes are found not to match."""

    def __init__(self, html: str):
        self.html, self.quotes = html, True
        self.last = html.rfind(">")

    def end(self, at: int) -> int:
        if at > self.last:
            return -1
        html, i = self.html, at
        while self.quotes:
            close = html.find(">", i)
            quote = min((q for q in (html.find('"', i, close), html.find("'", i, close)) if q >= 0), default=-1)
            if close < 0:
                self.quotes = False
            elif quote < 0:
                return close
            else:
                i = html.find(html[quote], quote + 1) + 1
                if not i:
                    self.quotes = False
        return html.find(">", at)


def parse(html: str) -> Node:
    """The tree of a page; children are nodes and strings (already decoded)."""
    root = node = Node("#root", None, None)
    tags, open_, at, end = _Tags(html), Counter(), 0, len(html)

    def leave(upto: Node) -> Node:
        inner = node
        while inner is not upto:
            open_[inner.tag] -= 1
            inner = inner.parent
        return upto

    def opened(tag: str):
        """The open element of that name, as far as the nearest table cell, button or root."""
        inner = node
        while open_[tag] and inner is not root:
            if inner.tag == tag:
                return inner
            if tag == "p" and inner.tag in _KEEPS_P:
                return None
            inner = inner.parent
        return None

    while at < end:
        m = _OPEN.search(html, at)
        start = m.start() if m else end
        if start > at:
            node.children.append(unescape(html[at:start]))
        if m is None:
            break
        if m[2] is None:
            kind, stop = (m[0], {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">"))
            close = html.find(stop, m.end())
            if kind == "<![CDATA[":
                node.children.append(html[m.end() : close if close >= 0 else end])
            at = close + len(stop) if close >= 0 else end
            continue
        close = tags.end(m.end())
        if close < 0:
            node.children.append(unescape(html[start:]))
            break
        tag, attrs, at = m[2].lower(), html[m.end() : close], close + 1
        if m[1]:
            if tag == "br":
                node.children.append(Node("br", None, node))
            elif tag == "p" and not opened("p"):
                node.children.append(Node("p", None, node))
            elif open_[tag]:
                inner = node
                while inner.tag != tag and (tag in _BLOCK or inner.tag not in _BLOCK):
                    inner = inner.parent  # an inline end tag doesn't close blocks
                if inner.tag == tag:
                    node = leave(inner.parent)
            continue
        if tag in _CLOSES_P and (p := opened("p")) is not None:
            node = leave(p.parent)
        if tag in _SIBLINGS and any(open_[x] for x in _SIBLINGS[tag][0]):
            closed, stops = _SIBLINGS[tag]
            inner, found = node, node
            while inner is not root and inner.tag not in stops:
                if inner.tag in closed:
                    found = inner.parent
                inner = inner.parent
            node = leave(found)
        if tag in ("html", "body", "head") and open_[tag]:
            continue
        if tag == "body" and (head := opened("head")):
            node = leave(head.parent)
        new = Node(tag, _attributes(attrs.rstrip("/")), node)
        node.children.append(new)
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            body = html[at : stop.start() if stop else end]
            if tag in ("textarea", "title"):
                new.children.append(unescape(body))
            at = stop.end() if stop else end
        elif tag not in _VOID and not (attrs.endswith("/") and tag in ("svg", "path")):
            node = new
            open_[tag] += 1
    return root


def _walk(node):
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(c for c in reversed(n.children) if not isinstance(c, str))


def _named(node: Node) -> tuple[float, bool, set]:
    """Prior by class and id, whether these name comments, and the words that say so."""
    prior, comments, said = 1.0, False, set()
    for key in ("class", "id"):
        for name in (node.attrs.get(key) or "").split():
            got = [x.lower() for x in _WORD.findall(name)]
            plain = _NAMES.intersection(got)
            if plain and not plain.isdisjoint(_COMMENTS):
                comments = comments or all(x in _NAMES or x in _NEUTRAL for x in got)
            if plain and all(x in _NAMES or x in _NEUTRAL for x in got):
                prior = min(prior, PLAIN)
                said |= plain
            elif plain or not _DOUBTS.isdisjoint(got):
                prior = min(prior, DOUBTFUL)
    return prior, comments, said


def _judge(root: Node) -> None:
    """Sets each node's ``prior``, what it ``holds`` (article, main, h1 that aren't a comment's) and whether it is a page's ``top``."""
    nodes = list(_walk(root))
    for n in reversed(nodes):  # children come before their parents
        holds = set()
        for c in n.children:
            if not isinstance(c, str):
                holds |= c.holds
                if c.tag in ("article", "main", "h1") and c.prior > PLAIN:
                    holds.add(c.tag)
        prior, comments = 1.0, False
        attrs = n.attrs
        if n.tag in _GONE or n.tag == "form" and not holds:
            prior = 0.0
        elif attrs:
            role = attrs.get("role", "").lower()
            if "hidden" in attrs or attrs.get("aria-hidden") == "true" or role in _GONE_ROLES and not (role == "form" and holds) or re.search(r"display\s*:\s*none", attrs.get("style", "")):
                prior = 0.0
            elif n.tag not in ("html", "body", "main"):
                prior, comments, said = _named(n)
                if n.tag == "article":
                    got = {x.lower() for k in ("class", "id") for x in _WORD.findall(attrs.get(k) or "")}
                    prior = PLAIN if got & _NOT_ARTICLES and prior <= PLAIN or got and got <= _NOT_ARTICLES | _NEUTRAL else 1.0
                elif prior <= PLAIN and not comments and holds & ({"article", "main", "h1"} if said & _LAYOUT else {"article", "main"}):
                    prior = 1.0  # a wrapper may be named after what else is on the page
        n.prior = prior
        n.holds = frozenset() if comments or prior == 0.0 else frozenset(holds)
        names = {x.lower() for k in ("class", "id") for x in _WORD.findall(attrs.get(k) or "")} if attrs else set()
        n.top = not holds and (n.tag == "header" or "header" in names and n.tag not in ("html", "body", "main", "article"))


def _container(root: Node) -> list[Node]:
    """The outermost articles, else main, else elements named as content; empty if there is none."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "named": []}
    todo = [(root, frozenset())]
    while todo:
        node, taken = todo.pop()
        kind = None
        if node is not root:
            if node.prior <= PLAIN or node.tag == "header":
                continue
            role = (node.attrs or {}).get("role")
            if node.tag == "article" or role == "article":
                kind = "article"
            elif node.tag == "main" or role == "main":
                kind = "main"
            elif node.attrs and node.tag in ("div", "section", "td") and any(x.lower() in _CONTAINER_WORDS for k in ("class", "id") for x in _WORD.findall(node.attrs.get(k) or "")):
                kind = "named"
            if kind and kind not in taken:
                found[kind].append(node)
                taken = taken | {kind}
        todo.extend((c, taken) for c in reversed(node.children) if not isinstance(c, str))
    for kind in ("article", "main", "named"):
        if any(_has_text(x) for x in found[kind]):
            return found[kind]
    return []


def _has_text(node) -> bool:
    return any(isinstance(c, str) and c and not c.isspace() for n in _walk(node) for c in n.children)


def blocks(roots: list[Node], gone) -> list[str]:
    """Texts of the blocks in page order; ``gone(node)`` says which branches don't count."""
    out: list[str] = []
    buf: list[str] = []
    tops = {id(r) for r in roots}

    def flush():
        text = " ".join("".join(buf).split())
        if text:
            out.append(text)
        buf.clear()

    todo: list = []
    for r in reversed(roots):
        todo += ["#flush", r]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            flush()
        elif isinstance(x, tuple):
            buf.append(x[0])
        elif x.tag in ("br", "wbr"):
            buf.append(" " if x.tag == "br" else "")
        else:
            if id(x) not in tops and gone(x):
                if x.tag in _BLOCK:
                    flush()
                continue
            # Of an article's header the headings count.
            children = [c for c in _walk(x) if _HEADING.fullmatch(c.tag)] if x.tag == "header" else x.children
            if x.tag in _BLOCK:
                flush()
                todo.append("#flush")
            for c in reversed(children):
                todo.append((c,) if isinstance(c, str) else c)
    flush()
    return out


def node_key(*parts: str) -> int:
    return int.from_bytes(blake2b("\n".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _unit(node: Node) -> bool:
    """Whether a node has a place of its own in the style tree; other elements are part of the text around them."""
    return node.tag in _BLOCK or node.tag == "#root" or node.prior < 1


def _own_text(node: Node) -> str:
    """Text of a unit without that of the units in it."""
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not _unit(x):
            out.append(" " if x.tag == "br" else "")
            todo.extend(reversed(x.children))
    return " ".join("".join(out).split())


def _style(node: Node) -> str:
    """Signs of a unit's children; a run of equal ones is one."""
    signs = [c.sign for c in node.children if not isinstance(c, str)]
    return " ".join(x for i, x in enumerate(signs) if not i or signs[i - 1] != x)


def _parts(html: str, host: str) -> tuple[list[Node], list[Node], list[str]]:
    """The article's roots, or else the page's, whose tag is ``#root``; the units in them, top down; their own texts.

    Paths are digests of a parent's path and a node's sign, so that long ones cost no more than short ones.
    """
    root = parse(html)
    _judge(root)
    for n in _walk(root):
        n.path = host if n.parent is None else str(node_key(n.parent.path, n.sign))
    roots = _container(root) or [root]
    todo, units = list(reversed(roots)), []
    while todo:
        n = todo.pop()
        if n.prior > 0 and n.tag not in _RAW:
            if _unit(n):
                units.append(n)
            todo.extend(c for c in reversed(n.children) if not isinstance(c, str))
    return roots, units, [_own_text(n) for n in units]


def composite(importance, styles, parts):
    """Composite importance of a branch: of its presentation, which has so many styles, and of its parts."""
    inner = DAMPING**styles
    return (1 - inner) * importance + inner * parts


def trusted(prior, importance):
    """A prior, for which a presentation that varies counts less."""
    return prior + (1 - prior) * importance * importance


def extract(html: str | None, facts: dict | None = None, host: str = "", telling=None) -> tuple[str, bool]:
    """Main text, and whether ``telling(keys)`` holds for something on the page, which then needs its site's facts and gives no text.

    ``facts`` are importance and number of styles (none for a content) by key; without them
    nothing is known of the site.
    """
    if not html:
        return "", False
    roots, units, texts = _parts(html, host)
    contents = [node_key(n.path, t) if t else None for n, t in zip(units, texts, strict=True)]
    if telling is not None:
        keys = [k for k in contents if k is not None] + [int(n.path) for n in units if n.parent is not None and n.prior <= PLAIN]
        if keys and telling(np.array(keys, np.int64)).any():
            return "", True
    known = facts or {}
    low: set[int] = set()
    sums: dict[int, list[float]] = {}
    for n, text, content in zip(reversed(units), reversed(texts), reversed(contents), strict=True):
        total, size, most = sums.pop(id(n), (0.0, 0, 0.0))
        leaf, own = not size, known.get(content, (1.0, 0))[0]
        size += len(text)
        total += own * len(text)
        importance, styles = known.get(int(n.path), (0.0, 1)) if n.parent is not None else (0.0, 1)
        parts = total / size if size else 1.0
        value = parts if leaf and n.prior == 1 else composite(importance, styles, parts)
        most = max(most, value, own if text else 0.0)
        prior = trusted(n.prior, importance)
        if size and (most < LOW_TEXT or prior * (value if n.prior <= PLAIN else most) < LOW and n.prior < 1):
            low.add(id(n))
        up = n.parent
        while up is not None and not _unit(up):
            up = up.parent
        if up is not None:
            of = sums.setdefault(id(up), [0.0, 0, 0.0])
            of[0], of[1], of[2] = of[0] + value * size, of[1] + size, max(of[2], most if size else 0.0)
    whole = roots[0].tag == "#root"
    return "\n".join(blocks(roots, lambda n: n.prior == 0 or whole and n.top or id(n) in low)), False


_STATS = {"site": pa.int64(), "path": pa.int64(), "content": pa.int64(), "style": pa.int64(), "page": pa.int64(), "named": pa.bool_(), "inside": pa.bool_(), "doubted": pa.bool_()}


def _survey(batches):
    """Per different page of a task: digest of the host, key of a path, key of its content, digest of its style, least digest of the page's texts, whether the path is plainly named, in a named branch and in one of a doubtful name.

    Outside named branches presentation decides nothing: all text there is a leaf's or a branch's own, which goes by its content.
    """
    for batch in batches:
        rows: set[tuple] = set()
        for html, host in zip(batch.column("html"), batch.column("host").to_pylist(), strict=True):
            html = html.as_py()
            if not html:
                continue
            _, units, texts = _parts(html, host)
            page, site = min((node_key(t) for t in texts if t), default=0), node_key(host)
            marks: dict[int, tuple[bool, bool]] = {}
            for n, text in zip(units, texts, strict=True):
                up = n.parent
                while up is not None and not _unit(up):
                    up = up.parent
                inside, doubted = marks.get(id(up), (False, False))
                inside, doubted = marks[id(n)] = inside or n.prior < 1, doubted or PLAIN < n.prior < 1
                if not (text or inside):
                    continue
                path, content = node_key(n.path) if n.parent is None else int(n.path), node_key(n.path, text) if text else None
                rows.add((site, path, content, node_key(_style(n)) if inside else None, page, n.prior <= PLAIN, inside, doubted))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STATS.values(), strict=True)], names=list(_STATS))


def style_tree(pages: DataFrame) -> DataFrame:
    """Merged tree of ``pages(host, html)``: ``site, key, pages, importance, content, styles, named, inside, doubted`` of the contents that several pages share and of the presentation of paths in named branches."""
    stats = cut(map_batches(pages, _survey, "site long, path long, content long, style long, page long, named boolean, inside boolean, doubted boolean"), "pages-stats")
    one = F.lit(1)
    by_path = stats.groupBy("path", "page").agg(F.max("style").alias("style"), F.max("site").alias("site"), F.max("named").alias("named"))
    pages_of = by_path.groupBy("path").agg(F.count(one).alias("m"))
    base = F.greatest(F.log("m"), F.lit(1e-9))
    alike = by_path.where("style is not null").groupBy("site", "path", "style").agg(F.count(one).alias("c"), F.max("named").alias("named"))
    alike = alike.groupBy("site", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("same"), F.count(one).cast("int").alias("styles"), F.max("named").alias("named"))
    presentation = F.when(F.col("m") < 2, 1.0).otherwise((F.log("m") - F.col("same") / F.col("m")) / base)
    paths = alike.select("site", F.col("path").alias("key"), F.col("m").alias("pages"), presentation.alias("importance"), F.lit(False).alias("content"), "styles", "named", F.lit(True).alias("inside"), F.lit(False).alias("doubted"))
    shared = stats.where("content is not null").groupBy("content", "page").agg(*[F.max(c).alias(c) for c in ("path", "site", "inside", "doubted")])
    shared = shared.groupBy("content").agg(F.count(one).alias("k"), *[F.max(c).alias(c) for c in ("path", "site", "inside", "doubted")]).where("k > 1")
    contents = shared.join(pages_of, "path").select("site", F.col("content").alias("key"), F.col("m").alias("pages"), (1 - F.log("k") / base).alias("importance"), F.lit(True).alias("content"), F.lit(0).alias("styles"), F.lit(False).alias("named"), "inside", "doubted")
    return paths.union(contents)


def extract_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep: tuple | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep``) with ``text string`` and ``n_chars long`` appended."""
    keep = tuple(pages.columns) if keep is None else keep
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in keep], host.alias("host"), F.col(html_col).cast("string").alias("html"))
    # Without these facts a page's text is the same: contents that are low, in branches of a doubtful name too low for that, presentations that may save a plain one.
    importance = F.col("importance")
    saved = trusted(PLAIN, importance) * composite(importance, F.col("styles"), F.lit(1.0)) >= LOW
    low = lambda where: importance < F.when(F.col(where), LOW / DOUBTFUL).otherwise(LOW_TEXT)
    telling = F.when(F.col("content"), low("doubted")).otherwise(F.col("named") & saved)
    known = style_tree(rows.select("host", "html")).where((F.col("pages") >= MIN_PAGES) & F.when(F.col("content"), low("inside")).otherwise(F.col("styles") > 1))
    facts = cut(known.select("site", "key", "importance", "styles", telling.alias("telling")), "pages-facts")
    told = facts.where("telling")
    chosen = id_filter(told, "key", told.count())

    def first(batches):
        admit = IdFilter(*chosen.value).admit
        yield from _texts(batches, lambda batch, i: {"telling": admit})

    def second(batches):
        def of_site(batch, i):
            return {"facts": {x["key"]: (x["importance"], x["styles"]) for x in batch.column("facts")[i].as_py() or []}}

        yield from _texts(batches, of_site)

    schema = rows.withColumns({"text": F.lit(""), "again": F.lit(True), "site": F.lit(0).cast("long")}).schema
    for f in schema:
        f.nullable = True
    done = cut(map_batches(rows, first, schema), "pages-text")
    lists = facts.groupBy("site").agg(F.collect_list(F.struct("key", "importance", "styles")).alias("facts"))  # as many as a site's templates have branches
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_ = done.where("again").drop("text", "again").withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    open_ = open_.join(lists, ["site", "salt"], "left").select(*rows.columns, "facts")
    full = done.where("not again").select(*[f"`in_{c}`" for c in keep], "text").union(map_batches(open_, second, schema).select(*[f"`in_{c}`" for c in keep], "text"))
    named = full.select(*[F.col(f"`in_{c}`").alias(c) for c in keep], F.col("text").alias("__text"))
    return replace_columns(named, {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}).drop("__text")


def _texts(batches, known_of):
    for batch in batches:
        texts, again, html = [], [], batch.column("html")
        hosts = batch.column("host").to_pylist()
        for i in range(batch.num_rows):
            text, found = extract(html[i].as_py(), host=hosts[i], **known_of(batch, i))
            texts.append(text)
            again.append(found)
        names = [n for n in batch.schema.names if n != "facts"]
        columns = [batch.column(n) for n in names]
        at = names.index("html")
        columns[at] = pa.array([h if a else None for h, a in zip(html.to_pylist(), again, strict=True)], pa.string())
        site = pa.array([node_key(h) for h in hosts], pa.int64())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(again, pa.bool_()), site], names=[*names, "text", "again", "site"])
