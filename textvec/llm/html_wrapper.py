"""Operator 4, HTML extraction with wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and text blocks. Tandem repeats of a stream fold into repeated groups. A host's wrapper
starts as its first page; each further page is aligned with it: equal tokens stay, texts that differ become slots,
what only one side has becomes an optional group. Wrappers align with wrappers in the same way, so a host's pages are
folded within each task, then by (host, salt), then by host, and no task sees all pages of a large host. All pages
take part, whatever their size. A wrapper that grows beyond ``MOST`` tokens loses its optional groups, which hold no
text that all pages have, and keeps its mandatory part, which is never larger than the smallest page.

Extraction takes the wrapper's slots: a text that is the same on all pages of the host is template and left out, inside
articles as well as outside; only an article of which nothing would be left stays whole. Tags and names label regions: no
article holds scripts, styles, forms, menus, headers, footers, sidebars, and boxes whose class, id or role names a
notice, an advert or comments, and if the page has an ``article`` or ``main``, only what is inside counts."""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvec.llm.shared import stash

MOST = 1500
#: Up to so many cells of a table, runs of nodes are aligned by their longest common run, else between nodes that each has once.
TABLE = 1_000_000
#: Marks texts inside of an article, so that one is never taken for the same text in a menu.
INSIDE = "\x01"
#: A host's pages meet its wrapper in so many parts, so that a large host is no single task.
SALTS = 32
#: Letters of all hosts' template texts that are broadcast; more meet the pages by a salted shuffle.
BROADCAST = 1 << 22
#: A mark that ends without a look at quotes; other tags are scanned by `_tag_end`.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*>)?|([^<]+|<)", re.S)
_TAG_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Names of elements and boxes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video xmp noembed noframes".split())
SKIP = RAW | frozenset("head nav header footer aside form button select menu dialog datalist fieldset label".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
BOX = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation navigate breadcrumb breadcrumbs header masthead footer "
    "cookie cookies consent gdpr notice notices notification alert warning popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended "
    "comment comments reply replies respond discussion disqus reader pagination pager toolbar widget complementary contentinfo search".split()
)
#: Words that say where a box is or what it is made of.
PLACE = frozenset(
    "site page main global top bottom left right upper lower center inner outer primary secondary tertiary mobile desktop sticky fixed float floating small large big full wide mini "
    "box bar area wrap wrapper container section block list item items row col column panel slot unit body content text title heading link links button buttons form field icon icons logo image img "
    "tag tags post posts article articles story stories blog user users reader readers author entry entries thread view js and for the of region landmark group holder inline leaderboard".split()
)
_RAW_END = {x: re.compile(rf"</{x}\b[^>]*>?|\Z", re.I) for x in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _boxed(attrs: str) -> bool:
    """Whether the attributes name a box that is no part of an article: a name all of whose words are of `BOX` or `PLACE`,
    at least one of them of `BOX`. So ``site-header`` is one, ``has-sidebar`` and ``share-price-analysis`` are not."""
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role"):
            for one in value.split():
                parts = {w.lower() for w in _WORDS.findall(one)}
                if parts & BOX and parts <= BOX | PLACE:
                    return True
    return bool(re.search(r"\shidden(?=\s|/|$)", attrs))


class _Tags:
    """Ends of tags in a page. A scan that respects quotes runs to the end of the page once at most."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``; -1 if none does."""
        if at > self.last:
            return -1
        to = at
        while self.quotes:
            m = _TAG_STOP.search(self.page, to)
            if m and m[0] == ">":
                return m.start()
            to = self.page.find(m[0], m.end()) + 1 if m else 0
            if not to:
                self.quotes = False
        return self.page.find(">", at)


def _mark(text: str, inside: bool) -> str:
    return INSIDE + text if inside else text


def blocks(page: str) -> tuple[list[tuple[str, str, bool, bool]], list[str]]:
    """The text blocks of a page as (path, text, skipped, in an article), and its token stream.

    A stream token is ``<tag``, ``>tag`` or ``=text``. Unclosed elements end with the element around them."""
    out: list[tuple[str, str, bool, bool]] = []
    stream: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, skipped, in an article
    held: list[str] = []
    opened: Counter[str] = Counter()  # names in the stack
    tags = _Tags(page)

    def close(down_to: int) -> None:
        for name, _, _ in stack[down_to:]:
            opened[name] -= 1
        del stack[down_to:]

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            _, skip, inside = stack[-1] if stack else ("", False, False)
            out.append(("/".join(s[0] for s in stack[-4:]), text, skip, inside))
            stream.append("=" + _mark(text, inside))

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        if not m:
            held.append(page[at])
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            held.append(m[4])
            continue
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), (m[3] or "")[:-1]
        if m[3] is None:
            to = tags.end(at)
            if to < 0:  # no tag, but text
                held.append(m[0])
                continue
            attrs, at = page[at:to], to + 1
        if tag == "br":
            held.append(" ")
        elif m[1]:
            if tag in BLOCK:
                flush()
            if opened[tag]:
                close(max(k for k in range(len(stack)) if stack[k][0] == tag) if stack[-1][0] != tag else len(stack) - 1)
                if tag in BLOCK:
                    stream.append(">" + tag)
        else:
            if tag in BLOCK:
                flush()
                if opened[tag] and tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # these end an open one of their kind
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
                        if stack[k][0] in ("div", "ul", "ol", "dl", "table", "article", "section", "main", "body", "blockquote", "aside", "nav", "form", "td", "th"):
                            break
                stream.append("<" + tag)
            if tag in VOID or attrs.endswith("/"):
                continue
            if tag in RAW:
                at = _RAW_END[tag].search(page, at).end()
                continue
            _, skip, inside = stack[-1] if stack else ("", False, False)
            opens = tag in ("article", "main")
            skip = skip or tag in SKIP or (tag not in ("html", "body") and _boxed(attrs))
            stack.append((tag, skip, inside or (opens and not skip)))
            opened[tag] += 1
    flush()
    return out, stream


# A wrapper is a list of nodes: "<tag", ">tag", "=text"; ["slot"]; ["opt", nodes]; ["rep", nodes].


def _same(a, b) -> bool:
    """Whether two nodes can be one node of a wrapper."""
    if isinstance(a, str) and isinstance(b, str):
        return a == b or a[0] == b[0] == "="
    text = lambda x: x == ["slot"] or isinstance(x, str) and x[0] == "="
    if text(a) and text(b):
        return True
    return isinstance(a, list) and isinstance(b, list) and a[0] == b[0] and (a[0] == "slot" or _shape(a[1]) == _shape(b[1]))


def _shape(nodes: list) -> list:
    return [["slot"] if isinstance(n, str) and n[0] == "=" else n if isinstance(n, str) or n[0] == "slot" else [n[0], _shape(n[1])] for n in nodes]


def _join(a, b):
    if a == b:
        return a
    if isinstance(a, list) and a[0] in ("opt", "rep") and isinstance(b, list):
        return [a[0], [_join(x, y) for x, y in zip(a[1], b[1])]]
    return ["slot"]


def fold(nodes: list, longest: int = 8) -> list:
    """Tandem repeats of up to ``longest`` tokens as one repeated group; texts within them that differ are slots."""
    out: list = []
    for node in nodes:
        out.append(node)
        again = True
        while again:
            again = False
            for n in range(1, min(longest, len(out) - 1) + 1):
                unit = out[-n:]
                if n == 1 and (unit[0] == ["slot"] or isinstance(unit[0], str)):
                    continue
                if len(out) > n and isinstance(out[-n - 1], list) and out[-n - 1][0] == "rep" and len(out[-n - 1][1]) == n and all(map(_same, out[-n - 1][1], unit)):
                    out[-n - 1 :] = [["rep", [_join(x, y) for x, y in zip(out[-n - 1][1], unit)]]]
                    again = True
                    break
                if len(out) >= 2 * n and n > 1 and all(map(_same, out[-2 * n : -n], unit)):
                    out[-2 * n :] = [["rep", [_join(x, y) for x, y in zip(out[-2 * n : -n], unit)]]]
                    again = True
                    break
    return out


def _optional(nodes: list) -> list:
    """Nodes that only one side has, as optional groups; those that are optional already stay."""
    out: list = []
    for old, group in groupby(nodes, lambda n: isinstance(n, list) and n[0] == "opt"):
        out += group if old else [["opt", list(group)]]
    return out


def _anchors(x: list, y: list) -> list[tuple[int, int]]:
    """Places of equal nodes that both sides have once, in the longest run with the same order on both."""
    places: list[dict[str, int]] = []
    for nodes in (x, y):
        keys = [n if isinstance(n, str) else json.dumps(n) for n in nodes]
        often = Counter(keys)
        places.append({k: i for i, k in enumerate(keys) if often[k] == 1})
    met = [(i, places[1][k]) for k, i in places[0].items() if k in places[1]]
    ends: list[int] = []  # of the runs of each length, the smallest last place in y
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(met):
        n = bisect_left(ends, j)
        back.append(last[n - 1] if n else -1)
        ends[n : n + 1], last[n : n + 1] = [j], [k]
    run, k = [], last[-1] if last else -1
    while k >= 0:
        run.append(met[k])
        k = back[k]
    return run[::-1]


def align(a: list, b: list) -> list:
    """One wrapper for what both describe: the longest common run of nodes, and optional groups for the rest."""
    if a == b:
        return a
    if len(a) == len(b) and all(map(_same, a, b)):
        return [_join(x, y) for x, y in zip(a, b)]
    head = 0
    while head < min(len(a), len(b)) and _same(a[head], b[head]):
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and _same(a[-1 - tail], b[-1 - tail]):
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) * len(y) > TABLE:
        out, i, j = [_join(p, q) for p, q in zip(a[:head], b[:head])], 0, 0
        for m, n in [*_anchors(x, y), (len(x), len(y))]:
            if (m - i) * (n - j) <= TABLE:
                out += align(x[i:m], y[j:n])
            else:
                out += _optional([*x[i:m], *y[j:n]])
            out += x[m : m + 1]
            i, j = m + 1, n + 1
        return out + [_join(p, q) for p, q in zip(a[len(a) - tail :], b[len(b) - tail :])]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _same(x[i], y[j]) else max(best[i + 1][j], best[i][j + 1])
    out = [_join(p, q) for p, q in zip(a[:head], b[:head])]
    i = j = 0
    lone: list = []

    def settle() -> None:
        out.extend(_optional(lone))
        lone.clear()

    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and _same(x[i], y[j]):
            settle()
            out.append(_join(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            lone.append(x[i])
            i += 1
        else:
            lone.append(y[j])
            j += 1
    settle()
    return out + [_join(p, q) for p, q in zip(a[len(a) - tail :], b[len(b) - tail :])] if tail else out


def size(nodes: list) -> int:
    return sum(1 if isinstance(n, str) or n[0] == "slot" else 1 + size(n[1]) for n in nodes)


def constants(nodes: list) -> set[str]:
    """The texts that are the same on all pages: those outside slots and optional groups."""
    out: set[str] = set()
    for n in nodes:
        if isinstance(n, str):
            if n[0] == "=":
                out.add(n[1:])
        elif n[0] == "rep":
            out |= constants(n[1])
    return out


def mandatory(nodes: list) -> list:
    """A wrapper without its optional groups: what all pages have."""
    return [n if isinstance(n, str) or n[0] == "slot" else [n[0], mandatory(n[1])] for n in nodes if n[0] != "opt"]


def merge(a: list, b: list) -> list:
    """The wrapper of two sets of pages; of one that grows too large, the mandatory part."""
    both = align(a, b)
    return both if size(both) <= MOST else mandatory(both)


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://|[/?#].*$", "", (url or "").strip().lower(), flags=re.S)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper for each host of a task's pages, with the number of different pages."""
    found: dict[str, tuple[list, int]] = {}

    def out() -> pa.RecordBatch:
        rows = list(found.items())
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([json.dumps(w) for _, (w, _) in rows], pa.string()), pa.array([n for _, (_, n) in rows], pa.int64())], ["host", "wrapper", "pages"])

    for batch in batches:
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            if not page:
                continue
            own, host = fold(blocks(page)[1]), host_of(url)
            if host in found:
                wrapper, n = found[host]
                found[host] = (merge(wrapper, own), n + 1) if wrapper != own else (wrapper, n)
            else:
                found[host] = (own, 1)
            if len(found) > 2000:
                yield out()
    if found:
        yield out()


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    wrapper, pages = None, 0
    for i, (text, n) in enumerate(sorted(zip(table["wrapper"].to_pylist(), table["pages"].to_pylist()))):
        own = json.loads(text)
        if i and own == wrapper:
            pages = max(pages, n)
            continue
        wrapper, pages = (own, n) if not i else (merge(wrapper, own), pages + n)
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(wrapper)], pa.string()), "pages": pa.array([pages], pa.int64())})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) and the number of different pages, from pages(url, html)."""
    schema = "host string, wrapper string, pages long"
    first = pages.select("url", "html").mapInArrow(_first, schema)
    dealt = first.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(64)))
    half = dealt.groupBy("host", "salt").applyInArrow(_merge, schema)
    return half.groupBy("host").applyInArrow(_merge, schema)


def main_text(page: str | None, fixed: set[str] | frozenset[str] = frozenset()) -> str:
    """The main text of a page: blocks in page order, two line breaks between them. ``fixed``: the wrapper's constants."""
    found, _ = blocks(page or "")
    article = any(inside for _, _, _, inside in found)
    held = [(text, _mark(text, inside) in fixed) for _, text, skip, inside in found if not skip and inside == article]
    if article and all(same for _, same in held):
        return "\n\n".join(text for text, _ in held)
    return "\n\n".join(text for text, same in held if not same)


def _fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The constants of each wrapper of more than one page that has any."""
    for batch in batches:
        rows = [(h, sorted(constants(json.loads(w)))) for h, w, n in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "pages"))) if n > 1]
        rows = [x for x in rows if x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.list_(pa.string()))], ["__host", "fixed"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 512):
            batch = whole.slice(at, 512)
            texts = [main_text(page, frozenset(fixed or ())) for page, fixed in zip(batch.column("html").to_pylist(), batch.column("fixed").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null or empty html, and a page of which no block is left, give an empty text; a null url is a host of its own
    name, the empty one. Repeated rows are extracted row by row and count once for a wrapper. Other columns are
    ignored."""
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.regexp_replace(F.lower(F.trim(F.coalesce("url", F.lit("")))), r"(?s)^[a-z][a-z0-9+.-]*://|[/?#].*$", "")
    known = stash(wrappers(slim).mapInArrow(_fixed, "__host string, fixed array<string>"), "fixed")
    letters = known.agg(F.sum(F.aggregate("fixed", F.length("__host"), lambda n, x: n + F.length(x)))).first()[0] or 0
    if letters <= BROADCAST:
        joined = slim.join(F.broadcast(known), host == F.col("__host"), "left")
    else:
        known = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
        joined = slim.join(known, (host == F.col("__host")) & (salt == F.col("__salt")), "left")
    return joined.select("page_id", "url", "html", "fixed").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
