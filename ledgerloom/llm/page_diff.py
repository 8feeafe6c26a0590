"""Main text of web pages: markup rules, and differencing of pages with neighbouring addresses.

Pages of a host are put in the order of their paths, so a page's neighbours share the longest beginnings of a path with
it. Blocks that two neighbours have in common, by a longest common subsequence, are the site's and not the page's.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from itertools import accumulate

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import hot_join, map_rows, written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|select|object|canvas)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z0-9]+")

# Element names and names of page parts.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section "
                   "summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu "
                  "navbar nav navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice popup modal "
                  "overlay share sharing social related recommended recommendations comment comments replies reply disqus "
                  "discussion newsletter subscribe login signup widget pagination pager skip".split())
#: Words that may stand beside one of NAMES in a name without changing what it names.
BESIDE = frozenset("area articles bar block body bottom box buttons column container content group icons inner item items left "
                   "links list main outer panel posts primary right row secondary section site slot stories text thread "
                   "title top unit wrap wrapper zone".split())
HEADERS = frozenset("header site-header global-header top-header topbar".split())
#: In an article, a block that neighbours share is deleted only if so much of it is link text.
LINK_SHARE = 0.5


#: What markup says of a block: content, doubtful (only a neighbour's equal block makes it go), part of the site.
CONTENT, DOUBTFUL, PART = 0, 1, 2


class Block:
    __slots__ = ("inside", "kept", "linked", "role", "text")

    def __init__(self, text: str, role: int, inside: bool, linked: int):
        self.text, self.role, self.inside, self.linked = text, role, inside, linked
        self.kept = role != PART

    def key(self) -> int:
        """Hash of the text; a text in an article differs from the same one in a menu, which may name the article."""
        return xxhash.xxh3_64_intdigest(self.text.encode("utf-8", "surrogatepass"),
                                        int(self.inside and self.role != PART)) - (1 << 63)

    def open(self) -> bool:
        """Whether differencing may delete the block."""
        return not self.kept or self.role == DOUBTFUL or not self.inside or self.linked >= LINK_SHARE * len(self.text)


def _named(name: str) -> int:
    """What one class or id says: PART if it is made of NAMES and words beside them, DOUBTFUL if other words come in."""
    words = _PART.findall(name)
    if NAMES.isdisjoint(words):
        return CONTENT
    return PART if all(w in NAMES or w in BESIDE or w.isdigit() for w in words) else DOUBTFUL


def _role(tag: str, attributes: str, inside: bool) -> int:
    if tag in DROPPED or (tag == "header" and not inside):
        return PART
    found = CONTENT
    if not attributes or tag in ("body", "html", "article", "main"):
        return found
    for name, *values in _ATTRIBUTE.findall(attributes):
        for value in "".join(values).lower().split():
            if name.lower() == "role":
                found = max(found, PART if value in ROLES else CONTENT)
            else:
                found = max(found, PART if not inside and value in HEADERS else _named(value))
    return found


def blocks(html: str | None) -> list[Block]:
    """All blocks of text in page order, with what markup says of them; kept tells those that markup leaves.

    Text of a page part inside a block of content, such as an advert in a paragraph, is a block of its own after it.
    """
    if not html:
        return []
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, role, in an article, in a link
    parts: list[tuple[str, int, bool]] = []
    aside: list[tuple[str, int, bool]] = []
    state = (CONTENT, False, False)

    def flush() -> None:
        for found in (parts, aside):
            if found:
                text = " ".join(markup.unescape("".join(p for p, _, _ in found)).split())
                if text:
                    linked = sum(len(" ".join(markup.unescape(p).split())) for p, _, link in found if link)
                    out.append(Block(text, min(role for p, role, _ in found if not p.isspace()), state[1], linked))
                found.clear()

    def add(text: str) -> None:
        (aside if state[0] == PART else parts).append((text, state[0], state[2]))

    def pop_to(i: int) -> None:
        nonlocal state
        del stack[i:]
        state = stack[-1][1:] if stack else (CONTENT, False, False)

    done = 0
    for m in _TOKEN.finditer(html):
        if m.start() > done:
            add(html[done:m.start()])
        done = m.end()
        tag = m[3] or m[6]
        if m[1]:
            if m[1].lower() in ("textarea", "iframe", "select", "title"):
                flush()
            continue
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:
                    break  # an inline end tag doesn't close a block
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in BLOCKS:  # what the new block ends without an end tag
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" or (name == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option")):
                    pop_to(i)
                    break
                if name in BLOCKS:
                    break
        role, inside, linked = state
        inside = inside or tag in ("article", "main") or bool(attributes) and 'role="main"' in attributes.lower()
        state = (max(role, _role(tag, attributes, inside)), inside, linked or tag == "a")
        stack.append((tag, *state))
    if len(html) > done:
        add(html[done:])
    flush()
    if any(b.kept and b.inside for b in out):
        for b in out:
            b.kept = b.kept and b.inside
    return out


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.

    Ends that agree and items that only one side has are set aside. The rest is split in halves where the lengths of
    both sides' subsequences, as bit rows, add up to most (Hirschberg's division with bit-parallel rows), so memory
    stays in proportion to the lists.
    """
    start, end = 0, 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    both = set(a[start:len(a) - end]) & set(b[start:len(b) - end])
    left = [i for i in range(start, len(a) - end) if a[i] in both]
    right = [i for i in range(start, len(b) - end) if b[i] in both]
    pairs = [(i, i) for i in range(start)]
    _divide([a[i] for i in left], [b[i] for i in right], left, right, pairs)
    pairs += [(len(a) - end + i, len(b) - end + i) for i in range(end)]
    return pairs


def _row(a: list, b: list) -> list[int]:
    """Length of the subsequence of a and each beginning of b."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        u = row & masks.get(x, 0)
        row = ((row + u) | (row - u)) & full
    zeros = [0]
    zeros.extend(accumulate(bit == "0" for bit in reversed(format(row, f"0{len(b)}b"))))
    return zeros


def _divide(a: list, b: list, left: list[int], right: list[int], pairs: list) -> None:
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            pairs.append((left[0], right[b.index(a[0])]))
        return
    mid = len(a) // 2
    before, after = _row(a[:mid], b), _row(a[mid:][::-1], b[::-1])
    k = max(range(len(b) + 1), key=lambda j: before[j] + after[len(b) - j])
    _divide(a[:mid], b[:k], left[:mid], right[:k], pairs)
    _divide(a[mid:], b[k:], left[mid:], right[k:], pairs)


class _Pending:
    """The last page of a run of pages, waiting for its next neighbour."""

    row: dict | None = None
    shared: set[int]
    first: bool = True


_FIRST, _LAST = 1, 2
_PAGE = "host string, same bigint, lines array<bigint>, open array<int>"
_GONE = "host string, same bigint, gone array<int>"
_RESULT = "page_id bigint, url string, text string, n_chars bigint, n_deleted bigint, n_by_markup bigint"


def _lines(row: dict) -> Iterator[dict]:
    """A page as hashes of its blocks and the indexes of those that may be deleted."""
    parts = blocks(row["html"])
    yield {**{k: row[k] for k in ("id", "key", "host", "path", "same")},
           "lines": [b.key() for b in parts], "open": [i for i, b in enumerate(parts) if b.open()]}


def _compared(a: dict, b: dict) -> list[tuple[int, int]]:
    """Index pairs of the blocks that two neighbours have in common; none for other hosts' pages."""
    return [] if a["host"] != b["host"] else common_lines(a["lines"], b["lines"])


def _out(last: _Pending, end: bool) -> Iterator[dict]:
    """What goes of a page with both its neighbours in the task; a page at the task's edge goes on as it is."""
    edge = _FIRST * last.first + _LAST * end
    gone = sorted(last.shared.intersection(last.row["open"]))
    if edge:
        yield {**last.row, "edge": edge, "gone": gone}
    elif gone:
        yield {**{k: last.row[k] for k in ("host", "same", "part")}, "edge": edge, "gone": gone}


def _page(row: dict, last: _Pending) -> Iterator[dict]:
    shared = set()
    if last.row is not None:
        for i, j in _compared(last.row, row):
            last.shared.add(i)
            shared.add(j)
        yield from _out(last, end=False)
        last.first = False
    last.row, last.shared = row, shared


def _finish(last: _Pending) -> Iterator[dict]:
    if last.row is not None:
        yield from _out(last, end=True)


def _edge_pair(row: dict) -> Iterator[dict]:
    pairs = _compared(row["a"], row["b"])
    for side, k in (("a", 0), ("b", 1)):
        page = row[side]
        yield {"host": page["host"], "same": page["same"], "gone": sorted({p[k] for p in pairs}.intersection(page["open"]))}


def _gone_at_edges(edges: DataFrame) -> DataFrame:
    """host, same, gone from comparing the last page of each task with the first of the next task that has pages."""
    # one row per task and only its number, so the window is short
    parts = edges.select("part").distinct().withColumn("next", F.lead("part").over(Window.orderBy("part")))
    page = F.struct("host", "same", "lines", "open")
    last = edges.where(F.col("edge") >= _LAST).join(parts, "part").select(F.col("next").alias("at"), page.alias("a"))
    first = edges.where(F.col("edge") % _LAST == _FIRST).select(F.col("part").alias("at"), page.alias("b"))
    return map_rows(last.join(first, "at").select("a", "b"), _edge_pair, _GONE)


def shared_blocks(pages: DataFrame) -> DataFrame:
    """host, same, gone (indexes of blocks) of the html that loses blocks to a neighbour; only hashes are shuffled.

    Equal html of a host is one page, at its first place in the order, so neighbours always differ. Pages without a block
    have nothing to lose and stay where they are.
    """
    rows = map_rows(pages.where("host IS NOT NULL"), _lines,
                    "id string, key bigint, host string, path string, same bigint, lines array<bigint>, open array<int>")
    rows = written(rows.withColumn("page", F.col("id").try_cast("bigint")), "page-lines")
    # equal html has equal blocks, so any row's lists will do
    place = F.struct("path", "page", "id", "key")
    alone = F.when(F.size("lines") == 0, F.struct("id", "key"))
    distinct = rows.groupBy("host", "same", alone.alias("alone")).agg(
        F.min(place).alias("at"), F.first("lines").alias("lines"), F.first("open").alias("open"))
    rows = written(distinct, "page-distinct")
    order = ["host", "path", "page", "id", "key"]
    ranged = (rows.select("host", "same", "lines", "open", "at.*").repartitionByRange(*order)
              .sortWithinPartitions(*order).drop(*order[1:]).withColumn("part", F.spark_partition_id()))
    compared = written(map_rows(ranged, _page, f"{_PAGE}, part int, edge int, gone array<int>", finish=_finish,
                                setup=_Pending), "page-neighbours")
    gone = compared.select("host", "same", "gone").unionByName(_gone_at_edges(compared.where("edge > 0")))
    # a page has two neighbours, so at most three lists
    return written(gone.where(F.size("gone") > 0).groupBy("host", "same").agg(
        F.flatten(F.collect_list("gone")).alias("gone")), "page-shared")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_deleted, n_by_markup for every row of pages (page_id, url, html).

    Blocks in page order, joined by line feeds; white space in a block becomes single blanks. All blocks of a page, menus
    and footers too, are compared with those of its neighbours on the same host, and those that a neighbour has too are
    deleted (n_deleted): everywhere outside a marked article (or main part); inside it those that are mostly links or in an
    element whose name may or may not be that of a page part, since an article may quote another. Of the rest, markup takes
    out menus, headers, footers, adverts and the like, and what is outside the article if one is marked (n_by_markup). Pages
    of a host with equal html are compared once, at the first of their addresses, with the nearest different pages, and have
    equal texts: a copy doesn't count as a neighbour. Pages without blocks do.

    A null or empty html has an empty text. A null url or one without a host has no neighbours. Repeated rows give
    repeated results and other columns are ignored; an empty table gives no rows. Pages are dealt by ranges of host and
    path, with page_id last so that a host, or one address, may fill many tasks; pages at the edges of tasks are compared
    afterwards, so the result doesn't depend on the ranges.

    Neighbours are found on hashes of blocks; what goes is then joined to the pages, which are read twice.
    """
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = pages.select("page_id", "url", "html", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"),
                        F.xxhash64("url", "html").alias("key"), host.alias("host"), path.alias("path"),
                        F.xxhash64("html").alias("same"))
    gone = shared_blocks(rows.drop("page_id", "url"))

    def each(row):
        parts, out = blocks(row["html"]), set(row["gone"] or ())
        text = "\n".join(b.text for i, b in enumerate(parts) if b.kept and i not in out)
        yield {"page_id": row["page_id"], "url": row["url"], "text": text, "n_chars": len(text), "n_deleted": len(out),
               "n_by_markup": sum(not b.kept and i not in out for i, b in enumerate(parts))}

    joined = hot_join(rows, gone, ["host", "same"], F.struct("id", "key"), "left")
    return map_rows(joined.select("page_id", "url", "html", "gone"), each, _RESULT)
