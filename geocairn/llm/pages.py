"""Main text of web pages by nearest-URL page differencing.

Pages of one host are put in order of their URL path, so that the page with the longest common path stands next to each. A page's lines (its
blocks of text) are aligned with those of its neighbours in that order by longest common subsequence, and lines that it shares with them are the
site's, not the page's. Markup is the exact check beside it: what an <article> holds stays though neighbours quote or copy it, and what markup
names as menu, footer, advert, form, comment and so on goes though no neighbour has it.

Lines travel as hashes; texts move once, and only where something is taken out of them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keep

#: Neighbours on each side that a page is aligned with.
NEIGHBOURS = 3
#: A neighbour with this share of a page's text is taken for a copy of it, and tells nothing of the site.
COPY = 0.8
#: Pages of one content that meet what is known of it in one task; rows of removals that are small enough to be sent to all tasks.
SALT_ROWS, SENT = 4096, 100_000
#: Places of the order that one task aligns.
RUN_PLACES = 256
LINE = "struct<hash:bigint,size:int,block:int>"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
_RAW = {t: re.compile(f"</{t}(?=[\\s/>]|$)", re.I) for t in "script style textarea title iframe noembed noframes noscript xmp".split()}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a sibling's start ends, and the elements that bound how far it looks.
_OPTIONAL = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements, roles and words of class and id that are no main text, whatever they hold.
_GONE_TAGS = frozenset("nav footer aside dialog menu button select datalist template svg canvas audio video object applet map search".split())
_GONE_ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_GONE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo comment comments commentlist disqus replies "
    "respond related recommended recommendations cookie cookies consent gdpr newsletter subscribe signup login popup modal share sharing social".split()
)
#: Words of class and id that are no main text but where an article or a main element stands within.
_SOFT_WORDS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead topbar banner notice notices notification alert pagination pager skip".split())
_HEADERS = frozenset("header site-header page-header".split())
_BODIES = frozenset("article-body article-content articlebody article__body post-content post-body entry-content story-body".split())

_QUOTE = re.compile("[\"']")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)([^?#]*)")
#: States: in an article, in the main element, elsewhere, in a form, in a header of an article, in what gives way to an article, in what is gone.
ARTICLE, MAIN, OPEN, FORM, HEAD_OF_ARTICLE, SOFT, GONE = range(7)


def _state(tag: str, attributes: str, now: int) -> int:
    """The state within an element that starts in state `now`."""
    if now == GONE:
        return GONE
    if tag in ("article", "main"):
        inner = ARTICLE if tag == "article" or now == ARTICLE else MAIN
    elif tag == "header":
        inner = HEAD_OF_ARTICLE if now == ARTICLE else max(now, SOFT)
    elif tag in _GONE_TAGS or tag == "head":
        inner = GONE
    elif tag == "form":
        inner = FORM if now in (MAIN, OPEN) else GONE if now == ARTICLE else now
    elif tag in _HEADINGS and now == HEAD_OF_ARTICLE:
        inner = ARTICLE
    else:
        inner = now
    low = attributes.lower()
    if tag in ("html", "body") or not ("class" in low or "id" in low or "role" in low or "itemprop" in low):
        return inner
    values = {k: a or b or c for k, a, b, c in _ATTRIBUTE.findall(low)}
    role, names = values.get("role", ""), f"{values.get('class', '')} {values.get('id', '')}".split()
    if role in _GONE_ROLES:
        return GONE
    words = {w for name in names if not name.startswith(("no-", "has-", "with-", "without-")) for w in re.split(r"[^a-z0-9]+", name)}
    if words & _GONE_WORDS:
        return GONE
    if tag not in ("article", "main") and (words & _SOFT_WORDS or role == "banner" or (now != ARTICLE and _HEADERS & set(names))):
        return SOFT
    if role == "article" or values.get("itemprop") == "articlebody" or _BODIES & set(names):
        return ARTICLE
    return MAIN if role == "main" and inner != ARTICLE else inner


def page_lines(html: str) -> list[tuple[str, int]]:
    """The blocks of text of a page with the state each stands in: references decoded, white space made one space, empty ones left out."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements and the state outside of them
    open_: Counter = Counter()
    text: list[str] = []
    state, at, end = OPEN, 0, len(html)
    closing: dict[str, int] = {}  # where a quote was looked for in vain

    def flush() -> None:
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.append((line, state))
            text.clear()

    def pop(k: int) -> None:
        nonlocal state
        if any(s != state for _, s in stack[k:]):
            flush()
        state = stack[k][1]
        for tag, _ in stack[k:]:
            open_[tag] -= 1
        del stack[k:]

    def add(piece: str) -> None:
        text.append(unescape(piece) if "&" in piece else piece)

    while at < end:
        start = html.find("<", at)
        if start < 0:
            add(html[at:])
            break
        if start > at:
            add(html[at:start])
        following = html[start + 1 : start + 2]
        if following in ("!", "?") or (following == "/" and not html[start + 2 : start + 3].isalpha()):
            if html.startswith("<!--", start):
                stop = start + 5 if html.startswith(">", start + 4) else html.find("-->", start + 4) + 3
                at = stop if stop > start + 3 else end
            else:
                stop = html.find(">", start)
                at = stop + 1 if stop >= 0 else end
            continue
        closes = following == "/"
        name = _NAME.match(html, start + 1 + closes)
        if not name or not name.group()[0].isascii():
            text.append("<")
            at = start + 1
            continue
        i = name.end()
        stop = html.find(">", i)
        while stop >= 0:  # the end of the tag, past quoted values
            quote = _QUOTE.search(html, i, stop)
            if not quote:
                break
            q, sort = quote.start(), quote.group()
            second = -1
            if html[i:q].rstrip().endswith("=") and q < closing.get(sort, end):
                second = html.find(sort, q + 1)
                if second < 0:
                    closing[sort] = q
            i = max(q, second) + 1
            if second > stop:
                stop = html.find(">", i)
        if stop < 0:
            break  # a tag that the text ends in
        tag, attributes, at = name.group().lower(), html[name.end() : stop], stop + 1
        block = tag in _BLOCK
        if block:
            flush()
        elif tag == "br":
            text.append(" ")
        if closes:
            if open_[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if block or not any(t in _BLOCK and t not in _OPTIONAL and t != "p" for t, _ in stack[k + 1 :]):
                    pop(k)
            continue
        if open_["head"] and tag not in _IN_HEAD:
            k = len(stack) - 1
            while stack[k][0] != "head":
                k -= 1
            pop(k)
        if block and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        if tag in _OPTIONAL and (open_[tag] or (tag in ("dt", "dd", "td", "th") and any(open_[t] for t in _OPTIONAL))):
            k, alike = len(stack) - 1, {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            while k >= 0 and stack[k][0] not in alike and (stack[k][0] in _OPTIONAL or stack[k][0] == "p") and stack[k][0] not in _OPTIONAL[tag]:
                k -= 1
            if k >= 0 and stack[k][0] in alike:
                pop(k)
        if tag in _VOID:
            continue
        if tag in _RAW:
            found = _RAW[tag].search(html, at)
            at = found.start() if found else end
            continue
        inner = _state(tag, attributes, state)
        if block and tag != "p" or inner != state or open_[tag]:
            if inner != state:
                flush()
            stack.append((tag, state))
            open_[tag] += 1
            state = inner
    flush()
    return out


def main_lines(lines: list[tuple[str, int]]) -> tuple[list[int], bool]:
    """Numbers of the lines that may be main text: those of articles if there are any, else of the main element, else those elsewhere, else those of
    a form round the page; and whether they are an article's."""
    for state in (ARTICLE, MAIN, OPEN, FORM):
        found = [i for i, (_, s) in enumerate(lines) if s == state]
        if found:
            return found, state == ARTICLE
    return [], False


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Numbers of the lines of a on one longest common subsequence with b: bit-parallel rows, those between every so many computed anew on the way back."""
    in_a, in_b = set(a), set(b)
    rows, columns = [i for i, x in enumerate(a) if x in in_b], [x for x in b if x in in_a]
    head = 0
    while head < min(len(rows), len(columns)) and a[rows[head]] == columns[head]:
        head += 1
    out, rows, columns = rows[:head], rows[head:], columns[head:]
    if not rows or not columns:
        return out
    where: dict[int, int] = {}
    for j, x in enumerate(columns):
        where[x] = where.get(x, 0) | 1 << j
    full, every = (1 << len(columns)) - 1, max(1, int(len(rows) ** 0.5))

    def step(v: int, i: int) -> int:
        u = v & where.get(a[rows[i]], 0)
        return ((v + u) | (v - u)) & full

    marks, v = [full], full  # before rows 0, every, 2 * every, ...
    for i in range(len(rows)):
        v = step(v, i)
        if (i + 1) % every == 0:
            marks.append(v)
    column, back = len(columns) - 1, []
    top = (len(rows) - 1) // every
    for k in range(top, -1, -1):
        after = [marks[k]]
        for i in range(k * every, min(len(rows), (k + 1) * every)):
            after.append(step(after[-1], i))
        for i in range(len(after) - 2, -1, -1):  # row k * every + i; a bit is 0 where the common length grows
            while column >= 0 and after[i + 1] >> column & 1:
                column -= 1
            if column < 0:
                break
            if after[i] >> column & 1:
                back.append(rows[k * every + i])
                column -= 1
        if column < 0:
            break
    return out + back[::-1]


def shared_lines(lines: list[tuple[int, int, int]], others: list[list[int]], copy: float = COPY) -> tuple[int, list[int]]:
    """Of a page's lines (hash, size, number of the block or -1) and its neighbours' hashes: how many neighbours aren't copies, and the numbers of
    the lines that at least half of these share."""
    hashes, total = [x[0] for x in lines], sum(x[1] for x in lines)
    votes, n = Counter(), 0
    for other in others:
        common = common_lines(hashes, other)
        if sum(lines[i][1] for i in common) < copy * total:
            n += 1
            votes.update(common)
    return n, sorted(i for i, k in votes.items() if 2 * k >= n)


def parsed_pages(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, url, blocks (what may be main text), host, path, lines (hash, size, block: its place in blocks, -1 for lines that differencing
    can't take away) and a, b, which tell apart host, path and lines."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("blocks", "host", "path", "lines", "a", "b")}
            for address, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                lines = page_lines(body.as_py() or "")
                own, marked = main_lines(lines)
                place = {} if marked else {i: k for k, i in enumerate(own)}
                m = _URL.match((address or "").strip())
                host = m and m.group(1).lower().removeprefix("www.")
                hashed = [(int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little", signed=True), len(s), place.get(i, -1)) for i, (s, _) in enumerate(lines)]
                path = m.group(2).rstrip("/") if m else None
                mark = hashlib.blake2b(repr((host, path, hashed)).encode(), digest_size=16).digest()
                row = ([lines[i][0] for i in own], host or None, path, [dict(zip(("hash", "size", "block"), x, strict=True)) for x in hashed])
                row += tuple(int.from_bytes(mark[k : k + 8], "little", signed=True) for k in (0, 8))
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            kinds = [pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.struct([("hash", pa.int64()), ("size", pa.int32()), ("block", pa.int32())])), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], names=["page_id", "url", *out])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(task, f"page_id {pages.schema[page_id].dataType.simpleString()}, url string, blocks array<string>, host string, path string, lines array<{LINE}>, a long, b long")


def by_neighbours(variants: DataFrame, task, schema: str, kinds: pa.Schema, reach: int = NEIGHBOURS) -> DataFrame:
    """What task(row, others) gives for each of variants (host, path, a, b, n, lines), a row of the schema's columns (kinds: the same for Arrow) or
    None: others are the hashes of the lines of those up to so many places before and after it among its host's, in order of path.

    The order is one over all hosts, by ranges, so that a host of very many pages is many tasks; places are numbered by each range's count. Runs of
    places, with those just before and after, go to one task, so that lines move once.
    """
    spread = cut(variants.repartitionByRange("host", "path", "a", "b").sortWithinPartitions("host", "path", "a", "b"))
    numbered = spread.withColumn("__id", F.monotonically_increasing_id()).withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")
    counts = numbered.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a range
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = numbered.join(before, "__part").withColumn("place", F.col("__before") + F.col("__at"))
    runs = F.array_distinct(F.array(*[F.floor((F.col("place") + k) / RUN_PLACES) for k in (-reach, 0, reach)]))
    dealt = placed.select("a", "b", "n", "host", "lines", "place", F.explode(runs).alias("run"))

    def unit(data: pa.Table) -> pa.Table:
        data = data.sort_by("place")
        run, places, hosts, lines = data.column("run")[0].as_py(), data.column("place").to_pylist(), data.column("host").to_pylist(), data.column("lines")
        hashes = [x.values.field("hash").to_pylist() for x in lines]
        out = []
        for i, place in enumerate(places):
            if place // RUN_PLACES == run:
                others = [hashes[j] for j in range(max(0, i - reach), min(len(places), i + reach + 1)) if j != i and hosts[j] == hosts[i]]
                row = task({"a": data.column("a")[i].as_py(), "b": data.column("b")[i].as_py(), "n": data.column("n")[i].as_py(), "lines": lines[i].as_py()}, others)
                if row is not None:
                    out.append(row)
        return pa.Table.from_pylist(out, kinds)

    return dealt.groupBy("run").applyInArrow(unit, schema)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", reach: int = NEIGHBOURS, copy: float = COPY) -> DataFrame:
    """One row per row of pages: page_id, url, text and n_chars (its code points).

    text: the blocks of the page's article, in order, joined by one space; of a page that marks no article, those of its main element or else
    all, without the lines that it shares with at least half of its neighbours by URL path on the host that aren't copies of it. Menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and comments that markup names go in any case. Headings of an article stay.

    Null and empty html, and pages with no such block, give an empty text. Pages whose URL is null or names no host have no neighbours. Rows that repeat, null ids
    and rows of one id are each answered for themselves; other columns are ignored; an empty table gives an empty result. Tags that the text ends in are dropped.
    """
    parsed = keep(parsed_pages(pages, page_id, url, html))
    variants = parsed.where("host is not null").groupBy("a", "b").agg(F.count("*").alias("n"), F.first("host").alias("host"), F.first("path").alias("path"), F.first("lines").alias("lines"))

    def align(row: dict, others: list[list[int]]) -> dict | None:
        own = [(x["hash"], x["size"], x["block"]) for x in row["lines"]]
        shared = shared_lines(own, others, copy)[1]
        gone = [own[i][2] for i in shared if own[i][2] >= 0]
        return {"a": row["a"], "b": row["b"], "n": row["n"], "gone": gone} if gone else None

    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("gone", pa.list_(pa.int32()))])
    found = cut(by_neighbours(variants, align, "a long, b long, n long, gone array<int>", kinds, reach))
    size = found.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    if not size:
        out = parsed.withColumn("kept", F.col("blocks"))
    else:
        salts = found.withColumn("__salts", F.ceil(F.col("n") / SALT_ROWS).cast("int"))
        # contents of very many pages meet their removals in several tasks
        salts = salts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).select("a", "b", "salt", "__salts", "gone")
        many = salts.where("__salts > 1 and salt = 0").select("a", "b", "__salts")
        hot = parsed.join(F.broadcast(many) if size <= SENT else many, ["a", "b"], "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
        met = hot.join(F.broadcast(salts.drop("__salts")) if size <= SENT else salts.drop("__salts"), ["a", "b", "salt"], "left")
        out = met.withColumn("kept", F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda x, i: ~F.array_contains("gone", i))))
    text: Column = F.array_join("kept", " ")
    return out.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
