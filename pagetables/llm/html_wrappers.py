"""Main text of web pages by wrappers inferred for each host.

A page becomes a stream of block tags and texts.  Its wrapper is a union-free regular
expression over them: repeated neighbours are folded into a repeated group, text into a
slot.  The wrappers of a host are aligned one after the other: what both have stays, what
only one has becomes optional, a part that one repeats becomes repeated, and the insides of
matched parts are aligned in turn.  Wrappers of parts of a host are aligned in the same
way, so a large host is inferred in pieces.  Equal wrappers are counted first: a host has
few different ones, however many pages it has.

Every text slot of a host's wrapper then gets a role.  It is left out if it lies in a menu,
header, footer, side bar, notice, advert, form or the readers' comments, by its tags and
their classes; or if it stands once on each page, outside an article, with the same text on
pages whose texts differ.  A page gives the texts of its article slots, or else of all that
are left.  So where pages have article tags, these decide; the wrappers decide on the others.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import pick, settled

#: Pieces of a host whose wrappers are inferred apart.
PIECES = 16
#: Different pages on which a slot has one and the same text for it to be a part of the host's
#: design.  Copies of a page count once.
SAME_ON = 5
#: Elements nested deeper are read as parts of the one at this depth; their texts stay.
DEPTH = 64

#: Tags by how they are read.
_SILENT = frozenset("script style noscript template svg iframe textarea select button audio video head title".split())
#: Of these the rest of the page is a part if no end tag follows.
_RAW = frozenset("script style textarea".split())
_BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul caption".split()
)
_CLOSES_P = _BLOCKS - frozenset("html body li dd dt td th tr tbody thead tfoot caption legend figcaption summary".split())
_SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
}
_FRAMES = frozenset(("table", "ul", "ol", "dl", "menu", "body", "article", "main", "section"))
#: Parts of a page that are not its article.
_APART = frozenset("nav aside footer form menu dialog search".split())
_APART_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|side-?bar|menu|nav\w*|breadcrumbs?|footer|site-?header|masthead|cookies?|"
    r"consent|gdpr|newsletter|subscribe|popup|modal|recommend\w*|comments?|"
    r"disqus|respond|replies|widget|toolbar|pagination|pager|login|sign-?up)(?:$|[-_ ])"
    # words that also name a subject: a whole name, or one of a usual part
    r"|(?:^| )(?:(?:top|page|site|post|article)[-_])?(?:banner|notices?|alert|share|sharing|social|related|search)"
    r"(?:[-_](?:links?|icons?|buttons?|bars?|box|list|media|posts|articles|stories|form|inner|container|wrapper|block|text|message|info|warning|success|danger|error))?(?:$| )"
)
#: Of an article's own names only these tell that it is none.
_NO_ARTICLE = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|related|recommend\w*|comments?|replies)(?:$|[-_ ])")
_APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ENDS: dict[str, re.Pattern] = {}


class _Open:
    """An open element: its path, whether it is apart, and whether it is in an article (1) or main (2)."""

    __slots__ = ("tag", "path", "apart", "article", "inside")

    def __init__(self, tag: str, path: str, apart: bool, article: int, inside: list) -> None:
        self.tag, self.path, self.apart, self.article, self.inside = tag, path, apart, article, inside


def _signature(tag: str, raw: str) -> tuple[str, str, str]:
    names, role = [], ""
    if "=" in raw:
        for key, *values in _NAMED.findall(raw):
            value = "".join(values).lower()
            if key.lower() == "role":
                role = value.strip()
            else:
                names += value.split()
    plain = sorted({re.sub(r"[\d/]+", "", n).strip("-_") for n in names} - {""})
    return ".".join((tag, *plain)) + (f"@{role}" if role else ""), " ".join(names), role


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Where the tag from ``at`` ends, quoted values skipped; -1 if it does not.

    ``last`` has the last place of each quote, so that none is looked for in vain.
    """
    end = html.find(">", at)
    if end < 0:
        return -1
    quoted = at
    while True:
        double, single = html.find('"', quoted, end), html.find("'", quoted, end)
        if double < 0 and single < 0:
            return end
        opens = min(x for x in (double, single) if x >= 0)
        if opens == last[html[opens]]:
            return end
        close = html.find(html[opens], opens + 1)
        quoted = close + 1
        if close > end:
            end = html.find(">", close)
            if end < 0:
                return -1


def read_page(html: str) -> tuple[list[tuple[str, bool, int, str]], list]:
    """Texts as (path, apart, in article or main, text), and the stream of the page's blocks.

    A silent element without an end tag before that of its block ends at the next block.
    """
    root = _Open("", "", False, 0, [])
    stack, texts, held, open_tags = [root], [], [], Counter()
    muted, ends = False, {}

    def next_end(tag: str, at: int) -> int:
        """Where the next end tag of a name begins, behind the page if there is none."""
        if tag not in ends or ends[tag] < at:
            if tag not in _ENDS:
                _ENDS[tag] = re.compile(rf"</{tag}\b", re.I)
            found = _ENDS[tag].search(html, at)
            ends[tag] = found.start() if found else len(html)
        return ends[tag]

    def flush() -> None:
        nonlocal muted
        muted = False
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                top = stack[-1]
                texts.append((top.path, top.apart, top.article, text))
                top.inside.append(("#", "", ()))

    def close(n: int) -> None:
        flush()
        while len(stack) > n:
            done = stack.pop()
            open_tags[done.tag] -= 1
            if done.inside is not stack[-1].inside:
                stack[-1].inside.append((done.path.rsplit("/", 1)[-1], "", fold(done.inside)))

    at, size = 0, len(html)
    last = {quote: html.rfind(quote) for quote in "\"'"}
    while at < size:
        next_tag = html.find("<", at)
        if next_tag < 0:
            held.append("" if muted else html[at:])
            break
        if next_tag > at and not muted:
            held.append(html[at:next_tag])
        if html.startswith("<!--", next_tag):
            end = html.find("-->", next_tag + 4)
            at = size if end < 0 else end + 3
            continue
        found = _TAG.match(html, next_tag)
        if not found:
            if html.startswith(("<!", "<?", "</"), next_tag):
                end = html.find(">", next_tag)
                at = size if end < 0 else end + 1
            else:
                held.append("<")
                at = next_tag + 1
            continue
        end = _tag_end(html, found.end(), last)
        if end < 0:
            break
        tag, opening, raw = found[1].lower(), html[next_tag + 1] != "/", html[found.end() : end]
        at = end + 1
        if tag in _SILENT:
            if opening and not raw.endswith("/"):
                stop = next_end(tag, at)
                limit = size if tag in _RAW or len(stack) == 1 else next_end(stack[-1].tag, at)
                if stop < min(limit, size) or (stop < size and tag in _RAW):
                    end = html.find(">", stop)
                    at = size if end < 0 else end + 1
                elif tag in _RAW:
                    at = size
                elif tag not in ("head", "title"):
                    muted = True
            held.append(" ")
        elif tag in _BLOCKS:
            if opening:
                if stack[-1].tag == "p" and tag in _CLOSES_P:
                    close(len(stack) - 1)
                if any(open_tags[name] for name in _SIBLINGS.get(tag, ())):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in _SIBLINGS[tag]:
                            close(i)
                        elif stack[i].tag in _FRAMES:
                            break
                flush()
                top = stack[-1]
                signature, names, role = _signature(tag, raw)
                main, is_article = tag == "main" or role == "main", tag == "article" or role == "article"
                article = 2 if main else max(top.article, int(is_article))
                telling = None if main or tag in ("html", "body") else _NO_ARTICLE if is_article else _APART_NAMES
                apart = (
                    top.apart
                    or tag in _APART
                    or (tag == "header" and not top.article)
                    or role in _APART_ROLES
                    or (bool(names) and telling is not None and bool(telling.search(names)))
                )
                deep = len(stack) > DEPTH
                path, inside = (top.path, top.inside) if deep else (f"{top.path}/{signature}", [])
                stack.append(_Open(tag, path, apart, article, inside))
                open_tags[tag] += 1
            elif open_tags[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
            else:
                flush()
        elif tag == "hr":
            flush()
        elif tag in ("br", "img", "wbr", "input"):
            held.append(" ")
    close(1)
    return texts, fold(root.inside)


# A wrapper is a sequence of (signature, multiplicity, inside); multiplicity holds "?" if the
# part can be absent and "+" if it can repeat; a text slot is "#", a group of parts "()".


def _either(a: str, b: str) -> str:
    return "".join(sorted(set(a) | set(b)))


def _label(part: tuple) -> str:
    return part[0] if part[0] != "()" else "()" + ",".join(_label(p) for p in part[2])


def _joined(a: tuple, b: tuple, more: str = "") -> tuple:
    return (a[0], _either(_either(a[1], b[1]), more), align(a[2], b[2]))


def fold(parts) -> tuple:
    """Neighbouring equal parts, or equal groups of two or three, become repeated ones."""
    parts = list(parts)
    for size in (1, 2, 3):
        i, out = 0, []
        while i < len(parts):
            group = parts[i : i + size]
            labels = [_label(p) for p in group]
            j, times = i + size, 1
            while len(group) == size and [_label(p) for p in parts[j : j + size]] == labels:
                group = [_joined(a, b) for a, b in zip(group, parts[j : j + size], strict=True)]
                j, times = j + size, times + 1
            if times == 1:
                out.append(parts[i])
                i += 1
            else:
                if size == 1:
                    out.append((group[0][0], _either(group[0][1], "+"), group[0][2]))
                else:
                    out.append(("()", "+", tuple(group)))
                i = j
        parts = out
    return tuple(parts)


def align(a: tuple, b: tuple) -> tuple:
    """The least wrapper found for both: longest common parts, the rest optional."""
    if a == b:
        return a
    x, y = [_label(p) for p in a], [_label(p) for p in b]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(_joined(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            out.append((a[i][0], _either(a[i][1], "?"), a[i][2]))
            i += 1
        else:
            out.append((b[j][0], _either(b[j][1], "?"), b[j][2]))
            j += 1
    return fold(out)


def as_text(wrapper: tuple) -> str:
    """The wrapper as a regular expression."""
    return " ".join(
        ("#" if s == "#" else f"({as_text(inside)})" if s == "()" else f"<{s}>({as_text(inside)})")
        + ("*" if m == "+?" else m)
        for s, m, inside in wrapper
    )


def _frozen(parts: list) -> tuple:
    return tuple((s, m, _frozen(inside)) for s, m, inside in parts)


def slots(wrapper: tuple, path: str = "", repeated: bool = False) -> Iterator[tuple[str, bool]]:
    """Path of every text slot, and whether it can repeat on a page."""
    for signature, many, inside in wrapper:
        again = repeated or "+" in many
        if signature == "#":
            yield path, again
        elif signature == "()":
            yield from slots(inside, path, again)
        else:
            yield from slots(inside, f"{path}/{signature}", again)


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``host``, ``wrapper`` (as JSON), ``expression`` and ``pages`` of every host."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [json.dumps(read_page(t or "")[1]) for t in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(forms, pa.string())], ["host", "form"])

    def infer(group: pa.Table) -> pa.Table:
        forms = sorted(zip(group["form"].to_pylist(), group["pages"].to_pylist(), strict=True))
        wrapper = None
        for form, _ in forms:
            form = _frozen(json.loads(form))
            wrapper = form if wrapper is None else align(wrapper, form)
        return pa.table(
            {
                "host": group["host"][:1],
                "form": pa.array([json.dumps(wrapper)]),
                "pages": pa.array([sum(n for _, n in forms)], pa.int64()),
            }
        )

    rows = pick(pages, url="string", html="string").select(_host().alias("host"), "html")
    forms = rows.mapInArrow(read, "host string, form string").groupBy("host", "form").agg(F.count("*").alias("pages"))
    piece = F.pmod(F.xxhash64("form"), F.lit(PIECES)).alias("piece")
    shape = "host string, form string, pages bigint"
    pieces = forms.groupBy("host", piece).applyInArrow(infer, shape)
    return pieces.groupBy("host").applyInArrow(infer, shape).withColumnRenamed("form", "wrapper")


def slot_roles(pages: DataFrame) -> DataFrame:
    """``host`` and ``design``: paths, in JSON, whose text belongs to the host's design."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                found = [(path, text) for path, apart, article, text in read_page(html or "")[0] if not apart and not article]
                whole = hashlib.blake2b(json.dumps(found).encode(), digest_size=8).digest()
                page = int.from_bytes(whole, "big", signed=True)
                for path, text in found:
                    out.append((host, path, zlib.crc32(text.encode()) << 20 | len(text) & 0xFFFFF, page))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            names = ["host", "path", "mark", "page"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    rows = pick(pages, url="string", html="string").select(_host().alias("host"), "html")
    marks = rows.mapInArrow(read, "host string, path string, mark bigint, page bigint")
    low, high = F.min("mark").alias("low"), F.max("mark").alias("high")
    same = (
        # pages with the same texts count once
        marks.groupBy("host", "path", "page")
        .agg(low, high)
        .groupBy("host", "path")
        .agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where((F.col("low") == F.col("high")) & (F.col("n") >= SAME_ON))
        .groupBy("host")
        .agg(F.collect_set("path").alias("same"))
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wrapper, found in zip(batch["wrapper"].to_pylist(), batch["same"].to_pylist(), strict=True):
                once: dict[str, bool] = {}
                for path, again in slots(_frozen(json.loads(wrapper))):
                    once[path] = path not in once and not again
                out.append(json.dumps(sorted(p for p in set(found or ()) if once.get(p))))
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(out, pa.string())], ["host", "design"])

    wrappers = settled(host_wrappers(pages), "wrappers")
    return wrappers.select("host", "wrapper").join(same, "host", "left").mapInArrow(choose, "host string, design string")


def main_text(html: str, design: frozenset[str] = frozenset()) -> str:
    """The texts of the article slots of a page, or else of all slots that are left; one a line."""
    texts, _ = read_page(html)
    inside = [(place, t) for _, apart, place, t in texts if place and not apart]
    main, other = [t for place, t in inside if place == 2], [t for place, t in inside if place == 1]
    # Teasers often stand beside the main part as articles: the longer one of both counts.
    article = main if sum(map(len, main)) >= sum(map(len, other)) else other
    return "\n".join(article or [t for path, apart, _, t in texts if not apart and path not in design])


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    A null or empty page has an empty text.  Pages without a host share one wrapper.  A page
    that ends inside a comment, script or tag is read up to there.  Rows are returned as
    often as they come; other columns are ignored.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[str]] = {}
        for batch in batches:
            out = []
            for html, design in zip(batch["html"].to_pylist(), batch["design"].to_pylist(), strict=True):
                design = design or "[]"
                if design not in known:
                    known[design] = frozenset(json.loads(design))
                out.append(main_text(html or "", known[design]))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string())], ["page_id", "url", "text"])

    roles = settled(slot_roles(pages), "roles").withColumnRenamed("host", "_host")
    rows = pick(pages, page_id="bigint", url="string", html="string").withColumn("host", _host())
    joined = rows.join(roles, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "design")
    texts = joined.mapInArrow(extract, "page_id bigint, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))
