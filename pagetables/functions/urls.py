"""URL parsing, resolution and resource keys as column expressions.

`parse_url` and `resolve_url` follow the WHATWG rules.  A parsed URL is a struct;
an invalid one is NULL.  Hosts whose names need composition or compatibility mapping
are not supported and count as invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .cache import by_name, once
from .exprs import let
from .hosts import ascii_host, ipv6

# Special schemes and their default ports, and characters that stay
# unescaped in each URL part.
_DEFAULT_PORTS = (("http", "80"), ("https", "443"), ("ws", "80"), ("wss", "443"), ("ftp", "21"))
_SPECIAL_SCHEMES = ("http", "https", "ws", "wss", "ftp", "file")
_KEPT_IN_OPAQUE = r"\x20-\x7E"
_KEPT_IN_QUERY = r"!$-;=?-~"
_KEPT_IN_SPECIAL_QUERY = r"!$-&(-;=?-~"
_KEPT_IN_PATH = r"!$-;=@-\]_a-z|~"
_KEPT_IN_USERINFO = r"!$-.0-9A-Z_a-z~"
_FORBIDDEN_IN_HOST = r"[\x00-\x20\x7F#/:<>?@\[\\\]^|%]"
# File name endings of assets.
_ASSET_EXTENSIONS = (
    "avif", "bmp", "css", "gif", "ico", "jpeg", "jpg", "js", "json", "map", "mp3", "mp4", "pdf", "png", "svg", "txt",
    "webm", "webp", "woff", "woff2",
)

ASSET_PATTERN = rf"(?i)\.(?:{'|'.join(_ASSET_EXTENSIONS)})\z"

# A URL already in normal form: lower-case http(s) host whose last label is a name,
# no port, no user, no dot segment, nothing to escape.  Group 1 has no query or hash.
_PLAIN_URL = (
    r"(?s)\A(https?://(?!\.)(?![^/]*\.\.)(?:[a-z0-9_.-]*\.)?[a-z][a-z0-9_-]*"
    r"(?![^?#]*/(?:\.|%2[eE]){1,2}(?:[/?#]|\z))"
    r"/[A-Za-z0-9._~!$&'()*+,;=:@%/-]*)(?:[?#].*)?\z"
)
_PLAIN_PATH = (
    r"(?s)\A(?![^#]*/(?:\.|%2[eE]){1,2}(?:[/#]|\z))"
    r"/(?!/)[A-Za-z0-9._~!$&'()*+,;=:@%/-]*(?:#.*)?\z"
)
_DOT_SEGMENT = r"(?i)/(?:\.|%2e){1,2}(?=/|\z)"


def _escape(text: Column, kept: str) -> Column:
    """Percent-encode every run of characters outside ``kept``."""

    def encode(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(rf"[{kept}]+|[^{kept}]+"), F.lit(0))
        return F.array_join(
            F.transform(
                runs,
                lambda run: F.when(F.rlike(run, F.lit(rf"\A[{kept}]")), run).otherwise(
                    _escape_run(run)
                ),
            ),
            "",
        )

    return let(text, lambda t: F.when(F.rlike(t, F.lit(rf"[^{kept}]")), encode(t)).otherwise(t))


def _escape_run(run: Column) -> Column:
    # Form encoding differs from percent encoding in the blank and a few marks
    # that it leaves alone.
    encoded = F.regexp_replace(F.url_encode(run), r"\+", "%20")
    return F.regexp_replace(F.regexp_replace(encoded, r"\*", "%2A"), "'", "%27")


def _without_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..``: neighbouring stretches of the path are joined in rounds.

    A stretch is how many steps it takes back from what is before it, and the names it
    leaves.  A round joins the stretches two by two, so that names are copied once in a
    round and there are as many rounds as the number of steps has bits.
    """

    def stretch(step: Column) -> Column:
        dots = F.regexp_replace(step, "(?i)%2e", ".")
        return F.struct(
            F.when(dots == "..", 1).otherwise(0).alias("back"),
            F.when(dots.isin(".", ".."), F.array().cast("array<string>")).otherwise(F.array(step)).alias("names"),
        )

    def joined(left: Column, right: Column) -> Column:
        kept = F.size(left.names) - right.back
        return F.when(right.isNull(), left).otherwise(
            F.struct(
                (left.back + F.greatest(-kept, F.lit(0))).alias("back"),
                F.concat(F.slice(left.names, F.lit(1), F.greatest(kept, F.lit(0))), right.names).alias("names"),
            )
        )

    def round_(done: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.shiftright(F.size(done) - 1, 1))
        return F.transform(
            pairs, lambda i: let(F.struct(F.get(done, 2 * i).alias("a"), F.get(done, 2 * i + 1).alias("b")), lambda p: joined(p.a, p.b))
        )

    def walk(p: Column) -> Column:
        def resolved(steps: Column) -> Column:
            rounds = F.sequence(F.lit(1), F.length(F.bin(F.size(steps))))
            names = F.aggregate(rounds, F.transform(steps, stretch), round_)[0].names
            # A dot segment at the end leaves an empty name there.
            ends_in_dots = F.rlike(F.element_at(steps, -1), F.lit(r"\A(?i:\.|%2e){1,2}\z"))
            ending = F.when(ends_in_dots, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
            return F.concat(F.lit("/"), F.array_join(F.concat(names, ending), "/"))

        return let(let(F.split(p, "/"), lambda s: F.slice(s, 2, F.size(s))), resolved)

    return let(path, lambda p: F.when(F.rlike(p, F.lit(_DOT_SEGMENT)), walk(p)).otherwise(p))


def _ipv4(host: Column) -> Column:
    """Dotted form of a host whose last label is a number, NULL if not valid."""
    parts = F.split(F.regexp_replace(host, r"\.\z", ""), r"\.")

    def number(part: Column) -> Column:
        hexadecimal = F.regexp_extract(part, r"\A0x([0-9a-f]{0,8})\z", 1)
        octal = F.regexp_extract(part, r"\A0([0-7]{1,11})\z", 1)
        return (
            F.when(F.rlike(part, F.lit(r"\A0x\z")), F.lit(0).cast("bigint"))
            .when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("bigint"))
            .when(octal != "", F.conv(octal, 8, 10).cast("bigint"))
            .when(F.rlike(part, F.lit(r"\A(?:0|[1-9][0-9]{0,9})\z")), part.cast("bigint"))
        )

    def assemble(numbers: Column) -> Column:
        leading = F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0)))
        room = F.get(F.array(*[F.lit(256**n).cast("bigint") for n in (4, 3, 2, 1)]), F.size(numbers) - 1)
        valid = (
            F.size(numbers).between(1, 4)
            & F.forall(numbers, lambda n: n.isNotNull())
            & F.forall(leading, lambda n: n <= 255)
            & (F.element_at(numbers, -1) < room)
        )
        weighted = F.transform(leading, lambda n, i: F.when(i == 0, n * 16777216).when(i == 1, n * 65536).otherwise(n * 256))
        value = F.aggregate(weighted, F.element_at(numbers, -1), lambda acc, n: acc + n)
        return F.when(
            valid,
            let(
                value,
                lambda v: F.concat_ws(
                    ".",
                    *[F.shiftright(v, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)],
                ),
            ),
        )

    return let(F.transform(parts, number), assemble)


def _special_host(written: Column) -> Column:
    """Normal form of a host of a special scheme, NULL if not valid."""
    unescaped = F.when(
        F.contains(written, F.lit("%")), F.try_url_decode(F.regexp_replace(written, r"\+", "%2B"))
    ).otherwise(written)

    def check(host: Column) -> Column:
        return (
            F.when((host == "") | F.rlike(host, F.lit(_FORBIDDEN_IN_HOST)), None)
            .when(F.rlike(host, F.lit(r"(?:\A|\.)(?:[0-9]+|0x[0-9a-f]*)\.?\z")), _ipv4(host))
            .otherwise(host)
        )

    def address(host: Column) -> Column:
        bracketed = F.regexp_extract(host, r"\A\[([0-9a-f:.]+)\]\z", 1)
        name = F.when(F.rlike(host, F.lit(r"[^\x00-\x7F]")), ascii_host(host)).otherwise(host)
        return F.when(bracketed != "", F.concat(F.lit("["), ipv6(bracketed), F.lit("]"))).otherwise(let(name, check))

    return let(F.lower(unescaped), address)


def _port_suffix(scheme: Column, port: Column) -> Column:
    """``:port`` or nothing for a default port, NULL if not valid."""
    default = F.lit(None).cast("string")
    for name, number in _DEFAULT_PORTS:
        default = F.when(scheme == name, F.lit(number)).otherwise(default)

    def check(p: Column) -> Column:
        return (
            F.when(p == "", "")
            .when(~F.rlike(p, F.lit(r"\A[0-9]{1,5}\z")), None)
            .when(p.cast("int") > 65535, None)
            .when(default.eqNullSafe(p), "")
            .otherwise(F.concat(F.lit(":"), p))
        )

    return let(F.regexp_replace(F.coalesce(port, F.lit("")), "^0+(?=.)", ""), check)


def _userinfo(written: Column) -> Column:
    def write(u: Column) -> Column:
        user = _escape(F.regexp_extract(u, r"(?s)\A([^:]*)", 1), _KEPT_IN_USERINFO)
        password = _escape(F.regexp_extract(u, r"(?s)\A[^:]*:(.*)\z", 1), _KEPT_IN_USERINFO)
        return let(
            F.struct(user.alias("user"), password.alias("password")),
            lambda c: F.when((c.user == "") & (c.password == ""), "").otherwise(
                F.concat(
                    c.user,
                    F.when(c.password == "", "").otherwise(F.concat(F.lit(":"), c.password)),
                    F.lit("@"),
                )
            ),
        )

    return let(written, lambda u: F.when(u == "", "").otherwise(write(u)))


def _resolve(written: Column, base: Column | None) -> Column:
    def base_field(name: str, otherwise) -> Column:
        return F.lit(otherwise) if base is None else base[name]

    def split_scheme(raw: Column) -> Column:
        scheme = F.lower(F.regexp_extract(raw, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))
        return F.struct(
            scheme.alias("scheme"),
            F.regexp_replace(F.regexp_replace(raw, r"\A[A-Za-z][A-Za-z0-9+.-]*:", ""), r"(?s)#.*\z", "").alias("rest"),
            F.startswith(raw, F.lit("#")).alias("hash_only"),
        )

    def split_query(s: Column) -> Column:
        own = s.scheme != ""
        scheme = F.when(own, s.scheme).otherwise(base_field("scheme", None))
        special = scheme.isin(*_SPECIAL_SCHEMES)
        head = F.regexp_replace(s.rest, r"(?s)\?.*\z", "")
        return F.struct(
            own.alias("own"),
            scheme.alias("scheme"),
            F.coalesce(special, F.lit(False)).alias("special"),
            F.when(special, F.regexp_replace(head, r"\\", "/")).otherwise(head).alias("head"),
            F.regexp_extract(s.rest, r"(?s)(\?.*)\z", 1).alias("query"),
            s.hash_only.alias("hash_only"),
        )

    def find_kind(s: Column) -> Column:
        same_scheme = F.lit(False) if base is None else (s.scheme == base.scheme)
        slashes = F.startswith(s.head, F.lit("//"))
        web = s.special & (s.scheme != "file")
        starts_authority = F.when(web & s.own & ~same_scheme, True).otherwise(slashes)
        kind = (
            F.when(s.scheme.isNull(), "invalid")
            .when(s.own & ~s.special & ~F.startswith(s.head, F.lit("/")), "opaque")
            .when(~s.own & base_field("opaque", False), F.when(s.hash_only, "same").otherwise("invalid"))
            .when(starts_authority, "authority")
            .when(s.own & ~same_scheme, "path")
            .when(s.own & ~s.special, "path")
            .when(F.startswith(s.head, F.lit("/")), "absolute")
            .when((s.head == "") & (s.query == ""), "same")
            .when(s.head == "", "query")
            .otherwise("relative")
        )
        after = F.when(web, F.regexp_replace(s.head, r"\A/+", "")).otherwise(F.regexp_replace(s.head, r"\A//", ""))
        return F.struct(s.alias("s"), kind.alias("kind"), after.alias("after"))

    def split_authority(k: Column) -> Column:
        authority = F.regexp_extract(k.after, r"(?s)\A([^/]*)", 1)
        place = F.regexp_replace(authority, r"(?s)\A.*@", "")
        return F.struct(
            k.s.alias("s"),
            k.kind.alias("kind"),
            _userinfo(F.regexp_extract(authority, r"(?s)\A(.*)@", 1)).alias("userinfo"),
            F.regexp_extract(place, r"(?s)\A(\[[^\]]*\]|[^:\[\]]*)(?::.*)?\z", 1).alias("host"),
            _port_suffix(k.s.scheme, F.regexp_extract(place, r"(?s)\A(?:\[[^\]]*\]|[^:\[\]]*):(.*)\z", 1)).alias("port"),
            F.regexp_replace(k.after, r"(?s)\A[^/]*", "").alias("path"),
        )

    def join_parts(a: Column) -> Column:
        s = a.s
        own_place = a.kind == "authority"
        host = F.when(
            own_place,
            F.when((s.scheme == "file") & (a.host == ""), "").when(s.special, _special_host(a.host)).otherwise(
                _escape(a.host, _KEPT_IN_OPAQUE)
            ),
        )
        own_path = a.kind.isin("path", "opaque")
        keep_base_path = a.kind.isin("same", "query")
        path = (
            F.when(own_place, a.path)
            .when(own_path | (a.kind == "absolute"), s.head)
            .when(keep_base_path, base_field("path", None))
            .when(
                a.kind == "relative",
                F.concat(F.regexp_extract(base_field("path", None), r"(?s)\A.*/", 0), s.head)
                if base is not None
                else F.lit(None).cast("string"),
            )
        )
        return F.struct(
            s.scheme.alias("scheme"),
            s.special.alias("special"),
            ((a.kind == "opaque") | ((a.kind == "same") & base_field("opaque", False))).alias("opaque"),
            F.when(own_place, host).when(own_path, "").otherwise(base_field("host", None)).alias("host"),
            F.when(own_place, F.concat(F.lit("//"), a.userinfo, host, a.port))
            .when(own_path & (s.scheme == "file"), "//")
            .when(own_path, "")
            .otherwise(base_field("place", None))
            .alias("place"),
            F.when(own_place, F.concat(host, a.port))
            .when(own_path, "")
            .otherwise(base_field("site", None))
            .alias("site"),
            F.when(F.startswith(path, F.lit("/")), path)
            .when(s.special, F.concat(F.lit("/"), path))
            .otherwise(path)
            .alias("path"),
            F.when(a.kind == "same", base_field("query", "")).otherwise(s.query).alias("query"),
            (a.kind == "invalid").alias("invalid"),
        )

    def finish(p: Column) -> Column:
        path = F.when(p.opaque, _escape(p.path, _KEPT_IN_OPAQUE)).otherwise(
            _without_dot_segments(_escape(p.path, _KEPT_IN_PATH))
        )
        query = F.when(p.special, _escape(p.query, _KEPT_IN_SPECIAL_QUERY)).otherwise(_escape(p.query, _KEPT_IN_QUERY))
        web = p.scheme.isin("http", "https", "ws", "wss", "ftp")
        return F.when(
            ~p.invalid & p.place.isNotNull() & p.path.isNotNull(),
            F.struct(
                p.scheme.alias("scheme"),
                p.opaque.alias("opaque"),
                p.host.alias("host"),
                p.place.alias("place"),
                p.site.alias("site"),
                F.when(web, F.concat(p.scheme, F.lit("://"), p.site)).alias("origin"),
                path.alias("path"),
                query.alias("query"),
            ),
        )

    value = F.regexp_replace(F.regexp_replace(written, r"\A[\x00-\x20]+|(?<![\x00-\x20])[\x00-\x20]++\z", ""), r"[\t\n\r]", "")
    for step in (split_scheme, split_query, find_kind, split_authority, join_parts, finish):
        value = let(value, step)
    return value


@by_name
def parse_url(url: Column) -> Column:
    """Parsed absolute URL as a struct, NULL if not valid."""
    return _resolve(url, None)


def resolve_url(href: Column, base: Column) -> Column:
    """Parsed ``href`` relative to the parsed URL ``base``, NULL if not valid.

    Plain site-relative and plain absolute links take a short way.
    """

    def site_relative(h: Column) -> Column:
        same = ("scheme", "opaque", "host", "place", "site", "origin")
        return F.struct(
            *[base[name].alias(name) for name in same],
            F.regexp_replace(h, r"(?s)#.*\z", "").alias("path"),
            F.lit("").alias("query"),
        )

    def absolute(h: Column) -> Column:
        host = F.regexp_extract(h, r"\A[a-z]+://([^/]*)", 1)
        return F.struct(
            F.regexp_extract(h, r"\A([a-z]+):", 1).alias("scheme"),
            F.lit(False).alias("opaque"),
            host.alias("host"),
            F.concat(F.lit("//"), host).alias("place"),
            host.alias("site"),
            F.regexp_extract(h, r"\A([a-z]+://[^/]*)", 1).alias("origin"),
            F.regexp_extract(h, r"\A[a-z]+://[^/]*([^?#]*)", 1).alias("path"),
            F.lit("").alias("query"),
        )

    return (
        F.when(F.rlike(href, F.lit(_PLAIN_PATH)) & (base.scheme.isin("http", "https")), site_relative(href))
        .when(F.rlike(href, F.lit(_PLAIN_URL)) & ~F.contains(href, F.lit("?")), absolute(href))
        .otherwise(_resolve(href, base))
    )


@once
def resolve_urls(hrefs: str, base: str) -> Column:
    """`resolve_url` over an array column, by column names."""
    return F.transform(F.col(hrefs), lambda href: resolve_url(href, F.col(base)))


def url_text(parsed: Column, query: bool = True) -> Column:
    """Text of a parsed URL without its fragment."""
    parts = [parsed.scheme, F.lit(":"), parsed.place, parsed.path]
    return F.concat(*parts, parsed.query) if query else F.concat(*parts)


@by_name
def page_url(url: Column) -> Column:
    """Normalized URL without query and hash, NULL if not valid."""
    plain = F.nullif(F.regexp_extract(url, _PLAIN_URL, 1), F.lit(""))
    return F.coalesce(plain, let(parse_url(url), lambda p: url_text(p, query=False)))


@by_name
def resource_key(url: Column) -> Column:
    return F.concat(F.lit("page:"), page_url(url))


def url_path(page: Column) -> Column:
    """Path of a URL made by `page_url`."""
    return F.regexp_replace(page, r"(?s)\A[a-z][a-z0-9+.-]*:(?://[^/]*)?", "")


def url_host(page: Column) -> Column:
    """Host and port of a URL made by `page_url`."""
    return F.regexp_extract(page, r"(?s)\A[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/]*)", 1)
