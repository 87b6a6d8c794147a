"""Text rules: tags, entities, whitespace, attributes.

Whitespace classes and word boundaries are spelled out, because Java's ``\\s``,
``\\b``, ``.`` and ``$`` differ from the web platform's.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .exprs import TAG_MARK, error, let, rewrite, up_to_last

# White space and line ends as the web platform defines them.  In the
# patterns the rare ones stand behind a range test, so that two tests decide most
# characters.
_RARE_SPACES = r"[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
_BLANKS = r"\t\x0B\f\r \xA0" + _RARE_SPACES
SPACE = r"\n" + _BLANKS
_SPACE_CHARACTERS = "\n\t\v\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Runs that are not already one plain blank.
_UNEVEN_SPACE = rf"(?: (?=[{SPACE}])|[{SPACE}&&[^ ]])[{SPACE}]*"
LINE_ENDS = r"\n\r\u2028\u2029"
NOT_WORD_AHEAD = r"(?![A-Za-z0-9_])"
NOT_WORD_BEHIND = r"(?<![A-Za-z0-9_])"


def open_tag(name: str) -> str:
    """Pattern of an opening tag; ``name`` is a regex fragment."""
    return f"<{name}{NOT_WORD_AHEAD}[^>]*>"


def element(name: str) -> str:
    """Pattern of an element with a named close tag; group 1 is the inside."""
    return f"(?is){open_tag(name)}(.*?)</{name}>"


def _marked(text: Column, tag: str, from_here: Column) -> Column:
    return F.concat(
        F.substr(text, F.lit(1), from_here),
        F.regexp_replace(F.substr(text, from_here + 1), f"(?i)<(?={tag}{NOT_WORD_AHEAD})", TAG_MARK),
    )


def disarm(text: Column, *tags: str) -> Column:
    """Mark the opening tags that no end tag of their name follows.

    Where the last end tag begins there must be a ``>`` between it and the opening tag.
    All opening tags left are complete and have an end tag, so a pattern for whole
    elements finds one wherever it begins and reads the text a fixed number of times.
    `rearm` takes the marks away.
    """
    for tag in tags:
        text = let(
            text,
            lambda t, tag=tag: F.when(
                F.rlike(t, F.lit(f"(?i)<{tag}{NOT_WORD_AHEAD}")),
                let(F.length(F.regexp_extract(t, rf"(?is)\A(.*>)[^>]*</{tag}>", 1)), lambda n: _marked(t, tag, n)),
            ).otherwise(t),
        )
    return text


def rearm(text: Column) -> Column:
    return F.replace(text, F.lit(TAG_MARK), F.lit("<"))


def first_in_stretch(text: Column, tag: str) -> Column:
    """Mark opening tags behind another one of their name without a ``>`` between."""
    opening = f"(?i)<{tag}{NOT_WORD_AHEAD}"
    return let(
        text,
        lambda t: F.when(
            F.rlike(t, F.lit(f"{opening}[^>]*<{tag}{NOT_WORD_AHEAD}")),
            rewrite(
                t,
                f"{opening}([^>]*)",
                "$1",
                lambda rest: F.concat(F.lit(f"<{tag}"), F.replace(rest, F.lit("<"), F.lit(TAG_MARK))),
            ),
        ).otherwise(t),
    )


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE_CHARACTERS))


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(f"[^{SPACE}]"))


def strip_tags(text: Column) -> Column:
    """Remove tags without leaving a space."""
    return up_to_last(text, ">", lambda head: F.regexp_replace(head, "<[^>]+>", ""))


def attribute(attrs: Column, name: str) -> Column:
    """Quoted attribute value, NULL if absent.  The name is not word-bounded."""
    pattern = rf"(?i){name}[{SPACE}]*=[{SPACE}]*([\"'])([^{LINE_ENDS}]*?)\1"
    return F.when(F.rlike(attrs, F.lit(pattern)), F.regexp_extract(attrs, pattern, 2))


# --- entities -----------------------------------------------------------------

# Entity patterns and replacements, applied in this order.
_TEXT_ENTITIES = (
    ("(?i)&nbsp;", " "),
    ("(?i)&amp;", "&"),
    ("(?i)&lt;", "<"),
    ("(?i)&gt;", ">"),
    ("(?i)&quot;", '"'),
    ("&#39;", "'"),
    ("(?i)&apos;", "'"),
)
_XML_ENTITIES = (
    ("(?i)&amp;", "&"),
    ("(?i)&lt;", "<"),
    ("(?i)&gt;", ">"),
    ("(?i)&quot;", '"'),
    ("&#39;", "'"),
)
# Code points that exist, and those without a usable character
# (surrogates and the reserved markers), in decimal and hexadecimal digits.
_EXISTING = {
    10: r"\A0*(?:[0-9]{1,6}|10[0-9]{5}|110[0-9]{4}|111[0-3][0-9]{3}|11140[0-9]{2}|111410[0-9]|111411[01])\z",
    16: r"(?i)\A0*(?:[0-9a-f]{1,5}|10[0-9a-f]{4})\z",
}
_UNUSABLE = {
    10: r"\A0*(?:5529[6-9]|55[3-9][0-9]{2}|56[0-9]{3}|57[0-2][0-9]{2}|573[0-3][0-9]|5734[0-3]|6497[678])\z",
    16: r"(?i)\A0*(?:d[89a-f][0-9a-f]{2}|fdd[012])\z",
}


def _replace_all(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in table:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _character(digits: Column, base: int) -> Column:
    """Character for a code point written in ``base``; one that does not exist is an error."""
    significant = F.regexp_replace(digits, "^0+(?=.)", "")
    if base == 10:
        hexadecimal, decimal = F.conv(digits, 10, 16), significant
    else:
        hexadecimal = significant
        decimal = F.when(F.length(significant) <= 15, F.conv(significant, 16, 10)).otherwise(significant)
    return (
        F.when(F.rlike(digits, F.lit(_UNUSABLE[base])), "\ufffd")
        .when(
            F.rlike(digits, F.lit(_EXISTING[base])),
            # The byte order mark in front is dropped, not one that the entity names.
            F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(hexadecimal, 8, "0"))), "UTF-32"),
        )
        .otherwise(error(F.concat(F.lit("Invalid code point "), decimal)))
    )


def _numeric_entities(text: Column) -> Column:
    text = rewrite(text, "&#([0-9]+);", "$1", lambda digits: _character(digits, 10))
    return rewrite(text, "(?i)&#x([0-9a-f]+);", "$1", lambda digits: _character(digits, 16))


def decode_entities(text: Column) -> Column:
    """Decode the supported entities; ``&amp;`` goes first, so it may uncover others."""
    return let(
        text,
        lambda t: F.when(
            F.contains(t, F.lit("&")), _numeric_entities(_replace_all(t, _TEXT_ENTITIES))
        ).otherwise(t),
    )


def decode_xml(text: Column) -> Column:
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), _replace_all(t, _XML_ENTITIES)).otherwise(t))


def inline_text(text: Column) -> Column:
    """One line of text: no tags, entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(decode_entities(strip_tags(text)), _UNEVEN_SPACE, " "))


def squeeze_blank_lines(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalize_markdown(text: Column) -> Column:
    """Decode, trim every line, allow one blank line in a row, trim the whole."""
    lines = F.transform(F.split(decode_entities(text), "\n"), trim_space)
    return squeeze_blank_lines(F.array_join(lines, "\n"))
