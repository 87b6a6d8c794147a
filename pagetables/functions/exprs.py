"""Small combinators for composing large column expressions.

Every builder reads its input exactly once.  A value needed in several places is
bound with :func:`let`, so plans grow linearly with the number of steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Unicode noncharacters: never valid in interchanged text, so they can mark
# positions inside a string.  `scrub` removes them from the input first.
MARK = "\ufdd0"
SEP = "\ufdd1"
ERROR_MARK = "\ufdd2"
TAG_MARK = "\ufdd3"
_RESERVED = MARK + SEP + ERROR_MARK + TAG_MARK


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def scrub(text: Column) -> Column:
    """Replace reserved marker characters with U+FFFD."""
    found = F.contains(text, F.lit(_RESERVED[0]))
    for mark in _RESERVED[1:]:
        found = found | F.contains(text, F.lit(mark))
    return F.when(found, F.translate(text, _RESERVED, "\ufffd" * len(_RESERVED))).otherwise(text)


def rewrite(text: Column, pattern: str, template: str, fn: Callable[[Column], Column]) -> Column:
    """Regex replace whose replacement is a column expression.

    ``template`` (``$1`` groups allowed) is what ``fn`` receives for every match.
    The text is scanned by the pattern once; odd pieces of the split are matches.
    """
    return F.array_join(
        F.transform(
            pieces(text, pattern, template), lambda piece, i: F.when(i % 2 == 1, fn(piece)).otherwise(piece)
        ),
        "",
    )


def matches(text: Column, pattern: str, template: str) -> Column:
    """Array with ``template`` expanded for every match of ``pattern``, in order."""
    return F.filter(pieces(text, pattern, template), lambda piece, i: i % 2 == 1)


def pieces(text: Column, pattern: str, template: str) -> Column:
    """Text between matches at even places, ``template`` per match at odd ones."""
    return F.split(F.regexp_replace(text, pattern, MARK + template + MARK), MARK)


def up_to_last(text: Column, end: str, fn: Callable[[Column], Column]) -> Column:
    """Apply ``fn`` to the text up to the last ``end`` only.

    For patterns that end with ``end``: no match can begin behind the last one, where
    every beginning would be followed to the end of the text in vain.
    """
    return let(
        text,
        lambda t: let(
            F.regexp_extract(t, rf"(?is)\A.*{end}", 0),
            lambda head: F.when(head == "", t).otherwise(F.concat(fn(head), F.substr(t, F.length(head) + 1))),
        ),
    )


def error(message: Column) -> Column:
    """Text that marks a failed value inside a document under construction."""
    return F.concat(F.lit(ERROR_MARK), message, F.lit(ERROR_MARK))


def first_error(text: Column) -> Column:
    """Message of the first failed value in ``text``, NULL if there is none."""
    return F.when(
        F.contains(text, F.lit(ERROR_MARK)),
        F.regexp_extract(text, f"(?s){ERROR_MARK}([^{ERROR_MARK}]*){ERROR_MARK}", 1),
    )


def before_sep(piece: Column) -> Column:
    return F.substring_index(piece, SEP, 1)


def after_sep(piece: Column) -> Column:
    return F.substring_index(piece, SEP, -1)


def settle(frame: DataFrame, *columns: Column | str) -> DataFrame:
    """Select ``columns`` so that they are computed once per row.

    A filter on a computed column is normally pushed down by repeating its
    expression, which multiplies a long chain of projections.  A generator is a
    line that such filters do not cross.
    """
    return frame.select(F.inline(F.array(F.struct(*columns))))
