"""Markup type of a text: from its declared content type, else from weighted pattern counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skychart.functions.bind import let

MARKDOWN, RST, PLAIN = "markdown", "rst", "plain"

# The patterns whose occurrences are counted, with W a word character and S a white
# space character of Unicode, and (?dm) making only a line feed end a line.
_W = r"[\p{L}\p{N}_]"
_S = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
RST_DIRECTIVE = rf"\.\.{_S}+{_W}+::"
RST_UNDERLINE = r"\n[=\-~`#\"^+*]{3,}\n"
RST_FIELD = rf":{_W}+:"
RST_ROLE = r"`[^`]+`_"
MD_HEADER = rf"(?dm)^#{{1,6}}{_S}+{_W}+"
MD_LINK = r"(?d)\[.+?\]\(.+?\)"
MD_IMAGE = r"(?d)!\[.*?\]\(.+?\)"
MD_BOLD = rf"\*\*{_W}+\*\*|__{_W}+__"
MD_FENCE = r"```"

# The white space characters of Unicode.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def rst_score(text: Column) -> Column:
    """Fields count only from the second on."""
    fields = let(_count(text, RST_FIELD), lambda n: F.when(n >= 2, 2 * n).otherwise(0))
    return (
        5 * _count(text, RST_DIRECTIVE) + 3 * _count(text, RST_UNDERLINE) + fields + _count(text, RST_ROLE)
    )


def markdown_score(text: Column) -> Column:
    """An image also counts as the link it contains."""
    return (
        3 * (_count(text, MD_HEADER) + _count(text, MD_LINK) + _count(text, MD_IMAGE))
        + 2 * _count(text, MD_FENCE)
        + _count(text, MD_BOLD)
    )


def content_type_from_metadata(declared: Column) -> Column:
    declared = F.lower(declared)
    return (
        F.when(declared.contains("markdown"), MARKDOWN).when(declared.contains("rst"), RST).otherwise(PLAIN)
    )


def content_type_heuristic(text: Column) -> Column:
    """Texts under 10 characters are plain; a tie goes to markdown."""

    def decide(score: Column) -> Column:
        rst, markdown = score["rst"], score["markdown"]
        return F.when((rst > 0) & (rst > markdown), RST).when(markdown > 0, MARKDOWN).otherwise(PLAIN)

    scores = F.struct(rst_score(text).alias("rst"), markdown_score(text).alias("markdown"))
    return F.when(text.isNull() | (F.length(strip(text)) < 10), PLAIN).otherwise(let(scores, decide))


def content_type(text: Column, declared: Column | None = None) -> Column:
    """The declared type wins whenever it is given, even when empty."""
    if declared is None:
        return content_type_heuristic(text)
    return F.when(declared.isNotNull(), content_type_from_metadata(declared)).otherwise(
        content_type_heuristic(text)
    )
