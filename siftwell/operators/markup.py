"""Markup as a reader of tags sees it: what stands in comments, scripts and other raw elements holds no tags.

One pattern reads a page once from left to right. At each place it takes a whole comment, a raw element with all of its content, or a
whole tag with its quoted attribute values, so a comment inside a script, a script inside a comment and a ``<!--`` or ``>`` inside a
quoted value are what they are in their place. All repetitions are possessive or lazy over single characters, so long
pages need no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content is text.
RAW = ["script", "style", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp"]
# End of the fixed values.

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_COMMENT = r"<!--(?:-?>|[\s\S]*?(?:--!?>|\z))"
_RAW = rf"(?<open><(?<name>{'|'.join(RAW)})(?=[\s/>]){_ATTRIBUTES}>)[\s\S]*?(?=</\k<name>[\s/>]|\z)"
_TITLE = rf"(?<title><title(?=[\s>]){_ATTRIBUTES}>[^<]*+)[\s\S]*?(?=</title[\s/>]|\z)"
_TAG = rf"(?<tag></?[a-zA-Z]{_ATTRIBUTES}>)"
# All of it begins with "<": the look-ahead passes other characters at little cost.
TOKENS = f"(?i)(?=<)(?:{_COMMENT}|{_RAW}|{_TITLE}|{_TAG})"
COMMENTS = f"(?i)(?=<)(?:(?<comment>{_COMMENT})|{_RAW}|{_TITLE}|{_TAG})"


def tags_only(html: Column) -> Column:
    """html with comments gone and the content of raw elements gone; of a title the text before any further ``<`` stays."""
    return F.regexp_replace(html, TOKENS, "${open}${title}${tag}")


def comments_only(html: Column) -> Column:
    """html with its comments, but no tags and no content of raw elements."""
    return F.regexp_replace(html, COMMENTS, "${comment}")
