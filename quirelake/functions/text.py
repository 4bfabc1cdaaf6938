"""Scalar functions with the semantics of the usual scripting-language ones, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense, as a character class for Java and RE2 alike.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HAN = r"[\x{4e00}-\x{9fff}]"
FORMULA_SIGNS = "[∑∫∂√π∞Δλ→≈∈⊂]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def rfind(c: Column, what: str) -> Column:
    """0-based position of the last occurrence of ``what``, -1 without any."""
    at = F.locate(what[::-1], F.reverse(c))
    return F.when(at > 0, F.length(c) - at - len(what) + 1).otherwise(-1)


def tokens(c: Column) -> Column:
    """Lower-case tokens between white space; a token with Han characters falls into its characters."""
    words = F.filter(F.split(F.lower(c), f"{SPACE}+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(HAN), F.filter(F.split(w, ""), lambda x: x != "")).otherwise(F.array(w))))


def token_estimate(c: Column) -> Column:
    """Half the characters, rounded down: the estimate where no tokenizer is at hand."""
    return F.floor(F.length(c) / 2).cast("int")


def formula_flag(c: Column) -> Column:
    return c.rlike(FORMULA_SIGNS)


def content_key(c: Column) -> Column:
    """16 hex digits of the content's SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def pair_key(a: Column, b: Column) -> Column:
    """12 hex digits of the MD5 of both, joined by a bar."""
    return F.substring(F.md5(F.concat_ws("|", a, b)), 1, 12)


def estimated_pages(text_length: Column) -> Column:
    """A page per 3000 characters, at least one."""
    return F.greatest(F.lit(1), F.floor(text_length / 3000)).cast("int")
