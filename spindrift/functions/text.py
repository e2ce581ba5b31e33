"""Text functions: normalisation, terms, token counts, topics, ids, HTML cleaning. Columns in, columns out, all JVM-side
but for the compatibility normalisation of non-ASCII text, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as white space, as a term and as a token.
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
TERM = r"[a-z0-9ı]+|[\x{3400}-\x{9fff}]"
TOKEN = r"[A-Za-z0-9_]+|[\x{3400}-\x{9fff}]|[^\s\x1c-\x1f\x{85}\p{Z}]"
CJK = r"[\x{3400}-\x{9fff}]"
PREFACE = "前言"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


#: Characters that the compatibility composition never changes or combines: ASCII, most Latin letters and signs, CJK.
STABLE_LATIN = r"\x00-\x7f\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{ff}"
STABLE = STABLE_LATIN + r"\x{100}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{20ac}\x{3001}-\x{3029}\x{3400}-\x{9fff}"


def nfkc(c: Column) -> Column:
    """Compatibility composition. Texts of stable characters pass through as they are: the function sees a null instead."""
    plain = (F.octet_length(c) == F.length(c)) | ~c.rlike(f"[^{STABLE_LATIN}]") | ~c.rlike(f"[^{STABLE}]")
    return F.coalesce(_nfkc(F.when(plain, F.lit(None).cast("string")).otherwise(c)), c)


def collapse(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def _split_camel(c: Column, compatibility: bool) -> Column:
    return F.regexp_replace(nfkc(c) if compatibility else c, "([a-z0-9])([A-Z])", "$1 $2")


def normalize(c: Column, compatibility: bool = True) -> Column:
    """Compatibility form, camel case split, '::', '_' and '/' as spaces, lower case, single spaces."""
    return collapse(F.lower(F.regexp_replace(_split_camel(c, compatibility), "::|[_/]", " ")))


def terms(c: Column, compatibility: bool = True) -> Column:
    """Terms of a text in order: runs of a-z and 0-9, and single CJK characters, of the normalised text (what normalising does
    to white space and to characters that are in no term is left out)."""
    return F.regexp_extract_all(F.lower(_split_camel(c, compatibility)), F.lit(TERM), F.lit(0))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7f]")


def normalized_source(c: Column) -> Column:
    """A path with forward slashes, without doubled slashes and '.' steps."""
    x = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/(?:\\./)+", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^(?:\\./)+", ""), "(?<=.)/{2,}", "/"), "(?<=[^/])/(?:\\.)?$", "")


def topic_of(source: Column) -> Column:
    """First step of a path."""
    return F.split_part(F.replace(source, F.lit("\\"), F.lit("/")), F.lit("/"), F.lit(1))


def chunk_id(source: Column, heading: Column, text: Column) -> Column:
    """Content-derived id: SHA-256 of source, heading and text with NULs between."""
    return F.sha2(F.concat(source, F.lit("\0"), heading, F.lit("\0"), text), 256)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def clean_html(c: Column) -> Column:
    """Four character references decoded one after the other, white space collapsed."""
    for old, new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return collapse(c)
