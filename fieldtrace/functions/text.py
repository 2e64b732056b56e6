"""Text and URL functions; built-in expressions wherever Spark has them."""

from __future__ import annotations

import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Python's white space: Unicode's and the four ASCII separators.
_WS = r"[\s\x1c-\x1f\x85]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_WS}+|{_WS}+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(strip(text), rf"(?U){_WS}+", " ")


def line_ends(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


@pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@pandas_udf(StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


@pandas_udf(StringType())
def resolve_url(bases: pd.Series, links: pd.Series) -> pd.Series:
    def one(base, link):
        try:
            return urljoin(base or "", link)
        except ValueError:
            return None

    return pd.Series([None if link is None else one(b, link) for b, link in zip(bases, links)], dtype=object)


def words(text: Column) -> Column:
    """Words (letters, digits, underscore) in lower case, joined by one blank."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1), " ")


def folded(text: Column) -> Column:
    """Full case folding; ASCII texts, whose folding is lower case, never leave the JVM."""
    ascii_only = text.rlike(r"^\p{ASCII}*$")
    return F.when(ascii_only, F.lower(text)).otherwise(casefold(F.when(~ascii_only, text)))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def ascii_words(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), " ")


def bare_url(url: Column) -> Column:
    """Without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")


def url_tail(url: Column) -> Column:
    return F.element_at(F.split(bare_url(url), "/"), -1)


def model_number(name: Column, url: Column) -> Column:
    """The first group of capitals, digits and dashes with a digit; else the URL's tail."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"\b([A-Z]+[-]?[0-9][A-Z0-9-]*)\b", 1), F.lit("")), url_tail(url))


def alias_of(text: Column, aliases: dict[str, list[str]]) -> Column:
    """The first alias any of whose marks occurs in the text, else the text."""
    out = None
    for name, marks in aliases.items():
        hit = F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(F.lower(text), m))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(text) if out is not None else text


def top_level_ids(path: Column) -> Column:
    return F.split(path, r"\.")


def path_depth(path: Column) -> Column:
    return F.size(top_level_ids(path))


def reply_json(reply: Column) -> Column:
    """The first {...} of a free-text reply, as a variant; null if there is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit("")))
