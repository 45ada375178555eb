"""Column functions on texts: cleaning, snippets, bylines, query words, identifiers."""

from __future__ import annotations

import unicodedata
from urllib.parse import urljoin as _urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words left out of a query's key terms.
KEY_TERM_STOP = "el la de que y a en es se los las por con un una para del al este esto han son haya sea".split()

# Endings put to a query for a web search.
VARIANT_ENDINGS = ["actualidad", "noticias", "últimas noticias"]

_EDGE = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"


def strip(text: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.regexp_replace(text, _EDGE, "")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility-composed form; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean_normalized(text: Column) -> Column:
    """The cleaning rules after composition: control characters but newline and tab go (so a lone carriage
    return vanishes), blanks and tabs become one blank, newlines lose the blanks around them, at most one
    blank line stays, the ends are trimmed. NULL gives ''."""
    text = F.regexp_replace(text, r"[\p{Cc}&&[^\n\t]]", "")
    text = F.regexp_replace(text, r"[\t ]+", " ")
    text = F.regexp_replace(text, r" *\n *", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.coalesce(strip(text), F.lit(""))


def clean_text(text: Column) -> Column:
    """Compatibility composition, only where a character beyond ASCII asks for it, then ``clean_normalized``."""
    return clean_normalized(F.when(text.rlike(r"[^\x00-\x7f]"), nfkc(text)).otherwise(text))


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x{1c}-\x{1f}]+", " ")


def drop_minute_by_minute(text: Column) -> Column:
    """A block without its live-ticker pointer, whatever its case."""
    return F.regexp_replace(text, r"(?i)[,;:.\-]?\s*MINUTO A MINUTO.*", "")


def drop_last_pointer(blocks: Column) -> Column:
    """``drop_minute_by_minute`` in the last of ``blocks`` only; a block that has nothing else goes."""
    last = strip(drop_minute_by_minute(F.try_element_at(blocks, F.lit(-1))))
    before = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    return F.when(F.size(blocks) == 0, blocks).when(last == "", before).otherwise(F.concat(before, F.array(last)))


def drop_photo_credits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)Foto:.*?(?=\n|$)", "")


def cut_author_tail(text: Column) -> Column:
    return F.substring_index(text, "\nAutor:", 1)


def drop_leading_byline(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)^Por .*\n", "")


def drop_bracketed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)\[.*?\]", "")


def _listed(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda a: a != "")


def byline_authors(text: Column, fallback: Column) -> Column:
    """Authors of a leading "Por A, B y C" within the first 300 characters, else ``fallback``."""
    found = F.regexp_extract(F.substring(text, 1, 300), r"(?d)^Por (.*?)(?:\s[-–—]\s|\n|$)", 1)
    return F.when(found != "", _listed(F.replace(found, F.lit(" y "), F.lit(", ")), ",")).otherwise(fallback)


def slash_authors(text: Column) -> Column:
    return _listed(text, "/")


def autor_paragraph(paragraph: Column) -> Column:
    """Authors of an "Autor: A, B y C" paragraph; NULL if it is none."""
    found = F.regexp_extract(strip(paragraph), r"(?is)^Autor(?:es)?:\s*(.*)$", 1)
    return F.when(found != "", _listed(found, r",| y "))


def drop_paragraph(paragraphs: Column, text: str) -> Column:
    return F.filter(paragraphs, lambda p: p != text)


def join_paragraphs(paragraphs: Column) -> Column:
    return F.array_join(paragraphs, "\n\n")


def snippet(text: Column, size: int = 200) -> Column:
    """The first ``size`` characters, with an ellipsis only if more follow."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def snippet_always(text: Column, size: int = 200) -> Column:
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def netloc(url: Column) -> Column:
    """Host with port and user, as between ``//`` and the next ``/``, ``?`` or ``#``; '' if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def source_name(url: Column) -> Column:
    """The host with every "www." taken out, its case kept."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def short_id(url: Column) -> Column:
    return F.concat(F.lit("web_"), F.substring(F.sha2(url, 256), 1, 16))


def query_variants(query: Column) -> Column:
    return F.array(*[F.concat(query, F.lit(" " + ending)) for ending in VARIANT_ENDINGS])


def key_terms(query: Column) -> Column:
    """Lower-case words of over three characters that are no stop words; marks and repetitions stay."""
    words = F.split(strip(F.lower(query)), r"(?U)[\s\x{1c}-\x{1f}]+")
    stop = F.array(*[F.lit(w) for w in KEY_TERM_STOP])
    return F.filter(words, lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w))


def quote_plus(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


@F.pandas_udf(StringType())
def urljoin(base: pd.Series, href: pd.Series) -> pd.Series:
    """Absolute form of a link; NULL where either side is NULL or the link is malformed."""

    def join(b, h):
        try:
            return None if b is None or h is None else _urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([join(b, h) for b, h in zip(base, href, strict=True)])
