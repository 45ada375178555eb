"""Text analysis: words, stop words, light Spanish stems. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common Spanish function words; pass another list where an index was built with one.
STOP_WORDS = """
a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era
erais eran eras eres es esa esas ese eso esos esta estaba estaban estado estamos estar estas este esto estos estoy está están
fue fueron fui ha habéis había habían han has hasta hay he hemos la las le les lo los me mi mis mucho muchos muy más mí mía
nada ni no nos nosotras nosotros nuestra nuestras nuestro nuestros o os otra otras otro otros para pero poco por porque que
quien quienes qué se sea sean ser será si sido sin sobre sois somos son soy su sus suya suyo también tanto te tenemos tengo
ti tiene tienen todo todos tu tus tú un una uno unos vosotras vosotros vuestra vuestro y ya yo él
""".split()

_ACCENTED, _PLAIN = "áàâäéèêëíìîïóòôöúùûü", "aaaaeeeeiiiioooouuuu"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; NULL gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def words_uax29(text: Column) -> Column:
    """Words that keep an inner mark: figures with points or commas, letters with an apostrophe or point."""
    inner = r"([\p{L}\p{N}_]+(?:(?<=\p{N})[.,](?=\p{N})[\p{L}\p{N}_]+|(?<=\p{L})['’.·:](?=\p{L})[\p{L}\p{N}_]+)*)"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(inner), F.lit(1))


def stem(word: Column) -> Column:
    """Light stem: words under five letters stay; accents are folded; a final o, a, e goes; -eses loses es;
    -ces becomes -z; -os, -as, -es go."""
    w = F.translate(word, _ACCENTED, _PLAIN)
    n = F.length(w)
    keep = lambda less: F.substring(w, 1, n - less)
    last = lambda k: F.substring(w, -k, k)
    short = F.when(last(1).isin("o", "a", "e"), keep(1)).when(last(4) == "eses", keep(2)).when(last(3) == "ces", F.concat(keep(3), F.lit("z"))).when(last(2).isin("os", "as", "es"), keep(2))
    return F.when(F.length(word) < 5, word).otherwise(short.otherwise(w))


def kept_words(text: Column, mode: str = "spanish", stop_words: list[str] | None = None) -> Column:
    """The words of a text that ``mode`` keeps, before stemming."""
    if mode not in ("simple", "spanish", "spanish_uax29"):
        raise ValueError(f"no analysis named {mode!r}")
    found = words_uax29(text) if mode == "spanish_uax29" else words(text)
    if mode == "simple":
        return found
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS if stop_words is None else stop_words))


def analyze(text: Column, mode: str = "spanish", stop_words: list[str] | None = None) -> Column:
    """Index terms of a text. ``simple``: words alone; ``spanish``: without stop words, stemmed;
    ``spanish_uax29``: the same over words with inner marks."""
    kept = kept_words(text, mode, stop_words)
    return kept if mode == "simple" else F.transform(kept, stem)


def analyze_again(terms: Column, mode: str = "spanish", stop_words: list[str] | None = None) -> Column:
    """Analysis of terms that were analysed before, as a match query does; stems may shorten once more."""
    if mode == "simple":
        return terms
    return F.transform(F.filter(terms, lambda w: ~w.isin(STOP_WORDS if stop_words is None else stop_words)), stem)
