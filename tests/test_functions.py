import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamiz.config import Settings
from tamiz.functions import analysis, dates, scoring
from tamiz.functions import text as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def test_clean_text(spark):
    assert one(spark, "a\rb\r\nc\x00d", T.clean_text) == "ab\ncd"
    assert one(spark, None, T.clean_text) == ""
    assert one(spark, "  ﬁn \t x\n\n\n\ny \n z ", T.clean_text) == "fin x\n\ny\nz"
    once = one(spark, " a b\n \n\n c", T.clean_text)
    assert one(spark, once, T.clean_text) == once


def test_stems(spark):
    words = "economía cubanas voces países correo intereses como".split()
    want = "economi cuban voz pais corre interes como".split()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(analysis.stem(F.col("w"))).collect()] == want
    again = spark.createDataFrame([("correo intereses",)], "q string").select(analysis.analyze_again(analysis.analyze(F.col("q"))).alias("t"))
    assert again.first()["t"] == ["corr", "inter"]


def test_analysis_modes(spark):
    text = "El l'eau costó US$56.944, ¿no? U.N.E."
    assert one(spark, text, lambda c: analysis.analyze(c, "simple")) == ["el", "l", "eau", "costó", "us", "56", "944", "no", "u", "n", "e"]
    assert "56.944" in one(spark, text, lambda c: analysis.words_uax29(c))
    assert one(spark, None, lambda c: analysis.analyze(c)) == []
    with pytest.raises(ValueError):
        analysis.analyze(F.lit("a"), "nosuch")


def test_snippets_and_ids(spark):
    assert one(spark, "x" * 200, T.snippet) == "x" * 200
    assert one(spark, "x" * 201, T.snippet) == "x" * 200 + "..."
    assert one(spark, "ab", T.snippet_always) == "ab..."
    assert one(spark, "a", T.short_id) == "web_ca978112ca1bbdca"
    assert one(spark, "q", T.query_variants) == ["q actualidad", "q noticias", "q últimas noticias"]
    assert one(spark, "  La Economía de los economía, hoy ", T.key_terms) == ["economía", "economía,"]
    assert one(spark, "https://www.bbc.com:80/x", T.source_name) == "bbc.com:80"
    assert one(spark, "a b*~ñ", T.quote_plus) == "a+b%2A~%C3%B1"


def test_bylines(spark):
    authors = lambda c: T.byline_authors(c, F.array(F.lit("z")))
    assert one(spark, "Por Ana Paz, Luis Sol y Eva Luz - Madrid\ntexto", authors) == ["Ana Paz", "Luis Sol", "Eva Luz"]
    assert one(spark, "Ayer", authors) == ["z"]
    assert one(spark, "Autor: A, B y C", T.autor_paragraph) == ["A", "B", "C"]
    assert one(spark, "A / B", T.slash_authors) == ["A", "B"]
    assert one(spark, "texto. MINUTO a minuto: x", T.drop_minute_by_minute) == "texto"
    assert one(spark, "a Foto: b\nc", T.drop_photo_credits) == "a \nc"
    assert one(spark, "a\nAutor: b", T.cut_author_tail) == "a"
    assert one(spark, "Por X\ny", T.drop_leading_byline) == "y"
    assert one(spark, "a[1]b", T.drop_bracketed) == "ab"


def test_dates(spark):
    micros = lambda c: F.unix_micros(dates.parse_feed_date(c, F.timestamp_micros(F.lit(5))))
    assert one(spark, "Thu, 05 Jan 2023 05:12:56 -0500", micros) == 1672913576000000
    assert one(spark, "Thu, 05 Jan 2023 10:12:56 GMT", micros) == 1672913576000000
    assert one(spark, "2023-01-05T10:12:56Z", micros) == 1672913576000000
    assert one(spark, "mañana", micros) == 5


def test_iso_dates_against_brute_force(spark):
    from datetime import UTC, datetime, timedelta

    def brute(text):
        try:
            at = datetime.fromisoformat(text)
        except (TypeError, ValueError):
            return None
        return (at.replace(tzinfo=at.tzinfo or UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)

    days = ["2024-02-29", "2023-02-29", "2024-01-31", "2024-04-31", "2024-13-01", "20240131", "20230230", "2024-0131", "0000-01-01", "2024-12", "2024"]
    times = ["", "T10", "T23:59", "T24:00", "T10:11:12", "t10:11:12", " 10:11:60", "T101112", "T10:1112", "T10:11:12.5", "T10:11:12,123456789", "T101112.25", "x"]
    texts = [d + t + z for d in days for t in times for z in ("", "Z", "+0530", "-04:00", "+02", "+05:3", " GMT") if t or not z]
    texts += [None, "", " ", " 2024-01-31 ", "2024-01-31\n", "mañana", "31/01/2024 10:11", "1672884838", "2024-01-31T10:11:12-03:00[America/Santiago]"]
    df = spark.createDataFrame([(t,) for t in texts], "v string").select("v", F.unix_micros(dates.parse_iso(F.col("v"))).alias("us"))
    got = {r["v"]: r["us"] for r in df.collect()}
    assert {t: u for t, u in got.items() if u != brute(t)} == {}
    assert one(spark, "2024-01-31T10:11:12.Z", dates.parse_iso) is None  # Python takes a point without digits


@pytest.mark.parametrize("n, avg, want", [(0, None, 1.0), (1, 50.0, 0.4), (2, 50.0, 0.2), (3, 50.0, 0.0), (1, -60.0, 0.44), (2, -60.0, 0.24), (1, -150.0, 0.8), (15, -20.0, 0.0)])
def test_insufficiency(spark, n, avg, want):
    df = spark.createDataFrame([(n, avg)], "n bigint, a double")
    assert df.select(scoring.insufficiency(F.col("n"), F.col("a"))).first()[0] == pytest.approx(want)
    if n == 0:
        assert df.select(scoring.insufficiency(F.col("n"), F.col("a"), empty_is_insufficient=False)).first()[0] == 0.0


def test_settings(monkeypatch):
    assert Settings().overlap_tokens == 153
    monkeypatch.setenv("TAMIZ_MU", "7")
    assert Settings.from_env().mu == 7.0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-50, 0), min_size=1, max_size=8))
def test_min_max_stays_inside(values):
    low, high = min(values), max(values)
    span = 1.0 if high == low else high - low
    assert all(-1e-9 <= 100 * (v - low) / span <= 100 + 1e-9 for v in values)
