import pytest

from tamiz.operators.timestamps import InstantDictionary, parse_instants, site_zones

CASES = [
    ("2023-01-05T10:00:00Z", 1672912800), ("2023-01-05t10:00z", 1672912800), ("2023-01-05 10:00:00,5-05:00", 1672930800.5), ("20230105T100000+0530", 1672893000),
    ("Thu, 05 Jan 2023 10:00:00 GMT", 1672912800), ("5 ene 2023 10:00 (EST)", 1672930800), ("Jueves 5 de enero de 2023 a las 10:00", 1672930800), ("5 DE ENERO DE 2023, 10:00 H", 1672930800),
    ("1/5/2023, 10:00 a. m.", 1672930800), ("01.05.2023 12:30am", 1672896600), ("1672912800", 1672912800), ("1672912800123", 1672912800.123), ("1672912800123456", 1672912800.123456),
    ("2023-01-05T10:00:00-05:00[America/New_York]", 1672930800), ("2023-01-05 10:00 UTC-5", 1672930800), ("2023-01-05 10:00:00 -05", 1672930800), (" 2023-01-05 10:00 ", 1672930800),
    ("2023-11-05 01:30 EDT", 1699162200), ("2023-11-05 01:30 EST", 1699165800), ("2023-01-05T10:00:00.123456789Z", 1672912800.123456),
    ("2023-11-05 01:30", None), ("2023-03-12 02:30", None), ("2023-02-30 10:00", None), ("2023-01-05T25:00:00Z", None), ("13/13/2023 10:00", None), ("13:00 pm", None), ("1/5/2023 13:00 pm", None),
    ("2023-01-05", None), ("2023-01", None), ("20230105", None), ("5 de enero de 2023", None), ("ayer", None), ("hace 5 min", None), ("", None), (" ", None), (None, None), ("x" * 100_000, None),
]


def test_forms(spark):
    rows = [(i, t, "America/New_York", "mdy") for i, (t, _) in enumerate(CASES)]
    got = {r["i"]: r["instant_us"] for r in parse_instants(spark.createDataFrame(rows, "i int, raw string, timezone string, date_order string")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == (None if want is None else round(want * 1_000_000)), text


def test_without_zone_or_order(spark):
    rows = [("2023-01-05 10:00", None, None), ("2023-01-05 10:00Z", None, None), ("01/05/2023 10:00Z", None, None), ("01/05/2023 10:00Z", None, "dmy")]
    got = [r["instant_us"] for r in parse_instants(spark.createDataFrame(rows, "raw string, timezone string, date_order string")).collect()]
    assert got == [None, 1672912800000000, None, 1682935200000000]


def test_dictionary_grows_by_what_is_new(spark, tmp_path):
    sites = spark.createDataFrame([("a", "UTC", "dmy", 1), ("b", "America/Lima", "dmy", 2)], "source string, timezone string, date_order string, extra int")
    first = spark.createDataFrame([("k1", "2023-01-05 10:00", "a"), ("k2", "2023-01-05 10:00", "b"), ("k3", None, "a"), ("k4", "2023-01-05 10:00", "a")], "rec_key string, raw string, source string")
    second = first.unionByName(spark.createDataFrame([("k5", "2023-01-06 10:00", "a"), ("k6", "2023-01-06 10:00", None), ("k7", "2023-01-06 10:00Z", None)], first.schema))
    book = InstantDictionary(spark, str(tmp_path / "d"))
    assert book.resolve(site_zones(first, sites)).count() == 0
    for rows, held in ((first, 2), (second, 5), (second, 5)):
        book.update(site_zones(rows, sites))
        assert book.table().count() == held
    got = {r["rec_key"]: r["instant_us"] for r in book.resolve(site_zones(second, sites)).collect()}
    assert set(got) == {"k1", "k2", "k4", "k5", "k7"} and got["k2"] - got["k1"] == 5 * 3600 * 1_000_000


@pytest.mark.parametrize("raw", ["raw STRING"])
def test_empty_table(spark, raw):
    assert parse_instants(spark.createDataFrame([], f"{raw}, timezone STRING, date_order STRING")).count() == 0
