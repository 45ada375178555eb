"""Publication times written in many ways, normalised to one UTC instant.

The distinct (text, source, zone, date order) combinations are parsed once,
kept in an append-only dictionary table, and joined back to the rows. Parsing is
done with column expressions only, so it stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and their usual short forms (Spanish, English, Portuguese, French).
MONTHS = """
1 enero ene january jan janeiro janvier janv
2 febrero feb february fevereiro fev février févr
3 marzo mar march março mars
4 abril abr april apr avril avr
5 mayo may maio mai
6 junio jun june junho juin
7 julio jul july julho juillet juil
8 agosto ago august aug août
9 septiembre setiembre sep sept set september setembro septembre
10 octubre oct october outubro out octobre
11 noviembre nov november novembro novembre
12 diciembre dic december dec dezembro dez décembre déc
"""

# Letters that mean daylight-saving time.
DAYLIGHT = "ADT AKDT BST CDT CEST CLST EDT EEST HDT IST MDT NDT PDT WEST BRST PYST UYST"

DAY_US = 86_400_000_000
_BLANK = r"[\s\x{1c}-\x{1f}]"
_DAYPART = r"([aApP]\.? ?[mM]\.?)?"
_OFFSET = r"[+-]\d{1,2}(?::?\d{2})?"
_ZONE = rf"((?:GMT|UTC|UT)? ?{_OFFSET}|[A-Za-z]{{1,5}})?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_TAIL = rf"(?: ?(?:h|hs|hrs|horas)\.?)? ?{_DAYPART} ?\(?{_ZONE}\)?(?:\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?$"

# Each form's groups, in the order year, month, day, hour, minute, second, fraction, day part, zone, region.
_FORMS = [
    (rf"(?iU)^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:t| ){_TIME}{_TAIL}", "1 3 4 5 6 7 8 9 10 11", "ymd"),
    (rf"(?iU)^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_TAIL}", "1 2 3 4 5 6 7 8 9 10", "ymd"),
    (rf"(?iU)^(?:\p{{L}}+\.?,? )?(\d{{1,2}})(?: de| del)?[ -](\p{{L}}+)\.?(?: de| del|,)?[ -](\d{{4}}),?(?: a las?| -| \||,)? {_TIME}{_TAIL}", "3 2 1 4 5 6 7 8 9 10", "ymd"),
    (rf"(?iU)^(?:\p{{L}}+\.?,? )?(\p{{L}}+)\.? (\d{{1,2}}),? (\d{{4}}),?(?: a las?| at| -| \||,)? {_TIME}{_TAIL}", "3 1 2 4 5 6 7 8 9 10", "ymd"),
    (rf"(?iU)^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}),?(?: a las?| -| \|)? {_TIME}{_TAIL}", "4 3 1 5 6 7 8 9 10 11", "site"),
]


def _groups(order: str) -> str:
    return "|".join(f"${n}" for n in order.split())


def _month(text: Column) -> Column:
    names = {w: int(line.split()[0]) for line in MONTHS.strip().splitlines() for w in line.split()[1:]}
    pairs = [F.lit(x) for name, number in names.items() for x in (name, number)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(text)), F.expr("NULL").cast("int"))


def _offset_at(instant_us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant_us), zone)) - instant_us


def parse_instants(df: DataFrame, raw: str = "raw", zone: str = "timezone", order: str = "date_order", out: str = "instant_us") -> DataFrame:
    """Add ``out``: microseconds since 1970 UTC, or NULL where ``raw`` does not name exactly one instant.

    NULL comes out for null, empty, relative and impossible texts, for a day or month alone, and for
    zoneless wall-clock times which ``zone`` shows twice or never; a zoneless text with a NULL ``zone``
    also gives NULL, and a text in figures with the year last gives NULL where ``order`` is NULL.
    Zone letters other than GMT/UTC/UT/Z mean ``zone``; between two showings of one wall-clock time
    they choose by daylight or standard time. Digits finer than a microsecond are cut off. Other
    columns pass through; helper columns have a leading ``__`` and are dropped.
    """
    text = F.trim(F.regexp_replace(F.col(raw), rf"(?U){_BLANK}+", " "))
    df = df.withColumn("__t", text)
    t = F.col("__t")
    canon = F.lit(None).cast("string")
    form = F.lit(None).cast("string")
    for pattern, groups, kind in reversed(_FORMS):
        canon = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, _groups(groups))).otherwise(canon)
        form = F.when(t.rlike(pattern), F.lit(kind)).otherwise(form)
    df = df.withColumn("__c", F.split(canon, r"\|", -1)).withColumn("__k", form)
    c = [F.get(F.col("__c"), F.lit(i)) for i in range(10)]
    number = lambda x: F.when(x.rlike(r"^\d{1,4}$"), x).cast("int")
    month = F.when(c[1].rlike(r"^\d+$"), number(c[1])).otherwise(_month(c[1]))
    swap = (F.col("__k") == "site") & (F.col(order) == "mdy")
    part = F.lower(F.regexp_replace(c[7], r"[^apmAPM]", ""))
    df = df.select(
        *[x for x in df.columns if x not in ("__c",)],
        number(c[0]).alias("__y"),
        F.when((F.col("__k") == "site") & F.col(order).isNull(), None).when(swap, number(c[2])).otherwise(month).alias("__mo"),
        F.when(swap, month).otherwise(number(c[2])).alias("__d"),
        number(c[3]).alias("__h"),
        number(c[4]).alias("__mi"),
        F.when(c[5] == "", 0).otherwise(number(c[5])).alias("__s"),
        F.rpad(F.substring(c[6], 1, 6), 6, "0").cast("int").alias("__f"),
        part.alias("__p"),
        F.upper(F.regexp_replace(c[8], " ", "")).alias("__z"),
        c[9].alias("__r"),
    )
    y, mo, d, h, mi, s = (F.col(f"__{x}") for x in ("y", "mo", "d", "h", "mi", "s"))
    p, z, r = F.col("__p"), F.col("__z"), F.col("__r")
    month_days = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 29).otherwise(28)).otherwise(31)
    valid = y.between(1, 9999) & mo.between(1, 12) & (d >= 1) & (d <= month_days) & (mi < 60) & (s < 60)
    valid = valid & F.when(p == "", h < 24).otherwise(h.between(1, 12))
    hour = F.when(p == "", h).otherwise(h % 12 + F.when(p == "pm", 12).otherwise(0))
    days = F.unix_date(F.make_date(y, mo, d)).cast("long")
    wall = F.when(valid, days * DAY_US + ((hour * 60 + mi) * 60 + s).cast("long") * 1_000_000 + F.coalesce(F.col("__f"), F.lit(0)))
    sign = F.when(z.contains("-"), -1).otherwise(1)
    digits = F.regexp_replace(F.regexp_replace(z, r"^[A-Z]+", ""), r"[^0-9]", "")
    off_h = F.when(F.length(digits) <= 2, digits).otherwise(F.expr("left(__dg, length(__dg) - 2)"))
    off_m = F.when(F.length(digits) <= 2, F.lit("0")).otherwise(F.expr("right(__dg, 2)"))
    numeric = z.rlike(r"[0-9]$")
    df = df.withColumn("__w", wall).withColumn("__dg", digits)
    df = df.withColumn("__oh", F.when(numeric, off_h).cast("int")).withColumn("__om", F.when(numeric, off_m).cast("int"))
    fixed = (
        F.when(z.isin("Z", "GMT", "UTC", "UT"), F.lit(0).cast("long"))
        .when(numeric & (F.col("__oh") <= 14) & (F.col("__om") < 60), (sign * (F.col("__oh") * 60 + F.col("__om"))).cast("long") * 60_000_000)
    )
    letters = z.rlike(r"^[A-Z]+$") & ~z.isin("Z", "GMT", "UTC", "UT")
    df = df.withColumn("__fx", fixed).withColumn("__lt", letters)
    w, here = F.col("__w"), F.col("__tz")
    df = df.withColumn("__tz", F.when((r != "") & (z == ""), r).otherwise(F.col(zone)))
    df = df.withColumn("__o1", _offset_at(w - DAY_US, here)).withColumn("__o2", _offset_at(w + DAY_US, here))
    o1, o2 = F.col("__o1"), F.col("__o2")
    ok1, ok2 = _offset_at(w - o1, here) == o1, _offset_at(w - o2, here) == o2
    twice = (o1 != o2) & ok1 & ok2
    summer = z.isin(*DAYLIGHT.split())
    local = (
        F.when(twice, F.when(F.col("__lt"), w - F.when(summer, F.greatest(o1, o2)).otherwise(F.least(o1, o2))))
        .when(ok1, w - o1)
        .when(ok2, w - o2)
    )
    clock = F.when(F.col("__fx").isNotNull(), w - F.col("__fx")).when((z == "") | F.col("__lt"), local)
    epoch = (
        F.when(t.rlike(r"^\d{10}$"), t.cast("long") * 1_000_000)
        .when(t.rlike(r"^\d{13}$"), t.cast("long") * 1_000)
        .when(t.rlike(r"^\d{16}$"), t.cast("long"))
    )
    df = df.withColumn(out, F.coalesce(clock, epoch))
    return df.drop(*[x for x in df.columns if x.startswith("__")])


class InstantDictionary:
    """Append-only table of parsed (raw, source, timezone, date_order) combinations."""

    KEY = ("raw", "source", "timezone", "date_order")
    SCHEMA = "raw STRING, source STRING, timezone STRING, date_order STRING, instant_us BIGINT"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.parts = spark, path, 0

    def table(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/part={n}" for n in range(self.parts)])

    def update(self, records: DataFrame) -> None:
        """Parse the combinations of ``records`` that the table does not hold yet, and append them."""
        new = records.select(*self.KEY).where(F.col("raw").isNotNull() & (F.col("raw") != "")).distinct()
        if self.parts:
            known = self.table().select(*[F.col(k).alias(f"k_{k}") for k in self.KEY])
            same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) if k != "raw" else F.col(k) == F.col(f"k_{k}") for k in self.KEY]
            match = same[0]
            for other in same[1:]:
                match = match & other
            new = new.join(known, match, "left_anti")
        parse_instants(new).select(*self.KEY, "instant_us").write.mode("overwrite").parquet(f"{self.path}/part={self.parts}")
        self.parts += 1

    def resolve(self, records: DataFrame) -> DataFrame:
        """Rows of ``records`` whose text names one instant, with ``instant_us``; the table has each
        combination once, so a text that many rows share is split by the adaptive join, not gathered."""
        found = self.table().where(F.col("instant_us").isNotNull())
        found = found.select(*[F.col(k).alias(f"k_{k}") for k in self.KEY], F.col("instant_us").alias("k_instant"))
        match = F.col("raw") == F.col("k_raw")
        for k in self.KEY[1:]:
            match = match & F.col(k).eqNullSafe(F.col(f"k_{k}"))
        joined = records.join(found, match, "inner").drop(*[f"k_{k}" for k in self.KEY])
        return joined.withColumnRenamed("k_instant", "instant_us")


def site_zones(records: DataFrame, sites: DataFrame) -> DataFrame:
    """Add ``timezone`` and ``date_order`` of each row's ``source`` (NULL for an unknown one)."""
    zones = sites.groupBy(F.col("source").alias("z_source")).agg(F.min("timezone").alias("timezone"), F.min("date_order").alias("date_order"))
    return records.join(zones, F.col("source") == F.col("z_source"), "left").drop("z_source")
