"""Problem 7: timestamps in many notations, precisions and zones become one instant.

Every notation is an alternative of one regular expression with named groups. One replacement pulls all groups out
at once; calendar ranges are checked on integers; the instant is assembled by integer day arithmetic. Wall times
without an offset are placed by their zone's rules: the offsets a day before and a day after are the only two that
can hold, and exactly one of the two resulting instants must really have its offset. Everything runs inside the
JVM, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and abbreviations in English, German, French and Spanish, January first.
MONTHS = (
    "january jan januar jän jänner janvier janv enero ene",
    "february feb februar février fevrier févr fev febrero",
    "march mar märz maerz mär mrz mars marzo",
    "april apr avril avr abril abr",
    "may mai mayo",
    "june jun juni juin junio",
    "july jul juli juillet juil julio",
    "august aug août aout agosto ago",
    "september sep sept septembre septiembre setiembre set",
    "october oct oktober okt octobre octubre",
    "november nov novembre noviembre",
    "december dec dezember dez décembre decembre déc diciembre dic",
)
# Zone abbreviations and their minutes from UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EAT": 180, "WAT": 60, "CAT": 120, "SAST": 120, "IST": 330, "PKT": 300, "NPT": 345,
    "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720,
    "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "COT": -300, "PET": -300, "ART": -180, "BRT": -180,
}

_DATE = (
    r"(?<ya>\d{4})(?<sep>[-/.])(?<ma>\d{1,2})\k<sep>(?<da>\d{1,2})"
    r"|(?<yo>\d{4})-(?<doy>\d{3})"
    r"|(?<yc>\d{4})(?<mc>\d{2})(?<dc>\d{2})"
    r"|(?<na>\d{1,2})(?<nsep>[-/.])(?<nb>\d{1,2})\k<nsep>(?<nc>\d{4}|\d{2})"
    r"|(?:\p{L}+\.?,? )?(?<dn>\d{1,2})(?:er|st|nd|rd|th|º|\.)?(?: de | of |[ -])(?<monn>\p{L}+)\.?,?(?: de |[ -])(?<yn>\d{4})"
    r"|(?:(?<!\p{L})\p{L}+, )?(?<mone>\p{L}+)\.? (?<de>\d{1,2})(?:st|nd|rd|th)?,? (?<ye>\d{4})"
)
_TIME = (
    r"(?:T|,? (?:à |um |at |a las )?)"
    r"(?:(?<hc>\d{2})(?<mic>\d{2})(?<sc>\d{2})|(?<h>\d{1,2})[:hH.](?<mi>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?)"
    r"(?: ?(?:(?<ap>[ap])\.? ?m\.?|h|Uhr))?"
)
_ZONE = r"(?: ?(?:(?:UTC|GMT)?(?<sg>[-+−])(?<zh>\d{1,2})(?::?(?<zm>\d{2}))?|(?<abbr>[A-Z]{1,5})))?(?:\[(?<zone>[A-Za-z0-9_+/-]+)\])?"
PATTERN = rf"(?i)^\s*(?:(?:{_DATE})(?:{_TIME}{_ZONE})?|(?<epoch>\d{{10}}|\d{{13}}|\d{{16}}|\d{{19}}))\s*$"
GROUPS = "ya ma da yo doy yc mc dc na nb nc dn monn yn mone de ye hc mic sc h mi s f ap sg zh zm abbr zone epoch".split()


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date, on integers: years begin in March so that leap days end them."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    mm = F.when(m <= 2, m + 9).otherwise(m - 3)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((mm * 153 + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("long")


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _offset_at(us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)) - us


def zone_names(spark: SparkSession) -> list[str]:
    """The zone names the JVM knows (a few hundred)."""
    jvm = spark.sparkContext._jvm
    return sorted(jvm.java.lang.String.join(" ", jvm.java.time.ZoneId.getAvailableZoneIds()).split())


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once: a lambda's variable, which the optimizer never writes out again."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _sql_map(pairs) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in pairs) + ")")


def with_instant(df: DataFrame, value: str, zone: str, order: str, out: str = "published_us") -> DataFrame:
    """df with the instant of the string column value in microseconds since 1970-01-01T00:00:00Z, else null.

    zone holds the IANA zone of wall times, order (dmy, mdy, ymd) how numeric dates are written that do not start
    with a four-digit year. Null, unreadable texts, dates and times out of range, wall times that a clock change
    skips or repeats, and wall times with a null or unknown zone give null. An offset or zone abbreviation in the
    value wins over a zone name in brackets, that over the column. A missing time is midnight; digits beyond
    microseconds are cut off; two-digit years are 1970 to 2069.
    """
    known = F.expr("array(" + ", ".join(f"'{z}'" for z in zone_names(df.sparkSession)) + ")")
    month = _sql_map((n, k + 1) for k, names in enumerate(MONTHS) for n in names.split())
    minutes = _sql_map(ABBREVIATIONS.items())
    template = "\x01".join(f"${{{n}}}" for n in GROUPS)

    def fields(parts: Column) -> Column:
        g = {n: F.nullif(F.try_element_at(parts, F.lit(k + 1)), F.lit("")) for k, n in enumerate(GROUPS)}
        i = lambda n: g[n].cast("long")
        last = F.when(F.length(g["nc"]) == 2, F.when(i("nc") < 70, i("nc") + 2000).otherwise(i("nc") + 1900)).otherwise(i("nc"))
        by = F.col(order)
        # the year comes first in a numeric date of a ymd source only if the last number is no year of four digits
        first = (by == "ymd") & (F.length(g["nc"]) == 2)
        y = F.when(first, F.when(i("na") < 70, i("na") + 2000).otherwise(i("na") + 1900)).when(by.isin("dmy", "mdy"), last)
        m = F.when(first | (by == "dmy"), i("nb")).when(by == "mdy", i("na"))
        d = F.when(first, i("nc")).when(by == "dmy", i("na")).when(by == "mdy", i("nb"))
        sign = F.when(g["sg"] == "+", 1).otherwise(-1)
        offset = F.when(g["sg"].isNotNull(), sign * (i("zh") * 60 + F.coalesce(i("zm"), F.lit(0)))).otherwise(F.element_at(minutes, F.upper(g["abbr"])).cast("long"))
        return F.struct(
            F.coalesce(i("ya"), i("yo"), i("yc"), i("yn"), i("ye"), y).alias("y"),
            F.coalesce(i("ma"), i("mc"), F.element_at(month, F.lower(F.coalesce(g["monn"], g["mone"]))).cast("long"), m, F.when(i("doy").isNotNull(), F.lit(1))).alias("m"),
            F.coalesce(i("da"), i("dc"), i("dn"), i("de"), d).alias("d"),
            i("doy").alias("doy"),
            F.coalesce(i("hc"), i("h"), F.lit(0)).alias("h"),
            F.coalesce(i("mic"), i("mi"), F.lit(0)).alias("mi"),
            F.coalesce(i("sc"), i("s"), F.lit(0)).alias("s"),
            F.coalesce(F.substring(F.rpad(g["f"], 9, "0"), 1, 6).cast("long"), F.lit(0)).alias("us"),
            F.lower(g["ap"]).alias("ap"),
            offset.alias("off"),
            (g["sg"].isNotNull() | g["abbr"].isNotNull()).alias("has_off"),
            F.coalesce(i("zm"), F.lit(0)).alias("zm"),
            F.coalesce(g["zone"], F.col(zone)).alias("zone"),
            g["epoch"].alias("epoch"),
        )

    def placed(r: Column) -> Column:
        y, m, d, doy = r["y"], r["m"], r["d"], r["doy"]
        length = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(_leap(y), 29).otherwise(28)).otherwise(31)
        is_day = F.when(doy.isNotNull(), doy.between(1, F.when(_leap(y), 366).otherwise(365))).otherwise(m.between(1, 12) & d.between(1, length))
        h12 = r["ap"].isNotNull()
        hour = F.when(h12, r["h"] % 12 + F.when(r["ap"] == "p", 12).otherwise(0)).otherwise(r["h"])
        is_time = F.when(h12, r["h"].between(1, 12)).otherwise(r["h"].between(0, 23)) & r["mi"].between(0, 59) & r["s"].between(0, 59)
        is_off = ~r["has_off"] | (F.coalesce(F.abs(r["off"]) <= 14 * 60, F.lit(False)) & (r["zm"] <= 59))
        days = _days(y, m, F.coalesce(doy, d))
        wall = (days * 86400 + hour * 3600 + r["mi"] * 60 + r["s"]) * 1000000 + r["us"]
        # only wall times without an offset need the zone's rules
        z = F.when(~r["has_off"] & F.array_contains(known, r["zone"]), r["zone"])
        return F.struct(F.when(y.between(1, 9999) & is_day & is_time & is_off, wall).alias("wall"), r["off"].alias("off"), z.alias("zone"), r["epoch"].alias("epoch"))

    day = 86400 * 1000000

    def around(p: Column) -> Column:
        w, z = p["wall"], F.when(p["wall"].isNotNull(), p["zone"])
        return F.struct(w.alias("wall"), p["off"].alias("off"), z.alias("zone"), p["epoch"].alias("epoch"), _offset_at(w - day, z).alias("o1"), _offset_at(w + day, z).alias("o2"))

    def instant(p: Column) -> Column:
        w, o1, o2, z = p["wall"], p["o1"], p["o2"], p["zone"]
        v1, v2 = _offset_at(w - o1, z) == o1, _offset_at(w - o2, z) == o2
        local = _let(F.struct(v1.alias("v1"), v2.alias("v2")), lambda v: F.when(v["v1"] & ((o1 == o2) | ~v["v2"]), w - o1).when(~v["v1"] & v["v2"], w - o2))
        e, n = p["epoch"].cast("long"), F.length(p["epoch"])
        epoch = F.when(n == 10, e * 1000000).when(n == 13, e * 1000).when(n == 16, e).when(n == 19, F.floor(e / 1000))
        return F.when(n > 0, epoch).when(p["off"].isNotNull(), w - p["off"] * 60 * 1000000).otherwise(local).cast("long")

    parts = F.split(F.regexp_replace(F.col(value), PATTERN, template), "\x01", -1)
    read = _let(parts, lambda g: F.when(F.size(g) == len(GROUPS), fields(g)))
    result = _let(_let(_let(read, placed), around), instant)
    return df.withColumn(out, result)


def published_instants(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, published_us) of the articles whose published_at fixes an instant."""
    a = articles.select("article_id", "source", "published_at").where("article_id is not null and published_at is not null")
    s = sources.select("source", "time_zone", "date_order").dropDuplicates(["source"])
    t = with_instant(a.join(s, "source", "left"), "published_at", "time_zone", "date_order")
    return t.where("published_us is not null").select("article_id", "published_us").distinct()
