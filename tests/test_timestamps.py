from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from threadloom.functions.timestamps import published_instants, with_instant

NY, PARIS = "America/New_York", "Europe/Paris"


def us(*a, tz=timezone.utc):
    return int(datetime(*a, tzinfo=tz if not isinstance(tz, str) else ZoneInfo(tz)).timestamp() * 1_000_000)


CASES = [
    ("2024-04-25T21:49:05", NY, "mdy", us(2024, 4, 25, 21, 49, 5, tz=NY)),
    ("2024-178T20:31:27Z", NY, "mdy", us(2024, 6, 26, 20, 31, 27)),
    ("20260225 063816", PARIS, "dmy", us(2026, 2, 25, 6, 38, 16, tz=PARIS)),
    ("20221007T092846Z", NY, "mdy", us(2022, 10, 7, 9, 28, 46)),
    ("2025-10-08 23:47:02,940+0530", NY, "mdy", us(2025, 10, 8, 18, 17, 2, 940000)),
    ("1670646544411", NY, "mdy", 1670646544411000),
    ("1714133898", NY, "mdy", 1714133898000000),
    ("1759665746379171", NY, "mdy", 1759665746379171),
    ("Mon, 17 Feb 2025 08:45:42 +1100", NY, "mdy", us(2025, 2, 16, 21, 45, 42)),
    ("Sun, 26 Oct 2025 11:06:36 CET", PARIS, "dmy", us(2025, 10, 26, 10, 6, 36)),
    ("2025-07-13T23:17:28[America/Chicago]", PARIS, "dmy", us(2025, 7, 13, 23, 17, 28, tz="America/Chicago")),
    ("2025-12-09T14:44:43-08:00[America/Los_Angeles]", PARIS, "dmy", us(2025, 12, 9, 22, 44, 43)),
    ("2024-02-07T10:22:08.244040999Z", NY, "mdy", us(2024, 2, 7, 10, 22, 8, 244040)),
    ("03/04/2023 1:05 pm", PARIS, "dmy", us(2023, 4, 3, 13, 5, tz=PARIS)),
    ("03/04/2023", NY, "mdy", us(2023, 3, 4, tz=NY)),
    ("01.03.26 07:21:42", PARIS, "dmy", us(2026, 3, 1, 7, 21, 42, tz=PARIS)),
    ("24-05-06 07:08:09", "UTC", "ymd", us(2024, 5, 6, 7, 8, 9)),
    ("September 10, 2022 5:44 pm EDT", NY, "mdy", us(2022, 9, 10, 21, 44)),
    ("December 15, 2025 12:26 a.m. EST", NY, "mdy", us(2025, 12, 15, 5, 26)),
    ("31. März 2024, 07:43 Uhr", "Europe/Berlin", "dmy", us(2024, 3, 31, 7, 43, tz="Europe/Berlin")),
    ("29 février 2024 à 23h34", PARIS, "dmy", us(2024, 2, 29, 23, 34, tz=PARIS)),
    ("10 de febrero de 2025, 18:50 h", "America/Bogota", "dmy", us(2025, 2, 10, 23, 50)),
    ("2025-12-13 13:04 UTC+11", NY, "mdy", us(2025, 12, 13, 2, 4)),
    ("2024-10-29 19:09 UTC+5:30", NY, "mdy", us(2024, 10, 29, 13, 39)),
    # dates that do not exist, unreadable values, wall times skipped or repeated by a clock change
    *[(v, NY, "mdy", None) for v in ("2023-02-30 10:00:00", "2024-13-45T25:61:00Z", "2023-366T00:00:00Z", "0000-00-00 00:00:00", "soon", "", None, "2022-03-13 02:04:11", "2024-11-03 01:38:29", "13/13/2024", "12 Foo 2024", "2024-01-01 13:00 pm")],
    ("2024-11-03 01:38:29 EST", NY, "mdy", us(2024, 11, 3, 6, 38, 29)),
    ("2024-01-01 10:00:00", "Nowhere/Else", "mdy", None),
    ("2024-01-01 10:00:00", None, None, None),
]


def test_notations(spark):
    rows = [(i, v, z, o) for i, (v, z, o, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, v string, zone string, ord string")
    got = {r["i"]: r["out"] for r in with_instant(df, "v", "zone", "ord", "out").collect()}
    wrong = [(CASES[i], got[i]) for i in got if got[i] != CASES[i][3]]
    assert not wrong and len(got) == len(CASES)


def test_every_wall_time_round_trips(spark):
    """Around clock changes: a wall time has an instant exactly if one and only one instant shows it."""
    tz = ZoneInfo(PARIS)
    walls = [f"2024-{m:02d}-{d:02d} {h:02d}:30:00" for m, d in ((3, 30), (3, 31), (4, 1), (10, 26), (10, 27), (10, 28)) for h in range(24)]
    df = spark.createDataFrame([(w, PARIS, "dmy") for w in walls], "v string, zone string, ord string")
    for r in with_instant(df, "v", "zone", "ord", "out").collect():
        naive = datetime.strptime(r["v"], "%Y-%m-%d %H:%M:%S")
        inst = {naive.replace(tzinfo=tz, fold=f).astimezone(timezone.utc) for f in (0, 1)}
        real = [t for t in inst if t.astimezone(tz).replace(tzinfo=None) == naive]
        assert r["out"] == (int(real[0].timestamp() * 1e6) if len(real) == 1 else None)


def test_empty_and_repeated(spark):
    a = spark.createDataFrame([("a", "S", "2024-01-01", 1), ("a", "S", "2024-01-01", 2), (None, "S", "2024-01-01", 3), ("b", None, "2024-01-01T00:00:00Z", 4)], "article_id string, source string, published_at string, time_zone int")
    s = spark.createDataFrame([("S", "UTC", "dmy")], "source string, time_zone string, date_order string")
    got = sorted(map(tuple, published_instants(a, s).collect()))
    assert got == [("a", us(2024, 1, 1)), ("b", us(2024, 1, 1))]
    assert published_instants(a.limit(0), s).count() == 0


@pytest.mark.parametrize("name", ["p7_found", "p7_unfixed"])
def test_queries_run(spark, sf, name):
    from threadloom.plans import dates

    assert dates.QUERIES[name](spark, sf).count() > 0
