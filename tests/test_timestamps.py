import datetime as dt
import zoneinfo

import pytest

from guestlens.operators import timestamps as ts

SCHEMA = "value string, order_group string, local_zone string, extra string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = ts.to_instants(df, ts.interval_table(spark, ts.zones_in_use(df)))
    return {(r.value, r.order_group): (r.status, r.utc_micros) for r in out.collect()}


def micros(*a, zone="UTC"):
    return int(dt.datetime(*a, tzinfo=zoneinfo.ZoneInfo(zone)).timestamp()) * 1_000_000


IST, NY = "Europe/Istanbul", "America/New_York"
CASES = [
    ("2024-05-01T10:00:00Z", "UTC", micros(2024, 5, 1, 10)),
    ("2024-05-01T10:00:00.1234567Z", "UTC", micros(2024, 5, 1, 10) + 123456),
    ("2024-05-01 10:00:00,250+03", "UTC", micros(2024, 5, 1, 7) + 250000),
    ("2024-05-01 10:00:00 GMT-5", "UTC", micros(2024, 5, 1, 15)),
    ("2024-05-01 10:00:00 TRT", "UTC", micros(2024, 5, 1, 7)),
    ("2024-05-01T10:00:00+03:00[Europe/Istanbul]", "UTC", micros(2024, 5, 1, 7)),
    ("2024-07-01 10:00:00 America/New_York", "UTC", micros(2024, 7, 1, 14)),
    ("20240501T100000Z", "UTC", micros(2024, 5, 1, 10)),
    ("20240501100000", IST, micros(2024, 5, 1, 7)),
    ("1714557600", IST, 1714557600 * 10**6),
    ("1714557600123", IST, 1714557600123 * 1000),
    ("1714557600123456", IST, 1714557600123456),
    ("/Date(1714557600123+0300)/", IST, 1714557600123 * 1000),
    ("2025-10-14T24:00:00", "UTC", micros(2025, 10, 15)),
    ("٢٠٢٤-٠٥-٠١ ١٠:٠٠:٠٠", "UTC", micros(2024, 5, 1, 10)),
    ("1 Mayıs 2024 10:00", IST, micros(2024, 5, 1, 7)),
    ("28 février 2025 à 22h05", "UTC", micros(2025, 2, 28, 22, 5)),
    ("20 de agosto de 2023, 12:28", "UTC", micros(2023, 8, 20, 12, 28)),
    ("26 мая 2023 г. 02:49", "UTC", micros(2023, 5, 26, 2, 49)),
    ("31. Oktober 2021, 01:56 Uhr", "UTC", micros(2021, 10, 31, 1, 56)),
    ("December 20, 2023 at 9:32 am", "UTC", micros(2023, 12, 20, 9, 32)),
    ("Wed, 17 Dec 2025 15:40:00 +0100", "UTC", micros(2025, 12, 17, 14, 40)),
    ("2024-05-01", IST, micros(2024, 4, 30, 21)),
    ("19.06.22 12:37", "UTC", micros(2022, 6, 19, 12, 37)),
]


def test_notations(spark):
    got = run(spark, [(v, "g", z) for v, z, _ in CASES])
    for v, _, want in CASES:
        assert got[v, "g"] == ("instant", want), v


@pytest.mark.parametrize("value", ["dün", "a month ago", "May 2024", "N/A", "vor 2 Wochen"])
def test_not_an_instant(spark, value):
    assert run(spark, [(value, "g", "UTC")])[value, "g"] == ("unparsed", None)


def test_states(spark):
    got = run(spark, [("2023-02-30 10:15:00", "g", "UTC"), ("0000-00-00 00:00:00", "g", "UTC"), ("2024-11-03 01:30:00", "g", NY), ("2024-03-10 02:30:00", "g", NY), ("2024-03-10 05:00:00", "g", None), ("", "g", "UTC"), (None, "g", "UTC")])
    assert [got[k, "g"][0] for k in ("2023-02-30 10:15:00", "0000-00-00 00:00:00", "2024-11-03 01:30:00", "2024-03-10 02:30:00", "2024-03-10 05:00:00", "", None)] == ["impossible", "impossible", "ambiguous", "nonexistent", "no_zone", "missing", "missing"]


def test_order_of_day_and_month_is_per_group(spark):
    got = run(spark, [("25/03/2024 10:00", "d", "UTC"), ("05/03/2024 10:00", "d", "UTC"), ("03/25/2024 10:00", "m", "UTC"), ("05/03/2024 10:00", "m", "UTC"), ("05.03.2024 10:00", "m", "UTC")])
    assert got["05/03/2024 10:00", "d"][1] == micros(2024, 3, 5, 10)
    assert got["05/03/2024 10:00", "m"][1] == micros(2024, 5, 3, 10)
    assert got["05.03.2024 10:00", "m"][1] == micros(2024, 3, 5, 10)


def test_every_hour_of_two_change_days_against_zoneinfo(spark):
    zone = zoneinfo.ZoneInfo("Europe/Berlin")
    values = [f"2024-{m:02}-{d:02} {h:02}:30:00" for m, d in ((3, 31), (10, 27)) for h in range(24)]
    got = run(spark, [(v, "g", "Europe/Berlin") for v in values])
    for v in values:
        t = dt.datetime.fromisoformat(v)
        utc = {t.replace(tzinfo=zone, fold=f).astimezone(dt.timezone.utc) for f in (0, 1)}
        real = {u for u in utc if u.astimezone(zone).replace(tzinfo=None) == t}
        want = "nonexistent" if not real else "ambiguous" if len(real) == 2 else "instant"
        assert got[v, "g"][0] == want, v


def test_empty(spark):
    assert run(spark, []) == {}
