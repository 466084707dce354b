"""Mixed timestamp notations and zones to one UTC instant.

Values are parsed by a few regular-expression families into local fields plus a zone token, all JVM-side. Zone
offsets come from an as-of join: every zone's offset intervals, cut at local years, against the parsed local time. Two
matching intervals: the local time occurs twice. None: it never occurs. One: its offset gives the instant.

The interval table holds the IANA zones in use x years and nothing else of the data, so its broadcast is bounded (5 MB
for all zones).
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1900, 2100  # before and after, the first and the last interval hold
STEP_DAYS = 14  # probing step for offset changes
LOCAL_MIN, LOCAL_MAX = -(2**62), 2**62

# Month names by language (en, tr, de, ru genitive, fr, es), month numbers 1-12.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en_short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "tr": "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
}
# Zone abbreviations that name one offset, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "TRT": 180, "MSK": 180,
    "GST": 240, "JST": 540, "KST": 540, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# Other spellings of platform names.
PLATFORM_ALIASES = {"ta": "tripadvisor", "csv": "csv_import"}

ZONE = r"(?:\s*(Z|[+-]\d{2}(?::?\d{2})?|(?:GMT|UTC)[+-]\d{1,2}(?::?\d{2})?|[A-Z]{2,5}|[A-Za-z]+/[A-Za-z_/+-]+)(?:\[[A-Za-z_/+-]+\])?)?"
SEP = "\u0001"


@lru_cache(maxsize=8)
def offset_intervals(zones: tuple[str, ...]) -> pd.DataFrame:
    """Per zone and local year the offset intervals that touch it: zone, local_year, arrays of lo, hi (local micros) and off (s)."""
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    start = dt.datetime(FIRST_YEAR, 1, 1, tzinfo=dt.timezone.utc)
    n = (dt.datetime(LAST_YEAR, 1, 1, tzinfo=dt.timezone.utc) - start).days // STEP_DAYS
    probes = [start + dt.timedelta(days=STEP_DAYS * i) for i in range(n + 1)]
    rows = []
    for name in zones:
        zone = zoneinfo.ZoneInfo(name)
        seconds = [int(p.astimezone(zone).utcoffset().total_seconds()) for p in probes]
        edges: list[tuple[int | None, int]] = [(None, seconds[0])]
        for i in range(1, len(probes)):
            if seconds[i] != seconds[i - 1]:
                lo, hi = probes[i - 1], probes[i]
                while (hi - lo).total_seconds() > 1:
                    mid = lo + dt.timedelta(seconds=int((hi - lo).total_seconds()) // 2)
                    if int(mid.astimezone(zone).utcoffset().total_seconds()) == seconds[i - 1]:
                        lo = mid
                    else:
                        hi = mid
                edges.append((int((hi - epoch).total_seconds()), seconds[i]))
        by_year: dict[int, list[tuple[int, int, int]]] = {}
        for k, (begin, off) in enumerate(edges):
            end = edges[k + 1][0] if k + 1 < len(edges) else None
            lo = LOCAL_MIN if begin is None else (begin + off) * 1_000_000
            hi = LOCAL_MAX if end is None else (end + off) * 1_000_000
            y0 = FIRST_YEAR - 1 if begin is None else min(LAST_YEAR, max(FIRST_YEAR - 1, (epoch + dt.timedelta(seconds=begin + off)).year))
            y1 = LAST_YEAR if end is None else min(LAST_YEAR, max(FIRST_YEAR - 1, (epoch + dt.timedelta(seconds=end + off)).year))
            for y in range(y0, y1 + 1):
                by_year.setdefault(y, []).append((lo, hi, off))
        rows += [(name, y, [v[0] for v in vs], [v[1] for v in vs], [v[2] for v in vs]) for y, vs in by_year.items()]
    return pd.DataFrame(rows, columns=["zone", "local_year", "lo", "hi", "off"])


def interval_table(spark: SparkSession, zones: list[str]) -> DataFrame:
    schema = "zone string, local_year int, lo array<bigint>, hi array<bigint>, off array<int>"
    return spark.createDataFrame(offset_intervals(tuple(zones)), schema) if zones else spark.createDataFrame([], schema)


def zones_in_use(df: DataFrame, zone: str = "local_zone") -> list[str]:
    """The IANA zones that the rows name or need: a distinct that can't exceed the IANA list (about 600 names)."""
    written = F.regexp_extract("value", r"([A-Za-z]+/[A-Za-z_/+-]+)\]?$", 1)
    both = df.select(F.explode(F.array(F.col(zone), written)).alias("z")).where(F.col("z").isin(sorted(zoneinfo.available_timezones())))
    return sorted(r.z for r in both.distinct().collect())


def clean(value: Column) -> Column:
    """ASCII digits, single blanks, no outer white space."""
    ascii_digits = F.translate(value, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    return F.trim(F.regexp_replace(ascii_digits, r"[\s  ]+", " "))


def month_number(word: Column) -> Column:
    pairs = {w: i + 1 for names in MONTHS.values() for i, w in enumerate(names.split())}
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), F.lower(F.translate(word, "İI", "ii")))


def canonical_platform(platform: Column) -> Column:
    """Lower case, without a domain ending, aliases resolved."""
    name = F.regexp_replace(F.lower(F.trim(platform)), r"\.(com|net|org|de)$", "")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PLATFORM_ALIASES.items() for x in kv]), name), name)


# Families: pattern, and which groups are y, mo, d, h, mi, s, fraction, am/pm, zone, date separator ("" where the family has none).
FAMILIES = {
    "iso": (r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?" + ZONE + r")?$", "$1 $2 $3 $4 $5 $6 $7 - $8 -"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})(Z)?)$", "$1 $2 $3 $4 $5 $6 - - $7 -"),
    "numeric": (r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})(?:,? (\d{1,2})[:.](\d{2})(?::(\d{2}))?(?: ?([AaPp][Mm]))?" + ZONE + r")?$", "$4 $3 $1 $5 $6 $7 - $8 $9 $2"),
    "day_month": (r"^(?:\p{L}+\.?,? )?(\d{1,2})\.? (?:de )?(\p{L}+)\.? (?:de )?(\d{4})(?: г\.)?(?:(?:,| à| at| um)? (\d{1,2})[:h.](\d{2})(?::(\d{2}))?(?: Uhr)?" + ZONE + r")?$", "$3 $2 $1 $4 $5 $6 - - $7 -"),
    "month_day": (r"^(\p{L}+)\.? (\d{1,2}), (\d{4})(?:,? (?:at )?(\d{1,2}):(\d{2})(?::(\d{2}))?(?: ?([AaPp][Mm]))?" + ZONE + r")?$", "$3 $1 $2 $4 $5 $6 - $7 $8 -"),
}
ISO_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"


def parsed(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds p_family and the parsed parts p_*; a value of no family has NULL there."""
    v = F.col("p_text")
    parts = F.lit(None).cast("array<string>")
    family = F.lit(None).cast("string")
    for name, (pattern, order) in reversed(FAMILIES.items()):
        hit = v.rlike(pattern)
        slots = SEP.join("" if s == "-" else s for s in order.split(" "))
        parts = F.when(hit, F.split(F.regexp_replace(v, pattern, slots), SEP, -1)).otherwise(parts)
        family = F.when(hit, F.lit(name)).otherwise(family)
    epoch_digits = F.regexp_extract(v, r"^(?:/Date\((-?\d{1,16})(?:[+-]\d{4})?\)/|(\d{10}|\d{13}|\d{16}))$", 1)
    bare = F.regexp_extract(v, r"^(\d{10}|\d{13}|\d{16})$", 1)
    epoch = F.when(epoch_digits != "", F.try_multiply(epoch_digits.try_cast("bigint"), F.lit(1000))).when(
        bare != "", bare.try_cast("bigint") * F.when(F.length(bare) == 10, 1_000_000).when(F.length(bare) == 13, 1000).otherwise(1)
    )
    df = df.withColumn("p_text", clean(F.col(value))).withColumn("p_epoch", epoch).withColumn("p_family", family).withColumn("p_parts", parts)
    part = lambda i: F.get("p_parts", F.lit(i))
    number = lambda c: c.try_cast("int")
    year = number(part(0))
    return (
        df.withColumn("p_year", F.when(F.length(part(0)) == 2, year + F.when(year < 70, 2000).otherwise(1900)).otherwise(year))
        .withColumn("p_second", F.coalesce(number(part(1)), month_number(part(1))))  # the month, unless the order is month first
        .withColumn("p_first", number(part(2)))
        .withColumn("p_hour", number(part(3)))
        .withColumn("p_minute", number(part(4)))
        .withColumn("p_sec", F.coalesce(number(part(5)), F.lit(0)))
        .withColumn("p_micros", F.coalesce(number(F.rpad(F.substring(part(6), 1, 6), 6, "0")), F.lit(0)))
        .withColumn("p_ampm", F.lower(part(7)))
        .withColumn("p_zone", F.nullif(part(8), F.lit("")))
        .withColumn("p_sep", F.nullif(part(9), F.lit("")))
        .drop("p_parts")
    )


def day_month_order(df: DataFrame, group: str) -> DataFrame:
    """Per group and separator whether the month comes first, by the values that allow one reading only.

    One row per group, from a partial aggregation; a group without evidence, or a tie, reads day first.
    """
    numeric = df.where("p_family = 'numeric'")
    return (
        numeric.groupBy(F.col(group).alias("o_group"), F.col("p_sep").alias("o_sep"))
        .agg(F.count_if(F.col("p_second") > 12).alias("month_first"), F.count_if(F.col("p_first") > 12).alias("day_first"))
        .select("o_group", "o_sep", (F.col("month_first") > F.col("day_first")).alias("o_month_first"))
    )


def to_instants(df: DataFrame, intervals: DataFrame, group: str = "order_group", zone: str = "local_zone") -> DataFrame:
    """Adds utc_micros and status to rows with columns `value`, `group` (keeps one order of day and month) and `zone`
    (IANA name for values without a zone; NULL: none is known).

    status: instant, ambiguous, nonexistent, no_zone, impossible, unparsed, missing. Only `instant` has utc_micros.
    NULL and '' are missing; repeated rows are kept; unknown zone names count as no_zone.
    """
    p = parsed(df)
    order = day_month_order(p, group)
    # order has a row per group and separator; its size is decided at run time by AQE, not hinted
    p = p.join(order, F.col(group).eqNullSafe(F.col("o_group")) & (F.col("p_sep") == F.col("o_sep")), "left").drop("o_group", "o_sep")
    swap = (F.col("p_family") == "numeric") & F.coalesce("o_month_first", F.lit(False))
    month, day = F.when(swap, F.col("p_first")).otherwise(F.col("p_second")), F.when(swap, F.col("p_second")).otherwise(F.col("p_first"))
    h = F.coalesce("p_hour", F.lit(0))
    twelve = F.col("p_ampm").isin("am", "pm")
    hour = F.when(twelve, F.when(h.between(1, 12), h % 12 + F.when(F.col("p_ampm") == "pm", 12).otherwise(0))).otherwise(h)
    midnight = (~twelve | F.col("p_ampm").isNull()) & (h == 24) & (F.coalesce("p_minute", F.lit(0)) == 0) & (F.col("p_sec") == 0) & (F.col("p_micros") == 0)
    fits = hour.between(0, 23) & F.coalesce("p_minute", F.lit(0)).between(0, 59) & F.col("p_sec").between(0, 59) | midnight
    # day 1 of the month always exists, so ANSI mode has nothing to raise; the day is checked against the month's length
    first = F.make_date(F.greatest(F.least("p_year", F.lit(9999)), F.lit(1)), F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1))
    exists = F.col("p_year").between(1, 9999) & month.between(1, 12) & (day >= 1) & (day <= F.dayofmonth(F.last_day(first)))
    days = F.datediff(first, F.lit("1970-01-01").cast("date")) + day - 1
    local = days.cast("bigint") * 86_400_000_000 + (F.when(midnight, F.lit(24)).otherwise(hour) * 3600 + F.coalesce("p_minute", F.lit(0)) * 60 + F.col("p_sec")).cast("bigint") * 1_000_000 + F.col("p_micros")
    p = p.withColumn("p_local", F.when(exists & fits, local))
    z = F.col("p_zone")
    numeric_zone = F.regexp_extract(z, r"^(?:GMT|UTC)?([+-])(\d{1,2}):?(\d{2})?$", 1)
    minutes = F.regexp_extract(z, r"^(?:GMT|UTC)?([+-])(\d{1,2}):?(\d{2})?$", 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(z, r"^(?:GMT|UTC)?([+-])(\d{1,2}):?(\d{2})?$", 3).try_cast("int"), F.lit(0))
    abbreviations = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    fixed = F.when(numeric_zone != "", minutes * F.when(numeric_zone == "-", -1).otherwise(1)).otherwise(F.element_at(abbreviations, z))
    p = p.withColumn("p_fixed", fixed).withColumn("p_named", F.when(z.isNull(), F.col(zone)).when(z.contains("/"), z))
    p = p.withColumn("p_bucket", F.least(F.greatest(F.year(F.timestamp_micros("p_local")), F.lit(FIRST_YEAR - 1)), F.lit(LAST_YEAR)))
    i = F.broadcast(intervals.select(F.col("zone").alias("i_zone"), F.col("local_year").alias("i_year"), F.arrays_zip("lo", "hi", "off").alias("i_all")))
    p = p.join(i, (F.col("p_named") == F.col("i_zone")) & (F.col("p_bucket") == F.col("i_year")), "left")
    p = p.withColumn("p_hits", F.filter("i_all", lambda x: (x["lo"] <= F.col("p_local")) & (F.col("p_local") < x["hi"])))
    hits = F.size("p_hits")
    by_zone = F.when(F.col("i_all").isNull(), "no_zone").when(hits == 1, "instant").when(hits > 1, "ambiguous").otherwise("nonexistent")
    status = (
        F.when(F.col("p_text").isNull() | (F.col("p_text") == ""), "missing")
        .when(F.col("p_epoch").isNotNull(), "instant")
        .when(F.col("p_family").isNull(), "unparsed")
        .when(F.col("p_local").isNull(), "impossible")
        .when(F.col("p_fixed").isNotNull(), "instant")
        .otherwise(by_zone)
    )
    offset = F.coalesce(F.col("p_fixed") * 60, F.get("p_hits", F.lit(0))["off"]).cast("bigint") * 1_000_000
    out = p.withColumn("status", status)
    out = out.withColumn("utc_micros", F.when(F.col("status") == "instant", F.coalesce("p_epoch", F.col("p_local") - offset)))
    return out.select(*df.columns, "utc_micros", "status")


def stacked_values(reviews: DataFrame, platform_reviews: DataFrame, scraped: DataFrame, hotels: DataFrame) -> DataFrame:
    """The four text time fields as rows: table_name, record_key, field_name, value, order_group, local_zone."""
    # a hotel name in the dimension twice with different zones is no key; such a name gives no zone
    zones = hotels.groupBy(F.col("name").alias("z_name")).agg(F.min("time_zone").alias("a"), F.max("time_zone").alias("b")).select("z_name", F.when(F.col("a") == F.col("b"), F.col("a")).alias("z_zone"))

    def with_zone(df: DataFrame) -> DataFrame:
        return df.join(zones, F.col("hotel_name") == F.col("z_name"), "left")

    def rows(df: DataFrame, table: str, key: str, field: str, value: str, group: Column, zone: Column) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("record_key"), F.lit(field).alias("field_name"), F.col(value).alias("value"), group.alias("order_group"), zone.alias("local_zone"))

    r = with_zone(reviews.select("id", "review_date", "created_at", "source", "hotel_name"))
    fields = F.explode(
        F.array(
            F.struct(F.lit("review_date").alias("field_name"), F.col("review_date").alias("value"), F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("order_group"), F.col("z_zone").alias("local_zone")),
            F.struct(F.lit("created_at").alias("field_name"), F.col("created_at").alias("value"), F.lit("created_at").alias("order_group"), F.lit("UTC").alias("local_zone")),
        )
    )
    r = r.select(F.lit("reviews").alias("table_name"), F.col("id").cast("string").alias("record_key"), fields.alias("x")).select("table_name", "record_key", "x.*")
    q = rows(platform_reviews, "platform_reviews", "id", "created_at", "created_at", F.lit("created_at"), F.lit("UTC"))
    s = rows(with_zone(scraped.select("row_id", "date_text", "platform", "hotel_name")), "scraped_reviews", "row_id", "date_text", "date_text", F.concat(F.lit("platform:"), F.coalesce(canonical_platform(F.col("platform")), F.lit(""))), F.col("z_zone"))
    return r.unionByName(q).unionByName(s)


def found_instants(instants: DataFrame) -> DataFrame:
    """The values that name one instant and are not written in the plain UTC notation already."""
    return instants.where((F.col("status") == "instant") & ~F.col("value").rlike(ISO_UTC)).select("table_name", "record_key", "field_name", "utc_micros")
