"""Golden values per function, and comparison with the rules stated in plain Python."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthline import functions as fn


def results(spark, column, inputs, kind="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def check(spark, column, cases, kind="string"):
    got = results(spark, column, [c[0] for c in cases], kind)
    for (value, expected), actual in zip(cases, got, strict=True):
        assert actual == expected, f"{value!r}: {actual!r} instead of {expected!r}"


def test_clean_text(spark):
    cases = [
        ("", ""),
        (None, ""),
        ("  x\t\r\ny ", "x y"),
        ("t" * 12, "t" * 7 + "..."),
        ("t" * 10, "t" * 10),
        ("\xe9\u3000\x1c b", "\xe9 b"),
        ("a \x1f", "a"),
    ]
    check(spark, lambda c: fn.clean_text(c, 10), cases)


def test_clean_text_collapses_like_split(spark):
    random.seed(3)
    alphabet = "ab\xe9 \t\n\r\x0b\x1c\x1e\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b"
    texts = ["".join(random.choices(alphabet, k=random.randrange(30))) for _ in range(2000)]
    got = results(spark, fn.clean_text, texts)
    assert got == [" ".join(t.split()) for t in texts]
    assert results(spark, fn.strip, texts) == [t.strip() for t in texts]


def test_clean_price(spark):
    cases = [
        ("$1,234.56", 1234.56),
        ("", 0.0),
        (None, 0.0),
        (".", 0.0),
        ("5.", 5.0),
        (".5", 0.5),
        ("1.2.3", 0.0),
        ("-5", 5.0),
        ("1e3", 13.0),
        ("abc", 0.0),
        ("$2.675", 2.67),
        ("$50.005", 50.01),
        ("$100.125", 100.12),
        ("0.125", 0.12),
        ("999999999999.999", 1000000000000.0),
    ]
    check(spark, fn.clean_price, cases)


def test_round_cents_is_exact(spark):
    random.seed(5)
    values = [random.randrange(1, 10**7) / 100 / random.randrange(1, 17) for _ in range(20000)]
    values += [random.randrange(10**6) / 1000 for _ in range(5000)] + [85.0 / 8, 1e15 + 0.5, 1e22]
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": [round(v, 2) for v in values]}))
    assert df.where(fn.round_cents("x") != F.col("y")).count() == 0
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": [round(v, 3) for v in values]}))
    assert df.where(fn.round_exact("x", 3) != F.col("y")).count() == 0


def test_clean_float_and_int(spark):
    def plain(text):
        try:
            return float(text)
        except (TypeError, ValueError):
            return 0.0

    texts = [
        "2.5", " 2.5 ", "N/A", "", None, "1.0d", "1f", "0x1p3", "1e3", "1e", "e3", "+.5", "-.5", ".",
        "+", "1_000", "1__0", "_1", "1_", "inf", "-Infinity", "+INF", "\xa05\u2003", "1 2", "1e400",
        "5.", "1.5E-3", "infinit", "--1", "1\n",
    ]
    assert results(spark, fn.clean_float, texts) == [plain(t) for t in texts]
    for text in ["nan", "-NaN", "+nan"]:
        assert math.isnan(results(spark, fn.clean_float, [text])[0])
    cases = [
        ("2.0", 2), ("2.9", 2), ("-3.7", -3), ("N/A", 0), ("nan", 0), ("inf", 0), ("1e30", 0), (None, 0),
    ]
    check(spark, fn.clean_int, cases)


def test_clean_percentage(spark):
    cases = [
        ("95%", 95.0), ("N/A", 0.0), ("N/A%", 0.0), ("9%5", 95.0), ("-5%", -5.0), (" 7 % ", 7.0), (None, 0.0),
    ]
    check(spark, fn.clean_percentage, cases)


def test_parse_flag(spark):
    cases = [("t", 1), ("TRUE", 1), ("1", 1), ("Yes", 1), ("f", 0), ("", 0), (" t", 0), ("y", 0), (None, 0)]
    check(spark, fn.parse_flag, cases)


def plain_date(text):
    for form in ("%Y/%m/%d", "%Y-%m-%d", "%m/%d/%Y"):
        try:
            return dt.datetime.strptime(text, form).strftime("%Y-%m-%d")
        except ValueError:
            continue
    return text


def test_clean_date(spark):
    texts = [
        "2015/1/5", "2015-01-05", "2015-1-5", "1/5/2015", "01/05/2015", "2015-02-30", "1/5/15", "15/1/5",
        "20150105", "2015-01-05 ", " 2015-01-05", "", "2015/1/ 5", "1/ 5/2015", "2015-1/5", "2015-13-01",
        "13/1/2015", "0000-01-01", "2015-01-05\n", "2015/02/29", "2016/02/29", "2015-00-01", "2/30/2015",
        "bad date",
    ]
    assert results(spark, fn.clean_date, texts) == [plain_date(t) for t in texts]
    assert results(spark, fn.clean_date, [None]) == [""]


def test_count_items(spark):
    cases = [
        ("{}", 0), ("", 0), (None, 0), ("{a}", 1), ('{a,b,"c,d"}', 4), ("{,}", 2), ("[x]", 1), ("{{a}}", 1),
        ("{ }", 1),
    ]
    check(spark, fn.count_items, cases)


def test_room_types(spark):
    texts = ["Entire home/apt", "Private room", "Shared room", "Studio apt", "", None, "ENTIRE"]
    base = ["Entire", "Private", "Shared", "Entire", "Other", "Other", "Entire"]
    assert results(spark, lambda c: fn.simplify_room_type(c, True), texts) == base
    scale = ["Entire", "Private", "Shared", "Other", "Other", "Other", "Entire"]
    assert results(spark, fn.simplify_room_type, texts) == scale


def test_categories(spark):
    prices = [(0.0, "unknown"), (74.99, "budget"), (75.0, "moderate"), (150.0, "expensive"), (300.0, "luxury")]
    check(spark, fn.price_category, prices, "double")
    reviews = [(0, "no_reviews"), (4, "few"), (5, "moderate"), (20, "many"), (50, "very_popular"), (-1, "few")]
    check(spark, fn.review_category, reviews, "bigint")
    days = [
        (0, "not_available"), (29, "rarely_available"), (30, "occasionally_available"),
        (180, "mostly_available"), (300, "highly_available"),
    ]
    check(spark, fn.availability_category, days, "bigint")
    rates = [(90.0, "responsive"), (50.0, "moderate"), (49.9, "low_response"), (math.nan, "low_response")]
    check(spark, lambda c: fn.host_category(F.lit(0), c), rates, "double")
    check(spark, lambda c: fn.host_category(F.lit(1), c), [(0.0, "superhost")], "double")
    check(spark, fn.is_professional_host, [(3, 0), (4, 1)], "bigint")
    check(spark, fn.has_cleaning_fee, [(0.0, 0), (0.01, 1)], "double")


def test_price_per_guest(spark):
    cases = [(3, 33.33), (0, 100.0), (1, 100.0), (-2, 100.0), (16, 6.25)]
    check(spark, lambda c: fn.price_per_guest(F.lit(100.0), c), cases, "bigint")
    check(spark, lambda c: fn.price_per_guest(F.lit(85.0), c), [(8, 10.62)], "bigint")


def test_float_text(spark):
    values = [85.0, 0.0, 12345678.0, 12345678.55, 1e15, 1e16, 1.5e300, 0.001, 0.0001, 0.00012, 1e-05, -47.6]
    values += [1234567.891, 99999999.99, 100.1, math.inf, -math.inf, -12345678.5]
    assert results(spark, fn.float_text, values, "double") == [repr(v) for v in values]
    assert results(spark, fn.float_text, [math.nan], "double") == ["nan"]


def test_rekey_url(spark):
    df = spark.createDataFrame([("/rooms/12/a/rooms/123",)], "u string")
    assert df.select(fn.rekey_url("u", F.lit("12"), F.lit("50"))).first()[0] == "/rooms/50/a/rooms/503"


def test_typed_integer(spark):
    cases = [("12", 12), (" 12 ", 12), ("-1", None), ("1.0", None), ("", None), ("12x", None), (None, None)]
    check(spark, fn.typed_integer, [*cases, ("9" * 20, None)])
    lenient = [("10.0", 10), ("10.5", None), ("10", 10), ("10.", None)]
    check(spark, lambda c: fn.typed_integer(c, True), lenient)


def test_typed_decimals(spark):
    def text(column):
        return lambda c: column(c).cast("string")

    decimals = [("1.5", "1.50"), ("2", "2.00"), ("12x5", None), (".5", None), ("-1", None), ("12345.6", None)]
    check(spark, text(lambda c: fn.typed_decimal(c, "decimal(6,2)")), decimals)
    amounts = [
        ("$1,234.56", "1234.56"), ("85.0", "85.00"), ("USD 5", None), ("", None), ("12345678901.5", None),
        (" $7 ", "7.00"),
    ]
    check(spark, text(fn.typed_currency), amounts)
    signed = [("-122.35", "-122.35000000"), ("+.5", "0.50000000"), ("abc", None), ("5.", None)]
    check(spark, text(fn.typed_signed_decimal), signed)


def test_typed_date(spark):
    day = dt.date
    cases = [
        ("1/5/69", day(2069, 1, 5)), ("1/5/70", day(1970, 1, 5)), ("12/31/1999", day(1999, 12, 31)),
        ("2015-01-05", day(2015, 1, 5)), ("n/a", None), ("NULL", None), ("", None), ("2015/01/05", None),
        ("13/1/15", None), ("2/29/72", day(1972, 2, 29)), ("2/29/71", None), (" 1/5/70 ", day(1970, 1, 5)),
        ("2015-1-5", None), (None, None), ("1/5/195", None),
    ]
    check(spark, fn.typed_date, cases)
    check(spark, fn.is_null_token, [("n/a", True), (" NA", True), ("Null", True), ("x", False)])


@pytest.mark.parametrize("text", ["2007-02-25 23:06:20", "2007-02-25T23:06:20"])
def test_decode_datetime(spark, text):
    got = results(spark, fn.decode_datetime, [text])[0]
    assert (got.value, got.day, got.raw) == (dt.datetime(2007, 2, 25, 23, 6, 20), None, None)


def test_decode_datetime_edges(spark):
    texts = [
        "2007-02-31T23:06:20", "0000-00-00 00:00:00", "2007-2-5 1:2:3.5", "2007-02-26",
        "2007-02-25 23:06:60", "2007-02-25 24:00:00", "2007-02-25 23:06:20.1234567 and more",
    ]
    got = results(spark, fn.decode_datetime, texts)
    assert got[0].raw == texts[0] and got[1].raw == texts[1]
    assert got[2].value == dt.datetime(2007, 2, 5, 1, 2, 3, 500000)
    assert got[3].day == dt.date(2007, 2, 26) and got[3].value is None and got[3].raw is None
    assert got[4].raw == texts[4] and got[5].raw == texts[5]
    assert got[6].value == dt.datetime(2007, 2, 25, 23, 6, 20, 123456)


def test_decode_interval(spark):
    texts = ["25:06:17", "-25:06:17", "random crap", "1:99:99.5", "838:59:59", None]
    got = results(spark, fn.decode_interval, texts)
    assert got[0].value == dt.timedelta(days=1, seconds=3977)
    assert got[1].value == -dt.timedelta(days=1, seconds=3977)
    assert got[2].value is None and got[2].raw == "random crap"
    assert got[3].value == dt.timedelta(hours=1, minutes=99, seconds=99, milliseconds=500)
    assert got[4].value == dt.timedelta(hours=838, minutes=59, seconds=59)
    assert got[5].value is None and got[5].raw is None


def test_decode_time(spark):
    texts = ["15:06:17", "-25:06:17", "random crap", "1:2:3.5", "24:00:00"]
    got = [(r.value, r.raw) for r in results(spark, fn.decode_time, texts)]
    assert got == [
        ("15:06:17", None), (None, "-25:06:17"), (None, "random crap"), ("01:02:03.500000", None),
        (None, "24:00:00"),
    ]


def test_decode_date(spark):
    texts = ["2007-02-26", "2007-02-31", "0000-00-00", "2007-2-6", " 2007-02-26 ", "2007-02-26-1", "007-1-1"]
    got = [(r.value, r.raw) for r in results(spark, fn.decode_date, texts)]
    day = dt.date
    assert got == [
        (day(2007, 2, 26), None), (None, "2007-02-31"), (None, "0000-00-00"), (day(2007, 2, 6), None),
        (day(2007, 2, 26), None), (None, "2007-02-26-1"), (day(7, 1, 1), None),
    ]


def test_ticks(spark):
    df = spark.createDataFrame([(1172444780.9,), (-0.5,)], "t double")
    rows = df.select(
        fn.date_from_ticks("t"), fn.time_from_ticks("t"), fn.timestamp_from_ticks("t")
    ).collect()
    assert tuple(rows[0]) == (dt.date(2007, 2, 25), "23:06:20", dt.datetime(2007, 2, 25, 23, 6, 20))
    assert tuple(rows[1]) == (dt.date(1969, 12, 31), "23:59:59", dt.datetime(1969, 12, 31, 23, 59, 59))


def test_plain_and_other_text_collapse_alike(spark):
    texts = ["", " ", "a", " a  b ", "a   b", "a    b", "a\tb", "a \tb", "é  x", "a b", "x" * 9 + "  y  z", "a\x1cb  c", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", fn.clean_text("t").alias("whole"), fn.clean_text("t", 6).alias("short")).collect()
    for r in rows:
        whole = " ".join((r.t or "").split())
        assert (r.whole, r.short) == (whole, whole if len(whole) <= 6 else whole[:3] + "..."), r


def test_prices_with_and_without_other_characters(spark):
    cases = {
        "$1,234.05": 1234.05, "USD 12.10": 12.1, "12": 12.0, "12.": 12.0, ".5": 0.5, "-5": 5.0, "2.675": 2.67, "$$1,,2.5 ": 12.5,
        "1.2.3": 0.0, "": 0.0, ",": 0.0, "x" + "9" * 20 + ".25": 1e20, "$" + "1" * 400: float("inf"), "y" + "1" * 400: float("inf"),
    }
    df = spark.createDataFrame(list(cases.items()), "t string, v double")
    assert [r for r in df.select("t", "v", fn.clean_price("t").alias("found")).collect() if r.v != r.found] == []
    # A pushed filter makes the text anew for every mention of it.
    assert str(fn.clean_price("the_text")).count("the_text") <= 4


def test_numbers_as_text_at_the_ends_of_plain_notation(spark):
    cases = [(1e-3, "0.001"), (9.5e-4, "0.00095"), (9999999.5, "9999999.5"), (1e7, "10000000.0"), (-0.0, "-0.0"), (0.0, "0.0"), (-2e7, "-20000000.0")]
    df = spark.createDataFrame(cases, "x double, t string")
    assert [r for r in df.select("x", "t", fn.float_text("x").alias("found")).collect() if r.t != r.found] == []
