"""Facts about imprecise dates, one row each."""

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import dates as D


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("birth, bp, death, dp, want", [
    ("1896-02-29", "exact", "1982-05-16", "exact", (86, 86, 86)), ("1896-02-29", "exact", "1900-02-28", "exact", (3, 3, 3)), ("1896-02-29", "exact", "1900-03-01", "exact", (4, 4, 4)),
    ("1892", "year", "1980", "year", (None, 87, 88)), ("1896-02-29", "exact", "1980-05", "month", (None, 83, 84)), (None, None, "1980", "year", None), ("1892", "year", "1917", "after", None)])
def test_age(spark, birth, bp, death, dp, want):
    got = value(spark, D.age_in_years(F.lit(birth).cast("string"), F.lit(bp).cast("string"), F.lit(death), F.lit(dp)))
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize("date, ref, want", [
    ("1963-05-14", "2026-05-14", 0), ("1963-05-14", "2026-05-15", -1), ("1963-05-14", "2026-05-13", 1), ("1963-01-02", "2026-12-30", 3), ("1963-01-01", "2028-12-31", 1),
    ("1963-01-01", "2026-12-31", 1), ("1960-02-29", "2026-01-01", None), ("1960-02-29", "2028-02-29", 0), ("1963-05", "2026-05-14", None)])
def test_month_day_distance(spark, date, ref, want):
    assert value(spark, D.month_day_distance(F.lit(date), F.lit("exact"), F.lit(ref).cast("date"))) == want


@pytest.mark.parametrize("ref, want", [("1963-05-15", -1), ("1963-05-14", 0), ("1963-05-13", 1)])
def test_days_from(spark, ref, want):
    assert value(spark, D.days_from(F.lit("1963-05-14"), F.lit("exact"), F.lit(ref).cast("date"))) == want


@pytest.mark.parametrize("date, precision, date2, want", [
    ("1963-05-14", "exact", None, "14 May 1963"), ("1963-05", "month", None, "May 1963"), ("1963", "year", None, "1963"), ("1963", "approx", None, "circa 1963"),
    ("1917", "after", None, "after 1917"), ("1881", "before", None, "before 1881"), ("1880", "between", "1881", "between 1880 and 1881")])
def test_labels(spark, date, precision, date2, want):
    assert value(spark, D.date_label(F.lit(date), F.lit(precision), F.lit(date2).cast("string"))) == want


@pytest.mark.parametrize("date, want", [("1963", True), ("1963-05", True), ("1963-13", False), ("2026-02-31", False), ("2026-99", False), ("2000-02-29", True), ("1900-02-29", False), ("x", False), (None, False)])
def test_viable(spark, date, want):
    assert value(spark, D.viable_date(F.lit(date).cast("string"))) is want


@pytest.mark.parametrize("date, precision, date2, gedcom, back", [
    ("1945-03-24", "exact", None, "24 MAR 1945", ("1945-03-24", "exact", None)), ("1945-03", "approx", None, "ABT MAR 1945", ("1945-03", "approx", None)),
    ("1881", "before", None, "BEF 1881", ("1881", "before", None)), ("1880", "between", "1881", "BET 1880 AND 1881", ("1880", "between", "1881"))])
def test_gedcom_dates(spark, date, precision, date2, gedcom, back):
    assert value(spark, D.gedcom_date(F.lit(date), F.lit(precision), F.lit(date2).cast("string"))) == gedcom
    assert tuple(value(spark, D.parse_gedcom_date(F.lit(gedcom)))) == back


@pytest.mark.parametrize("text, precision, want", [
    ("1963-05-14", "exact", ("1963-05-14", "exact")), ("14 May 1963", "exact", ("1963-05-14", "exact")), ("May 1963", "exact", ("1963-05", "month")), ("3/4/1950", "exact", ("1950-04-03", "exact")),
    ("1963", "month", ("1963", "year")), ("1963", "approx", ("1963", "approx")), ("long ago", "exact", (None, None)), ("31/02/1950", "exact", (None, None))])
def test_told_dates(spark, text, precision, want):
    assert tuple(value(spark, D.normalize_date_fact(F.lit(text), F.lit(precision)))) == want


def test_life_line_and_small_facts(spark):
    def dated(d, p):
        return F.struct(F.lit(d).cast("string").alias("date"), F.lit(p).cast("string").alias("precision"))
    assert value(spark, D.life_line(dated("1828-01-02", "exact"), dated("1909", "year"))) == "1828–1909"
    assert value(spark, D.life_line(dated("1828", "approx"), dated("1917", "after"))) == "b. circa 1828"
    assert value(spark, D.life_line(dated(None, None), dated("1909", "year"))) == "d. 1909"
    assert value(spark, D.normalize_age_fact(F.lit("34"))) == 34 and value(spark, D.normalize_age_fact(F.lit("110"))) is None
    assert value(spark, D.suggestion_year(F.lit("the 1960s"))) == 1960 and value(spark, D.suggestion_year(F.lit("summer"))) is None
    assert value(spark, D.ref_date(F.lit(None).cast("string"), F.lit("1960"), F.lit("1963-05"))) == "1963-05"
