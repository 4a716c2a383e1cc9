"""Imprecise dates as strings: YYYY, YYYY-MM or YYYY-MM-DD with a precision beside them.

A partial date is never cast to DATE: the string order is the order of such dates, and a
cast would invent the missing parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.schemas import POINT_PRECISIONS

#: Fixed names.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
GEDCOM_MONTHS = tuple(m[:3].upper() for m in MONTHS)
HALF_YEAR = 183


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lookup(names: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index)


def _part(date, shape: str, start: int, size: int) -> Column:
    """A number in the string, where the string begins in this shape (0 for a digit)."""
    d = _col(date)
    digits = F.translate(F.substring(d, 1, len(shape)), "123456789", "000000000")
    return F.when(digits == shape, F.substring(d, start, size).try_cast("int"))


def year_of(date) -> Column:
    """The year, or null where the string has none."""
    return _part(date, "0000", 1, 4)


def month_index(date) -> Column:
    """Month from 0, or null."""
    return _part(date, "0000-00", 6, 2) - 1


def day_of(date) -> Column:
    return _part(date, "0000-00-00", 9, 2)


def is_leap_year(year) -> Column:
    y = _col(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _full(date: Column) -> Column:
    """A real calendar day as DATE, anything else null."""
    return F.when(F.rlike(date, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).cast("date"))


def viable_date(date) -> Column:
    """Whether the string is a year, a year and month, or a day that exists."""
    d = _col(date)
    month = month_index(d)
    return F.coalesce(
        F.when(F.rlike(d, F.lit(r"^\d{4}$")), F.lit(True)).when(F.rlike(d, F.lit(r"^\d{4}-\d{2}$")), month.between(0, 11)).otherwise(
            _full(d).isNotNull()), F.lit(False))


def age_in_years(birth, birth_precision, death, death_precision) -> Column:
    """struct<exact, from, to>: the age in whole years where both days are exact, else the
    range of one year; null where a date is missing or open."""
    b, bp, d, dp = map(_col, (birth, birth_precision, death, death_precision))

    def part(x: Column, of: Column) -> Column:
        return F.struct(year_of(x).alias("y"), (month_index(x) * 100 + day_of(x)).alias("md"), of.alias("p"))

    def age(t: Column) -> Column:
        b, d = t["b"], t["d"]
        years = d["y"] - b["y"]
        exact = (b["p"] == "exact") & (d["p"] == "exact") & b["md"].isNotNull() & d["md"].isNotNull()
        whole = years - F.when(d["md"] >= b["md"], F.lit(0)).otherwise(F.lit(1))
        known = b["p"].isin(*POINT_PRECISIONS) & d["p"].isin(*POINT_PRECISIONS) & years.isNotNull()
        one = F.when(exact, F.struct(whole.alias("exact"), whole.alias("from"), whole.alias("to"))).otherwise(
            F.struct(F.lit(None).cast("int").alias("exact"), (years - 1).alias("from"), years.alias("to")))
        return F.when(known, one)
    # each string is taken apart once: the parts are an element that the age is read from
    return F.get(F.transform(F.array(F.struct(part(b, bp).alias("b"), part(d, dp).alias("d"))), age), 0)


def age_label(age: Column) -> Column:
    return F.when(age["exact"].isNotNull(), age["exact"].cast("string")).when(
        age["from"].isNotNull(), F.concat_ws("–", age["from"].cast("string"), age["to"].cast("string")))


def date_label(date, precision, date2=None) -> Column:
    """Text of a date in the words of its precision."""
    d, p = _col(date), _col(precision)
    d2 = F.lit(None).cast("string") if date2 is None else _col(date2)
    year = year_of(d).cast("string")
    month = month_index(d)
    return F.when(year.isNull(), F.lit(None).cast("string")).when(
        p == "exact", F.concat_ws(" ", day_of(d).cast("string"), F.substring(_lookup(MONTHS, month), 1, 3), year)).when(
        p == "month", F.concat_ws(" ", _lookup(MONTHS, month), year)).when(p == "approx", F.concat(F.lit("circa "), year)).when(
        p == "before", F.concat(F.lit("before "), year)).when(p == "after", F.concat(F.lit("after "), year)).when(
        p == "between", F.concat(F.lit("between "), year, F.lit(" and "), F.coalesce(year_of(d2).cast("string"), F.lit("?")))).otherwise(year)


def days_from(date, precision, ref) -> Column:
    """Days from ``ref`` (DATE) to an exact date, or null."""
    return F.when(_col(precision) == "exact", F.datediff(_full(_col(date)), _col(ref)))


def month_day_distance(date, precision, ref) -> Column:
    """Signed days from ``ref`` to the date's month and day in ref's year, the short way
    round the year; null unless exact, and for 29 February in a common year."""
    d, r = _col(date), _col(ref)
    this = _full(F.when((_col(precision) == "exact") & day_of(d).isNotNull(), F.concat(F.lpad(F.year(r).cast("string"), 4, "0"), F.substring(d, 5, 6))))
    apart = F.datediff(this, r)
    length = F.when(is_leap_year(F.year(r)), F.lit(366)).otherwise(F.lit(365))
    return F.when(apart > HALF_YEAR, apart - length).when(apart < -HALF_YEAR, apart + length).otherwise(apart)


def ref_date(attested, item_date, born=None) -> Column:
    """The attested date of a reference; else, for people, the later of the item's date and
    the birth; else the item's date."""
    own = _col(item_date)
    late = own if born is None else F.coalesce(F.greatest(own, _col(born)), own)
    return F.coalesce(F.nullif(_col(attested), F.lit("")), late)


def life_line(dob: Column, dod: Column) -> Column:
    """'1828–1909', 'b. 1828' or 'd. 1909', with circa before approximate years; open dates are left out."""
    def year(x: Column) -> Column:
        y = F.nullif(F.regexp_extract(x["date"], r"^(\d{4})", 1), F.lit(""))
        return F.when(x["precision"].isin(*POINT_PRECISIONS), F.when(x["precision"] == "approx", F.concat(F.lit("circa "), y)).otherwise(y))
    b, d = year(dob), year(dod)
    return F.when(b.isNotNull() & d.isNotNull(), F.concat(b, F.lit("–"), d)).when(b.isNotNull(), F.concat(F.lit("b. "), b)).when(
        d.isNotNull(), F.concat(F.lit("d. "), d))


def gedcom_date(date, precision, date2=None) -> Column:
    """A GEDCOM 7 date value."""
    d, p = _col(date), _col(precision)
    d2 = F.lit(None).cast("string") if date2 is None else _col(date2)

    def plain(x: Column) -> Column:
        return F.concat_ws(" ", day_of(x).cast("string"), _lookup(GEDCOM_MONTHS, month_index(x)), F.regexp_extract(x, r"^(\d{4})", 1))
    word = F.when(p == "approx", F.lit("ABT ")).when(p == "before", F.lit("BEF ")).when(p == "after", F.lit("AFT ")).otherwise(F.lit(""))
    return F.when(d.isNull() | (d == ""), F.lit(None).cast("string")).when(
        p == "between", F.concat(F.lit("BET "), plain(d), F.lit(" AND "), plain(d2))).otherwise(F.concat(word, plain(d)))


def _iso(text: Column) -> Column:
    """ISO form of 'D MON YYYY', 'MON YYYY' or 'YYYY'; else null."""
    t = F.upper(F.trim(text))
    day, mon, year = (F.regexp_extract(t, r"^(?:(\d{1,2}) )?(?:([A-Z]{3}) )?(\d{3,4})$", i) for i in (1, 2, 3))
    month = F.array_position(F.array(*[F.lit(m) for m in GEDCOM_MONTHS]), mon)
    y = F.lpad(year, 4, "0")
    return F.when(year == "", F.lit(None).cast("string")).when((mon == "") & (day == ""), y).when((mon == "") | (month == 0), F.lit(None).cast("string")).when(
        day == "", F.concat(y, F.lit("-"), F.lpad(month.cast("string"), 2, "0"))).otherwise(
        F.concat(y, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0")))


def parse_gedcom_date(value) -> Column:
    """struct<date, precision, date2> of a GEDCOM date value."""
    v = F.trim(_col(value))
    two = r"^(?:BET|FROM) (.+?) (?:AND|TO) (.+)$"
    one = r"^(ABT|EST|CAL|INT|BEF|AFT|FROM|TO) (.+?)(?: \(.*\))?$"
    none = F.lit(None).cast("string")

    def dated(date: Column, precision: Column, date2: Column = none) -> Column:
        return F.struct(date.alias("date"), precision.alias("precision"), date2.alias("date2"))
    mark = F.regexp_extract(v, one, 1)
    kind = F.when(mark.isin("ABT", "EST", "CAL", "INT"), F.lit("approx")).when(mark.isin("BEF", "TO"), F.lit("before")).otherwise(F.lit("after"))
    return F.when(v.isNull() | (v == ""), F.lit(None)).when(F.rlike(v, F.lit(two)), dated(
        _iso(F.regexp_extract(v, two, 1)), F.lit("between"), _iso(F.regexp_extract(v, two, 2)))).when(
        F.rlike(v, F.lit(one)), dated(_iso(F.regexp_extract(v, one, 2)), kind)).when(F.startswith(v, F.lit("(")), dated(F.lit(""), F.lit("approx"))).otherwise(
        dated(_iso(v), F.lit("exact")))


def normalize_date_fact(text, precision) -> Column:
    """struct<date, precision> of a date told in words: ISO forms, day-first numbers and
    named months. The precision is never finer than the text; other text gives nulls."""
    t = F.trim(_col(text))
    p = _col(precision)
    names = "|".join(MONTHS)
    short = F.initcap(F.substring(F.regexp_extract(t, rf"(?i)({names}|{'|'.join(m[:3] for m in MONTHS)})", 1), 1, 3))
    month = F.lpad(F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short).cast("string"), 2, "0")
    dmy = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"
    worded = rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)? (?:{names}|[a-z]{{3}}),? (\d{{4}})$"
    mdy = rf"(?i)^(?:{names}|[a-z]{{3}}) (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})$"
    my = rf"(?i)^(?:{names}|[a-z]{{3}}),? (\d{{4}})$"
    pad = lambda x: F.lpad(x, 2, "0")
    iso = F.when(F.rlike(t, F.lit(r"^\d{4}(-\d{2}(-\d{2})?)?$")), t).when(F.rlike(t, F.lit(dmy)), F.concat_ws(
        "-", F.regexp_extract(t, dmy, 3), pad(F.regexp_extract(t, dmy, 2)), pad(F.regexp_extract(t, dmy, 1)))).when(
        F.rlike(t, F.lit(worded)) & (short != ""), F.concat_ws("-", F.regexp_extract(t, worded, 2), month, pad(F.regexp_extract(t, worded, 1)))).when(
        F.rlike(t, F.lit(mdy)) & (short != ""), F.concat_ws("-", F.regexp_extract(t, mdy, 2), month, pad(F.regexp_extract(t, mdy, 1)))).when(
        F.rlike(t, F.lit(my)) & (short != ""), F.concat_ws("-", F.regexp_extract(t, my, 1), month))
    iso = F.when(viable_date(iso), iso)
    size = F.length(iso)
    finest = F.when(size == 4, F.lit("year")).when(size == 7, F.lit("month")).otherwise(F.lit("exact"))
    kept = F.when(iso.isNull(), F.lit(None).cast("string")).when(F.coalesce(p, F.lit("exact")) == "exact", finest).when(
        (p == "month") & (size == 4), F.lit("year")).otherwise(p)
    return F.struct(iso.alias("date"), kept.alias("precision"))


def normalize_age_fact(value) -> Column:
    """A whole age between 1 and 109, else null."""
    age = F.try_to_number(F.regexp_extract(_col(value).cast("string"), r"^\s*(\d{1,3})\s*$", 1), F.lit("999")).cast("int")
    return F.when((age > 0) & (age < 110), age)


def suggestion_year(text) -> Column:
    """The year meant by 'about 1963', 'summer 1963' or 'the 1960s'; else null."""
    return F.nullif(F.regexp_extract(_col(text), r"\b(1[0-9]{3}|20[0-9]{2})(?:s\b|\b)", 1), F.lit("")).cast("int")


def event_date(asserted: Column, dob: Column, ages) -> Column:
    """struct<date, precision> of an event: as asserted, else the birth year and the highest
    told age, approximately; null where neither is known."""
    told = F.array_max(_col(ages))
    derived = F.struct((year_of(dob["date"]) + told).cast("string").alias("date"), F.lit("approx").alias("precision"))
    own = F.struct(asserted["date"].alias("date"), asserted["precision"].alias("precision"))
    return F.when(asserted["date"].isNotNull(), own).when(year_of(dob["date"]).isNotNull() & told.isNotNull(), derived)
