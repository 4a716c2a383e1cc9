"""Genealogy interchange: the archive's people and links as GEDCOM 7 lines, and back.

A document is a table of lines (pos, level, xref, tag, value); writing sorts it, reading
numbers it. Families and ids come from ranks over sorted keys, so equal archives give equal
documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.functions.dates import gedcom_date, parse_gedcom_date

#: Fixed lines at the top of a document.
HEADER = ("0 HEAD", "1 SOUR archive-export", "2 VERS 0.1", "1 GEDC", "2 VERS 7.0", "2 FORM LINEAGE-LINKED", "1 CHAR UTF-8")
_OUT = ("confirmed", "estimated")


def _shown(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("status", F.lit("confirmed")).isin(*_OUT))


def _numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their rank over all, as ids of a document need it: one row per person or
    family, and a document is one file."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def families(edges: DataFrame) -> DataFrame:
    """(fam, a, b, marriage, children): spouse pairs in order, then pairs of parents without a
    spouse link, then single parents."""
    pair = edges.where("kind = 'spouse'").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.min("date").alias("marriage")).withColumn("rank", F.lit(0))
    parents = edges.where("kind = 'parent'").groupBy(F.col("b").alias("child")).agg(F.array_sort(F.collect_set("a")).alias("p"))
    routed = parents.select("child", F.get("p", 0).alias("a"), F.when(F.size("p") == 2, F.get("p", 1)).alias("b"))
    kids = routed.groupBy("a", "b").agg(F.array_sort(F.collect_list("child")).alias("children"), F.min("child").alias("first"))
    both = pair.alias("m").join(kids.alias("k"), F.col("m.a").eqNullSafe(F.col("k.a")) & F.col("m.b").eqNullSafe(F.col("k.b")), "full")
    flat = both.select(F.coalesce("m.a", "k.a").alias("a"), F.coalesce("m.b", "k.b").alias("b"), "marriage", F.coalesce("children", F.array().cast("array<string>")).alias("children"),
                       F.coalesce("rank", F.when(F.col("k.b").isNotNull(), 1).otherwise(2)).alias("rank"), "first")
    # pairs by their ids, unmarried parents by their first child, single parents by their id
    key = F.when(F.col("rank") == 1, F.col("first"))
    return _numbered(flat, ["rank", key.asc_nulls_first(), "a", "b"], "fam")


def _role(pronouns: Column, place: int) -> Column:
    """HUSB or WIFE from attested pronouns, else from the place in the pair; never from a name."""
    p = F.lower(F.coalesce(pronouns, F.lit("")))
    return F.when(F.startswith(p, F.lit("he")), "HUSB").when(F.startswith(p, F.lit("she")), "WIFE").otherwise("HUSB" if place == 0 else "WIFE")


def _note(level: int, text: Column) -> Column:
    parts = F.split(text, "\n")
    return F.transform(parts, lambda t, i: F.concat(F.when(i == 0, F.lit(f"{level} NOTE ")).otherwise(F.lit(f"{level + 1} CONT ")), t))


def _basis(level: int, basis: Column) -> Column:
    said = F.concat_ws(" ", F.concat(F.lit("Estimated: "), F.coalesce(basis["text"], F.lit("no basis recorded"))), F.when(basis["by"].isNotNull(), F.concat(F.lit("("), F.concat_ws(", ", basis["by"], basis["when"]), F.lit(")"))))
    return _note(level, said)


def export_lines(people: DataFrame, edges: DataFrame, places: DataFrame, stories: DataFrame) -> DataFrame:
    """(section, key, seq, sub, line): the document's lines and their order. ``stories`` has
    (person, text). Only confirmed and estimated records leave; an estimate carries its basis."""
    spark = people.sparkSession
    own = _numbered(_shown(people), ["id"], "n").withColumn("xref", F.concat(F.lit("@P"), F.col("n").cast("string"), F.lit("@")))
    ids = own.select("id", "xref", "pronouns", "basis", "status")
    links = _shown(edges).join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    parts = []

    def lines(df: DataFrame, section: int, key: Column, seq: int, texts: Column, order: Column | None = None) -> None:
        parts.append(df.select(F.lit(section).alias("section"), key.cast("long").alias("key"), F.lit(seq).alias("seq"), (F.lit("") if order is None else order.cast("string")).alias("ord"), F.posexplode(texts).alias("sub", "line")))
    one = lambda *c: F.array(F.concat(*c))
    lines(spark.range(1), 0, F.lit(0), 0, F.array(*[F.lit(h) for h in HEADER]))
    fam = families(links)
    k = F.col("fam")
    lines(fam, 1, k, 0, one(F.lit("0 @F"), k.cast("string"), F.lit("@ FAM")))
    for place, side in enumerate("ab"):
        named = fam.join(ids.select(F.col("id").alias(side), "xref", "pronouns"), side)
        lines(named, 1, k, 1 + place, one(F.lit("1 "), _role(F.col("pronouns"), place), F.lit(" "), F.col("xref")))
    wed = fam.where("marriage.date is not null")
    lines(wed, 1, k, 3, F.array(F.lit("1 MARR"), F.concat(F.lit("2 DATE "), gedcom_date("marriage.date", F.coalesce("marriage.precision", F.lit("exact")), "marriage.date2"))))
    kids = fam.select("fam", F.posexplode("children").alias("i", "id")).join(ids.select("id", "xref"), "id")
    lines(kids, 1, k, 4, one(F.lit("1 CHIL "), F.col("xref")), F.lpad(F.col("i").cast("string"), 6, "0"))
    guessed = links.where("status = 'estimated' and kind in ('spouse', 'parent')").select(F.col("a").alias("x"), F.col("b").alias("y"))
    notes = fam.select("fam", "a", "b", F.explode(F.concat(F.array("b"), "children")).alias("y")).where("y is not null").join(guessed, "y").where("x = a or x = b").groupBy("fam").agg(F.min("y").alias("id"))
    lines(notes.join(ids.select("id", "basis"), "id"), 1, k, 5, _basis(1, F.col("basis")))
    n = F.col("n")
    lines(own, 2, n, 0, F.array(F.concat(F.lit("0 "), F.col("xref"), F.lit(" INDI")), F.concat(F.lit("1 REFN "), F.col("id")), F.concat(F.lit("1 NAME "), F.col("name"))))
    lines(own, 2, n, 1, F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.concat(F.lit("1 NAME "), a)))
    for seq, (tag, field) in enumerate((("BIRT", "dob"), ("DEAT", "dod")), 2):
        d = own.where(F.col(f"{field}.date").isNotNull())
        lines(d, 2, n, seq, F.array(F.lit(f"1 {tag}"), F.concat(F.lit("2 DATE "), gedcom_date(f"{field}.date", F.coalesce(f"{field}.precision", F.lit("exact")), f"{field}.date2"))))
    lines(own, 2, n, 4, F.transform(F.coalesce("occupations", F.array().cast("array<string>")), lambda o: F.concat(F.lit("1 OCCU "), o)))
    homes = own.select("n", F.posexplode("residence").alias("i", "r")).where("coalesce(r.status, '') <> 'proposed'").join(
        places.select(F.col("id").alias("p_id"), F.col("name").alias("p_name")), F.col("r.place") == F.col("p_id"), "left")
    lines(homes, 2, n, 5, F.filter(F.array(F.lit("1 RESI"), F.concat(F.lit("2 DATE FROM "), F.coalesce("r.from", F.lit("")), F.lit(" TO "), F.coalesce("r.to", F.lit(""))), F.concat(F.lit("2 PLAC "), F.col("p_name"))),
                                   lambda x: x.isNotNull()), F.lpad(F.col("i").cast("string"), 6, "0"))
    told = stories.where("trim(text) <> ''").select(F.col("person").alias("id"), F.trim("text").alias("text")).distinct().join(own.select("id", "n"), "id")
    lines(told, 2, n, 6, _note(1, F.col("text")), F.col("text"))
    lines(own.where("status = 'estimated'"), 2, n, 7, _basis(1, F.col("basis")))
    other = links.where(F.col("kind").isin("sibling", "inlaw", "teacher")).join(own.select(F.col("id").alias("a"), "n"), "a").join(ids.select(F.col("id").alias("b"), "xref", F.col("basis").alias("b_basis")), "b")
    label = F.when(F.col("kind") == "inlaw", "in-law").otherwise(F.col("kind"))
    extra = F.when(F.col("status") == "estimated", _basis(2, F.col("b_basis"))).otherwise(F.array().cast("array<string>"))
    lines(other, 2, n, 8, F.concat(F.array(F.concat(F.lit("1 ASSO "), F.col("xref")), F.concat(F.lit("2 RELA "), label)), extra), F.concat_ws("|", "b", "kind"))
    lines(spark.range(1), 3, F.lit(0), 0, F.array(F.lit("0 TRLR")))
    return reduce(DataFrame.unionByName, parts).select("section", "key", "seq", "ord", "sub", "line")


def write_gedcom(lines: DataFrame, path: str) -> None:
    """One text file: a document cannot be split, and a genealogy fits a machine."""
    lines.orderBy("section", "key", "seq", "ord", "sub").select("line").coalesce(1).write.mode("errorifexists").text(path)


def parse_lines(text: DataFrame, pos: str = "pos", line: str = "line") -> DataFrame:
    """(pos, level, xref, tag, value) of a document's lines."""
    p = r"^\s*(\d+) (?:(@[^@]+@) )?([A-Z0-9_]+)(?: (.*))?$"
    g = lambda i: F.regexp_extract(line, p, i)
    return text.where(F.rlike(line, F.lit(p))).select(F.col(pos).alias("pos"), g(1).cast("int").alias("level"), F.nullif(g(2), F.lit("")).alias("xref"), g(3).alias("tag"), F.trim(g(4)).alias("value"))


def import_records(lines: DataFrame) -> DataFrame:
    """Lines with the record they stand in (record_pos, record_xref, record_tag) and the level-1
    fact above them (fact_pos, fact_tag)."""
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # a document is read in order
    top, fact = F.col("level") == 0, F.col("level") == 1
    last = lambda when, c: F.last(F.when(when, F.col(c)), ignorenulls=True).over(w)
    return lines.withColumns({"record_pos": last(top, "pos"), "record_xref": last(top, "xref"), "record_tag": last(top, "tag"), "fact_pos": last(fact | top, "pos"), "fact_tag": last(fact, "tag")})


def import_gedcom(lines: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(people, relationships, unknown places) of a document. A caller refuses a document that
    names places it does not know; ``tidewrack.operators.rules.strict`` does."""
    r = import_records(lines)
    indi = r.where("record_tag = 'INDI'")
    sub = indi.where("level = 2").groupBy("record_xref", "fact_pos").agg(*[F.min(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in ("DATE", "PLAC", "RELA")])
    facts = indi.where("level = 1").select("record_xref", F.col("pos").alias("fact_pos"), "tag", "value").join(sub, ["record_xref", "fact_pos"], "left")
    known = places.select(F.trim("name").alias("PLAC"), F.col("id").alias("place_id")).groupBy("PLAC").agg(F.min("place_id").alias("place_id"))
    facts = facts.join(known, "PLAC", "left")
    unknown = facts.where("tag = 'RESI' and PLAC is not null and place_id is null").select("record_xref", "PLAC")
    period = r"^FROM (.*?) TO (.*)$"
    start = F.when(F.rlike("DATE", F.lit(period)), F.trim(F.regexp_extract("DATE", period, 1))).otherwise(F.coalesce("DATE", F.lit("")))
    stop = F.when(F.rlike("DATE", F.lit(period)), F.trim(F.regexp_extract("DATE", period, 2))).otherwise(F.coalesce("DATE", F.lit("")))

    def ordered(when: Column, value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(F.col("fact_pos").alias("p"), value.alias("v"))))), lambda x: x["v"])
    names = ordered((F.col("tag") == "NAME") & (F.col("value") != ""), F.col("value"))
    people = facts.groupBy("record_xref").agg(
        F.min(F.when(F.col("tag") == "REFN", F.col("value"))).alias("id"), names.alias("names"),
        F.min(F.when(F.col("tag") == "BIRT", F.col("DATE"))).alias("birth"), F.min(F.when(F.col("tag") == "DEAT", F.col("DATE"))).alias("death"),
        ordered((F.col("tag") == "OCCU") & (F.col("value") != ""), F.col("value")).alias("occupations"),
        ordered(F.col("tag") == "RESI", F.struct(F.col("place_id").alias("place"), start.alias("from"), stop.alias("to"))).alias("residence"))
    people = people.where("id is not null and id <> ''")
    table = people.select("id", F.try_element_at("names", F.lit(1)).alias("name"), F.array_distinct(F.filter(F.slice("names", 2, 1_000_000), lambda a: a != F.get("names", 0))).alias("aliases"),
                          F.lit("confirmed").alias("status"), parse_gedcom_date("birth").alias("dob"), parse_gedcom_date("death").alias("dod"), "occupations", "residence")
    refn = people.select("record_xref", "id")
    fam = r.where("record_tag = 'FAM'")
    pick = lambda t: F.min(F.when((F.col("level") == 1) & (F.col("tag") == t), F.col("value")))
    heads = fam.groupBy("record_xref").agg(pick("HUSB").alias("h"), pick("WIFE").alias("w"), F.min(F.when((F.col("fact_tag") == "MARR") & (F.col("tag") == "DATE"), F.col("value"))).alias("d"))
    kids = fam.where("level = 1 and tag = 'CHIL'").select("record_xref", F.col("value").alias("b"))
    spouses = heads.where("h is not null and w is not null").select(F.col("h").alias("a"), F.col("w").alias("b"), F.lit("spouse").alias("kind"), parse_gedcom_date("d").alias("date"))
    parents = heads.select("record_xref", F.explode(F.filter(F.array("h", "w"), lambda x: x.isNotNull())).alias("a")).join(kids, "record_xref")
    parents = parents.select("a", "b", F.lit("parent").alias("kind"), F.lit(None).cast(spouses.schema["date"].dataType).alias("date"))
    kind = F.when(F.lower("RELA") == "in-law", "inlaw").otherwise(F.lower("RELA"))
    others = facts.where("tag = 'ASSO'").select(F.col("record_xref").alias("a"), F.col("value").alias("b"), kind.alias("kind"), F.lit(None).cast(spouses.schema["date"].dataType).alias("date"))
    edges = spouses.unionByName(parents).unionByName(others)
    named = edges.join(refn.select(F.col("record_xref").alias("a"), F.col("id").alias("ia")), "a").join(refn.select(F.col("record_xref").alias("b"), F.col("id").alias("ib")), "b")
    return table, named.select(F.col("ia").alias("a"), F.col("ib").alias("b"), "kind", "date"), unknown
