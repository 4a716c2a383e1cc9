"""A small made-up archive to try the engine on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewrack.schemas import schema


def _day(date: str, precision: str = "exact") -> tuple:
    return date, precision, None


def _refs(*ids: str, told: dict[str, list[str]] | None = None) -> list[tuple]:
    return [(i, None, None, (told or {}).get(i)) for i in ids]


PEOPLE = (
    {"id": "orla-quill", "name": "Orla Quill", "aliases": ["Granny Quill"], "email": "orla@mail.example", "dob": _day("1921-04-02"), "dod": _day("1999", "year"), "occupations": ["ferry clerk"], "status": "confirmed"},
    {"id": "tam-quill", "name": "Tam Quill", "dob": _day("1948-11"), "relation": "son of Orla Quill", "status": "confirmed"},
    {"id": "ines-vale", "name": "Ines Vale", "dob": _day("1950", "approx"), "bio": "Tam Quill's wife.", "status": "estimated", "basis": ("in her forties in 1994", "tam-quill", "2001-01-01", None)},
)
RELATIONSHIPS = ({"a": "orla-quill", "b": "tam-quill", "kind": "parent"}, {"a": "ines-vale", "b": "tam-quill", "kind": "spouse", "date": _day("1975-06-21")})
PLACES = ({"id": "pier-nine", "name": "Pier Nine", "lat": 54.12345, "lng": -3.2, "precision": "exact"}, {"id": "low-moor", "name": "Low Moor", "precision": "town"})
THEMES = ({"id": "boats", "title": "Boats", "items": [("story-1975-06-21-01", ""), ("ledger", "")]},)
ORGS = ({"id": "ferry-line", "name": "Ferry Line"},)
ITEMS = (
    {"id": "ledger", "type": "document", "title": "Ferry ledger", "date": "1940-03", "date_precision": "month", "status": "catalogued", "people": _refs("orla-quill"), "places": _refs("pier-nine", told={"pier-nine": ["orla-quill"]}),
     "themes": _refs("boats"), "orgs": _refs("ferry-line"), "items": _refs("story-1975-06-21-01"), "provenance": "a drawer", "transcription": "Fares and weights.", "transcription_status": "confirmed"},
    {"id": "story-1975-06-21-01", "type": "story", "title": "The wedding on the pier", "date": "1975-06-21", "date_precision": "exact", "status": "catalogued", "told_by": "tam-quill", "people": _refs("ines-vale", "tam-quill"),
     "places": _refs("pier-nine"), "themes": _refs("boats"), "items": _refs("ledger"), "story": "It rained, and the band played under the awning."},
    {"id": "brass-lamp", "type": "object", "title": "Brass lamp", "date": "1930", "date_precision": "approx", "status": "draft", "people": _refs("orla-quill")},
)


def demo(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of the demonstration archive, by record type; a first version of every item."""
    def table(kind: str, records: tuple) -> DataFrame:
        s = schema(kind)
        lists = {f.name for f in s.fields if f.dataType.typeName() == "array"}
        return spark.createDataFrame([tuple(r.get(f.name, [] if f.name in lists else None) for f in s.fields) for r in records], s)
    return {"people": table("people", PEOPLE), "relationships": table("relationships", RELATIONSHIPS), "places": table("places", PLACES), "themes": table("themes", THEMES), "orgs": table("orgs", ORGS),
            "items": table("items", ITEMS)}
