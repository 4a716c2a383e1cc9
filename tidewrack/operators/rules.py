"""Validation as data: every broken rule is a row (rule, record_id, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack import schemas as S
from tidewrack.functions.dates import viable_date, year_of
from tidewrack.operators.visibility import flag


#: An address as a record may carry it.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


class ArchiveError(ValueError):
    """Raised by :func:`strict` with the first violations."""


def violations(df: DataFrame, key: str, rules: dict[str, Column], detail: dict[str, Column] | None = None) -> DataFrame:
    """A row for every rule (a condition that should hold) that a record breaks; all rules are
    tested in one pass."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule"), (detail or {}).get(name, F.lit(None)).cast("string").alias("detail"))) for name, ok in rules.items()]
    return df.select(F.col(key).cast("string").alias("record_id"), F.explode(F.filter(F.array(*broken), lambda b: b.isNotNull())).alias("b")).select("b.rule", "record_id", "b.detail")


def strict(*checks: DataFrame, show: int = 5) -> None:
    """Raise if any check has a row."""
    for c in checks:
        rows = c.take(show)
        if rows:
            raise ArchiveError("; ".join(str(r.asDict()) for r in rows))


def _dated(name: str) -> Column:
    d = F.col(name)
    between = d["precision"] != "between"
    return d.isNull() | d["date"].isNull() | (viable_date(d["date"]) & d["precision"].isin(*S.PRECISIONS) & (between | viable_date(F.coalesce(d["date2"], F.lit("")))))


def _filled(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit("")) != ""


def _any(name: str) -> Column:
    return F.coalesce(F.size(name) > 0, F.lit(False))


def _said(x: Column) -> Column:
    """Whether a text says something."""
    return F.coalesce(F.trim(x), F.lit("")) != ""


def _every(name: str, ok) -> Column:
    """Whether all entries of a list, if there are any, are in order."""
    return F.col(name).isNull() | F.forall(name, lambda x: F.coalesce(ok(x), F.lit(False)))


def _id(x: Column) -> Column:
    return F.rlike(x, F.lit(S.ID_PATTERN))


def _when(d: Column) -> Column:
    """Whether a dated fact, if there is one, has a date that exists, a known precision and, between two, the second."""
    return d.isNull() | d["date"].isNull() | (viable_date(d["date"]) & F.coalesce(d["precision"], F.lit("exact")).isin(*S.PRECISIONS) & (
        (F.coalesce(d["precision"], F.lit("")) != "between") | viable_date(F.coalesce(d["date2"], F.lit("")))))


def person_rules(full: bool = False) -> dict[str, Column]:
    """Rules of a person; ``full`` adds those on e-mail, residence and the words of a basis, for tables that have these columns."""
    rules = {"id": F.rlike("id", F.lit(S.ID_PATTERN)), "name": _filled("name"), "dob": _dated("dob"), "dod": _dated("dod"),
             "status": F.coalesce("status", F.lit("confirmed")).isin(*S.RECORD_STATUSES),
             "basis": (F.coalesce("status", F.lit("")) != "estimated") | F.col("basis").isNotNull()}
    if full:
        rules |= {"email": F.col("email").isNull() | F.rlike(F.lower(F.trim("email")), F.lit(EMAIL)), "residence": _every("residence", lambda r: _id(r["place"])),
                  "basis-text": F.col("basis").isNull() | _said(F.col("basis.text"))}
    return rules


def org_rules() -> dict[str, Column]:
    return {"id": _id(F.col("id")), "name": _filled("name"), "status": F.coalesce("status", F.lit("confirmed")).isin(*S.RECORD_STATUSES)}


def theme_rules() -> dict[str, Column]:
    return {"id": _filled("id"), "title": _filled("title")}


def session_rules() -> dict[str, Column]:
    """A review session: its id, title and status, who speaks in its messages, and what its decisions say."""
    return {"id": _id(F.col("id")), "title": _filled("title"), "status": F.coalesce("status", F.lit("pending")).isin(*S.SESSION_STATUSES),
            "role": _every("attempts", lambda a: F.coalesce(F.forall(a["messages"], lambda m: F.coalesce(m["role"].isin("user", "assistant"), F.lit(False))), F.lit(True))),
            "decision": _every("attempts", lambda a: F.coalesce(F.forall(a["decisions"], lambda d: F.coalesce(d["decision"].isin(*S.REVIEW_DECISIONS), F.lit(False))), F.lit(True))),
            "person": _every("attempts", lambda a: F.coalesce(F.forall(a["decisions"], lambda d: _said(d["person_id"])), F.lit(True)))}


def entry_rules() -> dict[str, Column]:
    """What an item's lists hold: references with an id, a status they may have and a date that
    exists, assets with kind and file, told dates with a known precision. An item needs a date."""
    gone = F.col("status") == "deleted"
    refs = {f"{kind}-entry": _every(kind, lambda r: _said(r["id"]) & (r["status"].isNull() | r["status"].isin("proposed", "confirmed")) & _when(r["date"])) for kind in ("people", "places", "orgs", "themes", "items")}
    rest = {"assets": _every("assets", lambda a: _said(a["kind"]) & _said(a["file"])),
            "date-mentions": _every("date_mentions", lambda m: _said(m["date"]) & F.coalesce(m["precision"], F.lit("exact")).isin(*S.PRECISIONS)),
            "date-required": _filled("date") & _filled("date_precision")}
    return {name: gone | ok for name, ok in (refs | rest).items()}


def repeated_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Violations of tables in which an id may stand once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated-id").alias("rule"), F.col(key).cast("string").alias("record_id"), F.col("n").cast("string").alias("detail"))


def relationship_rules() -> dict[str, Column]:
    return {"kind": F.col("kind").isin(*S.RELATIONSHIP_KINDS), "ends": _filled("a") & _filled("b") & (F.col("a") != F.col("b")), "date": _dated("date"),
            "status": F.col("status").isNull() | F.col("status").isin(*S.RECORD_STATUSES)}


def place_rules() -> dict[str, Column]:
    return {"id": F.rlike("id", F.lit(S.ID_PATTERN)), "name": _filled("name"), "precision": F.coalesce("precision", F.lit("")).isin(*S.PLACE_PRECISIONS),
            "lat": F.col("lat").isNull() | F.col("lat").between(-90, 90), "lng": F.col("lng").isNull() | F.col("lng").between(-180, 180)}


def item_rules() -> dict[str, Column]:
    gone = F.col("status") == "deleted"
    fragment = lambda name, ok: ~flag(name) | ok
    story = F.col("type") == "story"
    rules = {
        "id": F.rlike("id", F.lit(S.ID_PATTERN)), "type": F.col("type").isin(*S.ITEM_TYPES), "status": F.col("status").isin(*S.ITEM_STATUSES),
    }
    rest = {
        "title": _filled("title"), "event-kind": (F.col("type") != "event") | F.col("kind").isin(*S.EVENT_KINDS),
        "date": F.col("date").isNull() | viable_date("date"), "precision": F.col("date").isNull() | F.col("date_precision").isin(*S.PRECISIONS),
        "between": (F.coalesce("date_precision", F.lit("")) != "between") | viable_date(F.coalesce("date2", F.lit(""))),
        "transcription": F.coalesce(F.nullif("transcription_status", F.lit("")), F.lit("none")).isin(*S.TRANSCRIPTION_STATUSES),
        "sources": F.col("sources").isNull() | F.forall("sources", lambda s: F.rlike(s["url"], F.lit("^https?://")) & (F.coalesce(s["accessed"], F.lit("")) != "")),
        "clarification": fragment("clarification", story & (_any("people") | _any("items"))),
        "reflection": fragment("reflection", story & ~flag("clarification") & (_any("people") | _any("places"))),
        "evidence": fragment("evidence", ~story & (_any("people") | _any("places") | _any("items"))),
    }
    return rules | {name: gone | ok for name, ok in rest.items()}


def completeness(items: DataFrame) -> DataFrame:
    """Dates parse; objects and photographs say how they are attested."""
    shown = items.where("status = 'catalogued'")
    return violations(shown, "id", {"date-parses": F.col("date").isNull() | viable_date("date"),
                                    "attested": ~F.col("type").isin("object", "photo") | _filled("provenance") | _filled("source")})


def one_way_links(items: DataFrame) -> DataFrame:
    """Catalogued items that refer to one that does not refer back."""
    links = items.where("status = 'catalogued'").select(F.col("id").alias("a"), F.explode("items").alias("r")).select("a", F.col("r.id").alias("b"))
    return links.join(links.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti").select(F.lit("one-way").alias("rule"), F.col("a").alias("record_id"), F.col("b").alias("detail"))


def told_day_stories(items: DataFrame) -> DataFrame:
    """Stories dated by the day on which they were told."""
    told = F.substring(F.coalesce("recorded", "created", "created_at"), 1, 10)
    return violations(items.where("type = 'story'"), "id", {"told-day": F.coalesce(F.col("date") != told, F.lit(True))})


def implausible_years(suggested: DataFrame, year: str, dob: str) -> DataFrame:
    """Suggestions before the birth."""
    return suggested.where(F.col(year) < year_of(dob))


def deterministic_violations(stories: DataFrame) -> DataFrame:
    """Faults of a told story that need no judgement: a narrator without link, a date asked
    for that can be computed, an age without birth that was not asked, a date made up from the
    day of telling, an event without date, a new artifact not asked about."""
    return violations(stories, "id", {
        "unconnected-narrator": F.col("narrator_linked"), "asked-computable-date": ~(F.col("asked_date") & F.col("date_computable")),
        "age-without-birth": ~(F.col("has_age") & ~F.col("has_dob") & ~F.col("asked_birth")), "telling-day": ~F.coalesce(F.col("date") == F.col("told_day"), F.lit(False)),
        "event-date": ~(F.col("is_event") & F.col("date").isNull()), "new-artifact": ~(F.col("names_artifact") & ~F.col("asked_artifact"))})


def confirmation_rules() -> dict[str, Column]:
    """A confirmation names its batch and pages; only a rejected one may lack text."""
    return {"batch": _filled("batch_id"), "doc_index": F.col("doc_index") >= 0, "pages": _any("pages"), "status": F.col("status").isin("confirmed", "rejected"),
            "text": (F.col("status") == "rejected") | _filled("text")}
