"""What a reader sees: the filters and predicates of the query layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.functions.dates import year_of

TYPE_LABELS = {"letter": "Letter", "document": "Document", "photo": "Photograph", "object": "Object", "ephemera": "Ephemera", "audio": "Recording", "video": "Film", "story": "Story", "event": "Event"}


def flag(name: str) -> Column:
    """A flag that is false where absent."""
    return F.coalesce(F.col(name), F.lit(False))


def catalogued(items: DataFrame) -> DataFrame:
    return items.where(F.coalesce("status", F.lit("")) != "draft")


def published(items: DataFrame, flags: tuple[str, ...] = ("clarification", "reflection", "evidence")) -> DataFrame:
    shown = catalogued(items)
    for name in flags:
        shown = shown.where(~flag(name))
    return shown


def discoverable(items: DataFrame) -> DataFrame:
    """Published items that a surface may bring up by itself."""
    return published(items).where(~flag("sensitive"))


def one_of(items: DataFrame, seed: int) -> DataFrame:
    """One discoverable item, each as likely as the others; the same for the same seed."""
    lot = F.struct(F.xxhash64(F.lit(seed), "id").alias("lot"), "id")
    shown = discoverable(items)
    return shown.agg(F.min_by(F.struct(*shown.columns), lot).alias("x")).where("x is not null").select("x.*")


def drafts(items: DataFrame, teller: str | None = None) -> DataFrame:
    own = items.where(F.col("status") == "draft")
    return own if teller is None else own.where(F.col("told_by") == teller)


def with_status(df: DataFrame, *statuses: str) -> DataFrame:
    return df.where(F.col("status").isin(*statuses))


def has_ref(refs: Column, target) -> Column:
    return F.coalesce(F.exists(refs, lambda r: r["id"] == target), F.lit(False))


def involves(person) -> Column:
    """The teller, or one of the people."""
    return F.coalesce(F.col("told_by") == person, F.lit(False)) | has_ref(F.col("people"), person)


def at_place(person, place_ref: Column) -> Column:
    """Only where the place itself names the person: being mentioned together is not presence."""
    return F.coalesce(F.array_contains(place_ref["people"], person), F.lit(False))


def fragments_for(items: DataFrame, kind: str, target) -> DataFrame:
    """Clarifications, reflections or evidence that point at the target."""
    hit = F.lit(False)
    for refs in {"clarification": ("people", "items"), "reflection": ("people", "places"), "evidence": ("people", "places", "items")}[kind]:
        hit = hit | has_ref(F.col(refs), target)
    return catalogued(items).where(flag(kind) & hit)


def artifacts(items: DataFrame) -> DataFrame:
    return items.where(F.col("type") != "story")


def of_types(items: DataFrame, types: tuple[str, ...] | None, known: tuple[str, ...]) -> DataFrame:
    """Items of the wanted types; a wish for unknown types is no wish."""
    wanted = [t for t in types or () if t in known]
    return items.where(F.col("type").isin(*wanted)) if wanted else items


def in_years(items: DataFrame, first, last, date: str = "date") -> DataFrame:
    """Items dated within both bounds; without two finite bounds all items."""
    def number(x):
        try:
            return int(str(x).strip())
        except (TypeError, ValueError):
            return None
    low, high = number(first), number(last)
    return items if low is None or high is None else items.where(year_of(date).between(low, high))


def around(items: DataFrame, year: int | None, reach: int = 2, date: str = "date") -> DataFrame:
    """Items within ``reach`` years of the cursor; without cursor all that have a year."""
    y = year_of(date)
    return items.where(y.isNotNull() if year is None else F.abs(y - year) <= reach)


def without(items: DataFrame, shown: DataFrame, key: str = "id") -> DataFrame:
    return items.join(shown.select(key), key, "left_anti")


def review_queue(people: DataFrame) -> DataFrame:
    """One row: pending proposals and those already settled."""
    pending = F.count_if(F.col("status") == "proposed")
    return people.agg(pending.alias("pending"), (F.count(F.lit(1)) - pending).alias("already"))


def import_status(sessions: DataFrame, people: DataFrame) -> DataFrame:
    """Pending sessions are reviewed once nobody is proposed any more."""
    open_ = people.where("status = 'proposed'").limit(1).agg((F.count(F.lit(1)) > 0).alias("open"))
    done = (F.col("status") == "pending") & ~F.col("open")
    return sessions.crossJoin(F.broadcast(open_)).withColumn("status", F.when(done, "reviewed").otherwise(F.col("status"))).drop("open")  # one row


def person_for_email(people: DataFrame, email: str) -> DataFrame:
    return people.where(F.lower("email") == email.lower())


def shortlist(items: DataFrame, person: str, names: list[str], prefix: int = 4096) -> DataFrame:
    """Catalogued items that involve the person or name them, in their text or at the head of
    the transcription."""
    wanted = [n.lower() for n in names if n.strip()]
    wanted += [n.split()[0] for n in wanted if " " in n]
    text = F.lower(F.concat_ws(" ", "title", "description", "story"))
    head = F.lower(F.left(F.coalesce("transcription", F.lit("")), F.lit(prefix)))
    named = F.lit(False)
    for n in dict.fromkeys(wanted):
        named = named | F.contains(text, F.lit(n)) | F.contains(head, F.lit(n))
    return catalogued(items).where(involves(person) | named)


def type_label(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), kind)


def flagged(df: DataFrame, group: str, order: str, is_flagged: Column) -> DataFrame:
    """The flagged rows of each group with the flagged count and the next flagged one after
    each, the last one followed by the first."""
    own = df.where(F.coalesce(is_flagged, F.lit(False)))
    w = Window.partitionBy(group)
    following = F.lead(order).over(w.orderBy(order))
    return own.withColumns({"n_flagged": F.count(F.lit(1)).over(w), "next_flagged": F.coalesce(following, F.min(order).over(w))})


def available(pages: DataFrame, busy: DataFrame, key: str = "page") -> DataFrame:
    """Pages without a pending turn or a transcription under way."""
    blocked = busy.where((F.coalesce(F.col("rotation") % 360, F.lit(0)) != 0) | (F.col("state") == "transcribing"))
    return pages.join(blocked.select(key), key, "left_anti")


def next_after(df: DataFrame, key: str, start) -> DataFrame:
    """One row: the first key after ``start``, else the first of all."""
    return df.agg(F.coalesce(F.min(F.when(F.col(key) > start, F.col(key))), F.min(key)).alias(key))


def open_batches(batches: DataFrame) -> DataFrame:
    """Unconfirmed batches with an unconfirmed document, and their progress."""
    done = F.size(F.filter("boundaries", lambda b: b["status"] == "confirmed"))
    return batches.where((F.col("status") != "confirmed") & F.exists("boundaries", lambda b: b["status"] != "confirmed")).withColumns(
        {"confirmed": done, "documents": F.size("boundaries")})


def told_and_mentioned(items: DataFrame, person) -> DataFrame:
    """The person's items, each in one section: told by them, or about them."""
    return items.where(involves(person)).withColumn("section", F.when(F.col("told_by") == person, "told").otherwise("about"))


def autocomplete(df: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """The first names or aliases that hold the text, by ``pos``."""
    t = text.lower()
    hit = F.contains(F.lower("name"), F.lit(t)) | F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(t))), F.lit(False))
    return df.where(hit).orderBy("pos").limit(limit)


def resume(queue: DataFrame, decided: DataFrame, at: str | None) -> DataFrame:
    """One row: where a review goes on - at ``at`` if it is still open, else at the first."""
    left = queue.join(decided.select("id"), "id", "left_anti")
    return left.agg(F.min_by("id", F.struct((F.col("id") != F.lit(at or "")).alias("other"), "pos")).alias("id"))
