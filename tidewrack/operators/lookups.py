"""Read-only questions about the archive: what a reviewer, or a tool for one, asks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.text import joined, relevant_sentences

PEOPLE, ITEMS, QUESTIONS, SUGGESTIONS = 10, 5, 5, 3
EXTRACTION_KINDS = ("person", "place", "org", "theme", "item", "date", "event")
BUCKETS = ("existing", "new", "none")
#: Fixed ring sizes of a marker by how precisely its place is known.
RINGS = {"street": 1.6, "town": 2.2, "county": 2.2, "region": 2.2, "country": 4.0, "continent": 4.0}


def _said() -> Column:
    return F.coalesce(F.nullif("story", F.lit("")), F.nullif("transcription", F.lit("")), F.lit(""))


def search_people(people: DataFrame, query: str, limit: int = PEOPLE) -> DataFrame:
    q = query.strip().lower()
    hit = F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower(F.coalesce("relation", F.lit(""))), F.lit(q))
    return people.where(hit & F.lit(q != "")).orderBy("pos").limit(limit).select("id", "name", "relation")


def person(people: DataFrame, id_: str) -> DataFrame:
    return people.where(F.col("id") == id_).select("id", "name", "relation", "status").limit(1)


def relationships(edges: DataFrame, id_: str) -> DataFrame:
    return edges.where((F.col("a") == id_) | (F.col("b") == id_))


def attested(items: DataFrame, id_: str, name: str | None = None) -> DataFrame:
    """Items that involve the person or name them, with the sentences that do."""
    needles = [name, name.split()[0]] if name else [id_]
    named = F.lit(False)
    for n in needles:
        named = named | F.contains(F.lower(_said()), F.lit(n.lower()))
    involved = F.coalesce(F.exists("people", lambda r: r["id"] == id_), F.lit(False))
    return items.where(involved | named).select("id", "title", (F.coalesce("transcription_status", F.lit("")) == "draft").alias("draft"), relevant_sentences(_said(), needles).alias("quotes"))


def search_items(items: DataFrame, query: str, limit: int = ITEMS, order: str = "id") -> DataFrame:
    q = query.strip().lower()
    hits = items.where(F.contains(F.lower(_said()), F.lit(q)) & F.lit(q != "")).orderBy(order).limit(limit)
    return hits.select("id", "title", (F.coalesce("transcription_status", F.lit("")) == "draft").alias("draft"), relevant_sentences(_said(), [q]).alias("quotes"))


class Undecided(ValueError):
    """An investigation that came to no verdict."""


#: Lookups that an investigation may make, and turns it may take in all.
MOST_LOOKUPS, MOST_TURNS = 4, 9


def investigate(ask: Callable[[list[dict]], dict], tools: dict[str, Callable[..., DataFrame]], complete: Callable[[dict], bool], most: int = MOST_LOOKUPS, turns: int = MOST_TURNS, rows: int = ITEMS) -> dict:
    """Let a model look things up until it gives a verdict: {'verdict', 'trace'}.

    ``ask`` sees the turns so far and answers {'tool', 'args'} or a verdict that ``complete`` accepts. A tool
    is a read-only lookup, of whose table at most ``rows`` rows are shown. After ``most`` lookups a further
    one is refused and said so, an incomplete verdict is sent back, and everything said is in the
    trace. Raises Undecided after ``turns``."""
    trace: list[dict] = []
    used = 0
    for _ in range(turns):
        said = ask(list(trace))
        name = str(said.get("tool") or "").strip()
        turn = {"said": said}
        if name and used >= most:
            turn["reply"] = "no more lookups: conclude"
        elif name:
            used += 1
            args = said.get("args")
            if name not in tools:
                turn["reply"] = f"unknown tool {name}"
            else:
                turn["result"] = [r.asDict(recursive=True) for r in tools[name](**(args if isinstance(args, dict) else {})).limit(rows).collect()]
        elif complete(said):
            return {"verdict": said, "trace": [*trace, turn]}
        else:
            turn["reply"] = "neither a lookup nor a complete verdict"
        trace.append(turn)
    raise Undecided(f"no verdict in {turns} turns")


def history(messages: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, text): a session's messages as role-prefixed lines, reasoning before what was said."""
    line = F.concat_ws("\n", F.when(F.coalesce("thinking", F.lit("")) != "", F.concat(F.col("role"), F.lit(" (thinking): "), F.col("thinking"))), F.concat_ws(": ", "role", "text"))

    return joined(messages, group, order, line, "\n")


def next_story_id(items: DataFrame, recorded: Column, days: DataFrame) -> DataFrame:
    """``days`` with story_id: story-<day>-NN, the first number of the day that is free."""
    day = days.withColumn("_prefix", F.concat(F.lit("story-"), recorded))
    taken = items.where(F.rlike("id", F.lit(r"^story-.*-\d{2,}$"))).select(F.regexp_extract("id", r"^(story-.*)-\d{2,}$", 1).alias("_prefix"), F.regexp_extract("id", r"-(\d{2,})$", 1).cast("int").alias("n"))
    used = taken.groupBy("_prefix").agg(F.array_sort(F.collect_set("n")).alias("used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.coalesce(F.size("used"), F.lit(0)) + 1), F.coalesce("used", F.array().cast("array<int>"))))
    named = day.join(used, "_prefix", "left").withColumn("_n", F.when(F.col("used").isNull(), 1).otherwise(free))
    return named.withColumn("story_id", F.concat(F.col("_prefix"), F.lit("-"), F.lpad(F.col("_n").cast("string"), 2, "0"))).drop("_prefix", "used", "_n")


def contract_errors(results: DataFrame) -> DataFrame:
    """(id, error) of assessments (id, title, extractions, questions) that break the form."""
    broken = F.array(
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.lit("missing title")),
        F.when(F.exists("extractions", lambda x: ~x["kind"].isin(*EXTRACTION_KINDS)), F.lit("extraction kind")),
        F.when(F.exists("extractions", lambda x: ~x["bucket"].isin(*BUCKETS)), F.lit("extraction bucket")),
        F.when(F.size("questions") > QUESTIONS, F.lit("too many questions")),
        F.when(F.exists("questions", lambda q: ~F.coalesce(q["skippable"], F.lit(False))), F.lit("question not skippable")),
        F.when(F.exists("questions", lambda q: F.size(q["suggestions"]) > SUGGESTIONS), F.lit("too many suggestions")))
    return results.select("id", F.explode(F.filter(broken, lambda e: e.isNotNull())).alias("error"))


def marker_ring(precision: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in RINGS.items() for x in p])
    return F.coalesce(F.try_element_at(table, precision), F.lit(1.0))


def heat_step(zoom: Column, steps: tuple[tuple[float, float], ...]) -> Column:
    """The value of the first (max_zoom, value) above the zoom, else of the last."""
    out = F.lit(steps[-1][1])
    for most, v in reversed(steps):
        out = F.when(zoom < most, F.lit(v)).otherwise(out)
    return out


def scale_state(zoom: Column, active: Column, dots_from: float, labels_from: float) -> Column:
    """struct<dots, labels>: what a map shows; a lone place always shows both."""
    alone = active == 1
    return F.struct((alone | (zoom >= dots_from)).alias("dots"), (alone | (zoom >= labels_from)).alias("labels"))
