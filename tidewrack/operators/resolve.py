"""Merging proposals with what is confirmed, and the life of a proposal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewrack.functions.text import KIN_TERMS, slug


def _name_key(name: str) -> Column:
    return F.lower(F.trim(name))


def merge_by_name(table: DataFrame, proposed: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """``table`` and those proposals whose id and name (trimmed, without case) are new; of
    proposals with one name the first by ``order``."""
    fresh = proposed.join(table.select(key), key, "left_anti").withColumn("_name", _name_key(name))
    fresh = fresh.join(table.select(_name_key(name).alias("_name")).distinct(), "_name", "left_anti")
    rest = [c for c in proposed.columns if c != name]
    kept = fresh.groupBy("_name").agg(F.min_by(F.struct(*proposed.columns), F.struct(order, key)).alias("x")).select("x.*")
    return table.unionByName(kept.select(*[c for c in kept.columns if c in {*rest, name}]), allowMissingColumns=True)


def merge_people(table: DataFrame, proposed: DataFrame, order: str = "path") -> DataFrame:
    """``table`` and the proposed people that are new: unknown id, and no one of the same name
    in the table or among proposals kept before with a birth that agrees (an unknown birth
    agrees with any). Agreement is not transitive, so a name's proposals are taken in order,
    each against those kept; only one name's rows meet in a task."""
    birth = F.col("dob.date").alias("birth")
    known = table.select(_name_key("name").alias("k"), birth, F.lit(0).alias("rank"), F.lit("").alias("o"), F.col("id"))
    fresh = proposed.join(table.select("id"), "id", "left_anti").select(_name_key("name").alias("k"), birth, F.lit(1).alias("rank"), F.col(order).cast("string").alias("o"), "id")
    group = known.join(fresh.select("k").distinct(), "k", "left_semi").unionByName(fresh)

    def keep(pdf):
        kept: list = []
        out = []
        for r in pdf.sort_values(["rank", "o", "id"]).itertuples():
            agrees = any(b is None or r.birth is None or b == r.birth for b in kept)
            if r.rank == 0 or not agrees:
                kept.append(r.birth)
                if r.rank:
                    out.append(r.id)
        return pdf[pdf["id"].isin(out) & (pdf["rank"] == 1)][["id"]].drop_duplicates()
    chosen = group.groupBy("k").applyInPandas(keep, T.StructType([T.StructField("id", dict((f.name, f.dataType) for f in proposed.schema)["id"])]))
    first = proposed.join(chosen, "id", "left_semi").groupBy("id").agg(F.min_by(F.struct(*proposed.columns), order).alias("x")).select("x.*")
    return table.unionByName(first.drop(*[c for c in [order] if c not in table.columns]), allowMissingColumns=True)


def current_status(events: DataFrame, key: str = "id", order: str = "at") -> DataFrame:
    """(id, status, basis) after all decisions: proposed, then confirmed, estimated (with its
    basis) or deleted. The latest decision holds."""
    kinds = {"propose": "proposed", "confirm": "confirmed", "estimate": "estimated", "promote": "confirmed", "reject": "deleted", "dismiss": "deleted"}
    status = F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("decision"))
    return events.groupBy(key).agg(F.max_by(F.struct(status.alias("status"), F.when(F.col("decision") == "estimate", F.col("basis")).alias("basis")), order).alias("x")).select(key, "x.*")


def apply_decisions(people: DataFrame, edges: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People with their status after the decisions, and edges without those of the deleted."""
    now = current_status(events)
    own = people.drop("status").join(now.select("id", "status"), "id", "left").withColumn("status", F.coalesce("status", F.lit("confirmed")))
    gone = own.where("status = 'deleted'").select("id")
    left = edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select(*edges.columns)
    return own.where("status <> 'deleted'"), left


def blocked_rejections(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """Proposals that may not be rejected because something still refers to them."""
    return wanted.join(links.select(F.col("target").alias("id")), "id", "left_semi")


def changed_decisions(events: DataFrame, key: str = "id", order: str = "at") -> DataFrame:
    """Decisions that change something: the first terminal one of each person."""
    terminal = events.where(F.col("decision").isin("confirm", "estimate", "reject", "dismiss"))
    return terminal.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def extraction_refs(extractions: DataFrame, people: DataFrame, order: str = "pos") -> DataFrame:
    """(item, kind, name, id, minted): what each kept extraction refers to - its match, else
    someone of that name or alias (a relative's word only someone proposed), else a new id.
    Themes and items are never minted."""
    kept = extractions.where(F.coalesce("on", F.lit(True))).withColumn("_k", _name_key("name"))
    forms = people.select("id", "status", F.explode(F.array_distinct(F.concat(F.array(_name_key("name")), F.transform(
        F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))))).alias("_k"))
    known = forms.groupBy("_k").agg(F.min("id").alias("any"), F.min(F.when(F.col("status") == "proposed", F.col("id"))).alias("proposed"))
    found = kept.join(known, "_k", "left")
    kin = F.col("_k").isin(*KIN_TERMS)
    reuse = F.when(F.col("kind") == "person", F.when(kin, F.col("proposed")).otherwise(F.col("any")))
    mint = F.when(F.col("kind").isin("person", "place", "org"), slug(F.col("name")))
    return found.select("item", "kind", "name", F.coalesce("match", reuse, mint).alias("id"), (F.col("match").isNull() & reuse.isNull() & mint.isNotNull()).alias("minted")).where("id is not null")
