"""Text functions: names and mentions, comparison forms, sentences, markers, labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewrack.operators.sequence import greedy_spans

QUOTE_CAP = 300
MATCH_THRESHOLD = 0.34
#: Fixed list: words for relatives, which name nobody.
KIN_TERMS = ("dad", "daddy", "father", "mum", "mummy", "mom", "mother", "mam", "grandma", "granny", "gran", "nana", "nanny", "grandad", "granddad", "grandpa", "grandfather", "grandmother",
             "aunt", "aunty", "auntie", "uncle", "sister", "brother", "cousin")
#: Fixed patterns of links that a text attests, with the kind of link.
ATTESTED = (
    (r"married ([A-Z][\w' -]+?)(?:,|\.|\(|\b\d|$)", "spouse"), (r"([A-Z][\w' -]+?)'s husband", "spouse"), (r"([A-Z][\w' -]+?)'s wife", "spouse"),
    (r"husband of ([A-Z][\w' -]+)", "spouse"), (r"wife of ([A-Z][\w' -]+)", "spouse"),
    (r"son of ([A-Z?][\w' -]+?)(?: and |\.|$)", "parent"), (r"daughter of ([A-Z?][\w' -]+?)(?: and |\.|$)", "parent"), (r"child of ([A-Z?][\w' -]+?)(?: and |\.|$)", "parent"),
    (r"father of ([A-Z][\w' -]+?)(?: and |\.|$)", "parent"), (r"mother of ([A-Z][\w' -]+?)(?: and |\.|$)", "parent"),
    (r"sister-in-law of ([A-Z][\w' -]+)", "inlaw"), (r"brother-in-law of ([A-Z][\w' -]+)", "inlaw"),
)


def escape(text: Column) -> Column:
    """A literal as a regular expression."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def literal_spans(text: Column, alias: Column, fold: Column) -> Column:
    """Spans (start, end, text) of a literal that stands free of ASCII word characters."""
    pattern = F.concat(F.when(fold, F.lit("(?i)")).otherwise(F.lit("")), F.lit(r"(?<![A-Za-z0-9_])"), escape(alias), F.lit(r"(?![A-Za-z0-9_])"))
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(between, found, lambda b, v: F.struct(b.alias("b"), v.alias("v"))), lambda m: m["v"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(a, m):
        s = a["at"] + F.length(m["b"])
        e = s + F.length(m["v"])
        return F.struct(e.alias("at"), F.array_append(a["out"], F.struct(s.alias("start"), e.alias("end"), m["v"].alias("text"))).alias("out"))
    return F.aggregate(pairs, zero, step, lambda a: a["out"])


def match_entities(docs: DataFrame, key: str, text: str, entities: DataFrame, most_aliases: int = 100_000) -> DataFrame:
    """(key, matches): mentions of entities (id, aliases, fold) in each text, longest at each
    place, left to right, none overlapping. ``fold`` compares without case. Texts meet
    aliases by the lower-cased first word of the alias; the alias table goes to every task
    while it has at most ``most_aliases`` rows, and beyond it only words travel, not texts."""
    token = r"([a-z0-9_]+|[^a-z0-9_\s])"
    aliases = entities.select(F.col("id").alias("_entity"), F.explode(F.array_distinct("aliases")).alias("alias"), "fold").where("alias is not null and alias <> ''")
    aliases = aliases.withColumn("_head", F.regexp_extract(F.lower("alias"), token, 1))
    own = docs.select(key, F.col(text).alias("_text"))
    heads = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(token), F.lit(1)))).alias("_head")
    if aliases.count() <= most_aliases:
        hits = own.select("*", heads).join(F.broadcast(aliases), "_head")
    else:
        row = F.xxhash64(key, "_text").alias("_row")
        hits = own.select(row, heads).join(aliases, "_head").drop("_head").distinct().join(own.select("*", row).distinct(), "_row")
    hits = hits.where(F.contains(F.lower("_text"), F.lower("alias")))
    spans = hits.select(key, "_entity", F.explode(literal_spans(F.col("_text"), F.col("alias"), F.col("fold"))).alias("s"))
    grouped = spans.select(key, F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("_entity").alias("id"), F.col("s.text").alias("text")).alias("m")).groupBy(key).agg(F.collect_set("m").alias("m"))
    return grouped.select(key, greedy_spans(F.col("m")).alias("matches"))


class _Memo(dict):
    """A translation table that asks about each character once."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, code: int) -> str:
        self[code] = out = self.of(chr(code))
        return out


_MARKLESS = _Memo(lambda c: "" if unicodedata.category(c) == "Mn" else c)
_SPACED = _Memo(lambda c: "" if c in "'’ʼ`" else c if c.isalnum() or c == "_" else " ")


def _comparison_form(text: str | None) -> str:
    if text is None:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold().translate(_MARKLESS))
    return " ".join(text.casefold().translate(_SPACED).split())


@F.pandas_udf(T.StringType())
def normalize(text: pd.Series) -> pd.Series:
    """The form in which texts are compared: no case, accents, apostrophes or punctuation.
    Spark has no Unicode decomposition, hence the Arrow function."""
    return text.map(_comparison_form)


def comparison_words(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def line_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def word_confidence(words: Column, seen: Column) -> Column:
    """1 or 0 per word: whether another reader saw it; struck words never count."""
    def flags(s: Column) -> Column:
        return F.transform(words, lambda w: F.when(F.startswith(w, F.lit("~~")), F.lit(0)).otherwise(F.array_contains(s, w).cast("int")))
    return F.get(F.transform(F.array(seen), flags), 0)  # ``seen`` is an element, so that it is computed once, not for every word


def apply_self_report(words: Column, doubted: Column) -> Column:
    """Words (word, conf) re-flagged by the reader's own doubts (words from 1)."""
    return F.transform(words, lambda w, i: F.struct(w["word"].alias("word"), F.when(
        F.array_contains(doubted, i + 1) | F.startswith(w["word"], F.lit("~~")), F.lit(0.0)).otherwise(F.lit(1.0)).alias("conf")))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def relevant_sentences(text: Column, needles: list[str], limit: int = 3, cap: int = QUOTE_CAP) -> Column:
    """Sentences that hold a needle, without case, else the opening ones; each is cut to
    ``cap`` characters, as a quotation is."""
    own = sentences(text)

    def held(s):
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(F.lower(s), F.lit(n.lower()))
        return hit
    hits = F.filter(own, held)
    pool = F.when(F.size(hits) > 0, hits).otherwise(own)
    return F.transform(F.slice(pool, 1, limit), lambda s: F.substring(s, 1, cap))


def search(items: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows whose joined text holds the query, without case."""
    return items.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def known_as(people: DataFrame, name: str) -> DataFrame:
    """One row at most: the first person whose name or alias is the trimmed name, without case."""
    n = name.strip().lower()
    hit = (F.lower(F.trim("name")) == n) | F.coalesce(F.exists("aliases", lambda a: F.lower(F.trim(a)) == n), F.lit(False))
    return people.where(hit).orderBy("pos").limit(1)


def emails(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+)"), F.lit(1))


def table_markers(table: DataFrame, common: tuple[str, ...] = (), generic: tuple[str, ...] = ()) -> DataFrame:
    """(marker): ids, names, name parts, aliases and e-mail addresses that identify."""
    parts = F.filter(F.regexp_extract_all("name", F.lit("([A-Z][A-Za-z]+)"), F.lit(1)), lambda t: (F.length(t) > 2) & ~F.lower(t).isin(*(common or ("",))))
    own = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: (F.length(F.trim(a)) > 2) & ~F.lower(F.trim(a)).isin(*(generic or ("",))))
    every = F.concat(F.array(F.trim("id"), F.trim("name"), F.lower(F.trim("email"))), parts, F.transform(own, lambda a: F.trim(a)))
    return table.select(F.explode(every).alias("marker")).where("marker is not null and marker <> ''").distinct()


def date_markers(people: DataFrame) -> DataFrame:
    """(marker): attested dates of birth and death; a bare year identifies nobody."""
    return people.select(F.explode(F.array("dob.date", "dod.date")).alias("marker")).where(F.length("marker") > 6).distinct()


def geo_markers(places: DataFrame) -> DataFrame:
    """(marker): coordinates of four decimals or more; coarser ones collide with other numbers."""
    return places.select(F.explode(F.array(F.col("lat").cast("string"), F.col("lng").cast("string"))).alias("marker")).where(F.rlike("marker", F.lit(r"\.\d{4,}$"))).distinct()


def offenders(texts: DataFrame, key: str, text: str, markers: DataFrame) -> DataFrame:
    """(key, marker) of markers that a text holds: addresses without case, others as they are
    and at word boundaries. Markers meet texts on a token of theirs, not all against all: on the one that
    the fewest texts hold, as all tokens of a marker, which ends at word boundaries, are tokens of the text."""
    def tokens(c):
        return F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)))).alias("_k")
    own = texts.select(key, F.col(text).alias("_t"), tokens(text))
    plain = markers.where(~F.contains("marker", F.lit("@"))).select("marker").distinct()
    held = own.groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    led = plain.select("marker", tokens("marker")).join(held, "_k", "left").groupBy("marker").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_k")).alias("k"))
    led = led.where("k.n > 0").select("marker", "k._k")  # a marker with a token of no text is in none
    both = own.join(led, "_k").where(F.rlike("_t", F.concat(F.lit(r"\b"), escape(F.col("marker")), F.lit(r"\b"))))
    # an address can stand inside a longer token, so it is sought in texts with an @ as a whole
    at = texts.where(F.contains(text, F.lit("@"))).select(key, F.lower(text).alias("_t"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"@([a-z0-9]+)"), F.lit(1)))).alias("_k"))
    addressed = at.join(markers.where(F.contains("marker", F.lit("@"))).withColumn("_k", F.regexp_extract(F.lower("marker"), r"@([a-z0-9]+)", 1)), "_k").where(
        F.contains("_t", F.lower("marker")))
    return both.select(key, "marker").unionByName(addressed.select(key, "marker")).distinct()


def attested_claims(people: DataFrame) -> DataFrame:
    """(id, name, kind, claim): links that a person's own text states."""
    text = F.concat_ws(" ", F.coalesce("relation", F.lit("")), F.coalesce("bio", F.lit("")))
    claims = F.flatten(F.array(*[_claims(text, p, k) for p, k in ATTESTED]))
    return people.select("id", "name", F.explode(claims).alias("c")).select("id", "name", "c.kind", F.lower(F.trim(F.regexp_replace(F.trim("c.claim"), r"^\.+|\.+$", ""))).alias("claim")).where("claim <> ''")


def _claims(text: Column, pattern: str, kind: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("claim")))


def attested_gaps(people: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, claim, n, targets): stated links of which the graph has none, in either direction, with
    the people that a claim may mean and their number. These hang on the claim alone, so they are
    counted and listed once a claim; rows grow with people, claims and edges, not with the people of one name.
    Who needs no ``targets`` leaves them out, and they are not made."""
    people, name = people.where("id is not null"), F.lower("name")
    forms = F.array_distinct(F.concat(F.array(name), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a)), F.split(name, " "),
                                      F.transform(F.sequence(F.lit(1), F.size(F.split(name, " "))), lambda n: F.array_join(F.slice(F.split(name, " "), F.lit(1), n), " "))))
    candidates = people.select(F.col("id").alias("target"), F.explode(forms).alias("claim"))
    said = attested_claims(people).select("id", "kind", "claim").distinct()
    meant = candidates.join(said.select("claim").distinct(), "claim", "left_semi").distinct().groupBy("claim").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_set("target")).alias("targets"))
    own = said.join(candidates.select(F.col("target").alias("id"), "claim"), ["id", "claim"], "left_anti")
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("target"), "kind").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("target"), "kind"))
    linked = own.join(both, ["id", "kind"]).join(candidates, ["target", "claim"], "left_semi").select("id", "kind", "claim").distinct()
    return own.join(linked, ["id", "kind", "claim"], "left_anti").join(meant, "claim").select("id", "kind", "claim", "n", "targets")


def slug(text: Column, cap: int = 40) -> Column:
    """An id from a name: lower case, dashes, at most ``cap`` characters, never empty."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(plain, 1, cap), "-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit("new")).otherwise(cut)


def unique_ids(df: DataFrame, name: str, order: str, taken: DataFrame) -> DataFrame:
    """``df`` with new_id: the slug, with -2, -3 and so on where it is taken."""
    base = df.withColumn("_slug", slug(F.col(name)))
    used = taken.select(F.regexp_replace("id", r"-\d+$", "").alias("_slug"), F.coalesce(F.regexp_extract("id", r"-(\d+)$", 1).try_cast("int"), F.lit(1)).alias("n"))
    used = used.groupBy("_slug").agg(F.max("n").alias("_used"))
    rank = F.row_number().over(Window.partitionBy("_slug").orderBy(order))
    n = rank + F.coalesce("_used", F.lit(0))
    return base.join(used, "_slug", "left").withColumn("new_id", F.when(n == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", n.cast("string")))).drop("_slug", "_used")


def initials(name: Column) -> Column:
    """First letters of the first two words that begin with a letter, or ?."""
    parts = F.slice(F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: F.rlike(w, F.lit(r"^\p{L}"))), 1, 2)
    return F.when(F.size(parts) == 0, F.lit("?")).otherwise(F.upper(F.array_join(F.transform(parts, lambda w: F.substring(w, 1, 1)), "")))


def hue(id_: Column, own: Column, hues: int = 6) -> Column:
    """The colour set for a person, else the sum of the id's code points modulo ``hues``."""
    total = F.aggregate(F.transform(F.filter(F.split(id_, ""), lambda c: c != ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(F.nullif(own, F.lit("")), (total % hues).cast("string"))


def preview(text: Column, cap: int = 140, least: int = 60) -> Column:
    """A text cut at the last space before ``cap`` characters, if that is not too early."""
    head = F.substring(text, 1, cap)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    kept = F.when((F.instr(head, " ") > 0) & (space > least), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(kept, F.lit("…")))


def joined(df: DataFrame, group: list[str], order: str, part: Column, separator: str) -> DataFrame:
    """(group, text): the parts of each group in order."""
    parts = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))).alias("x"))
    return parts.select(*group, F.array_join(F.transform("x", lambda x: x["p"]), separator).alias("text"))


def corrected_text(lines: DataFrame, edits: DataFrame, page: str, index: str, text: str) -> DataFrame:
    """(page, text): the lines of each page, edited ones as edited."""
    best = lines.join(edits.select(page, index, F.col(text).alias("_edit")), [page, index], "left")
    return joined(best, [page], index, F.coalesce("_edit", text), "\n")


def strip_kin_matches(extractions: Column) -> Column:
    """A person known only as a relative matches nobody."""
    return F.transform(extractions, lambda x: x.withField("match", F.when(
        (x["kind"] == "person") & F.lower(F.trim(x["name"])).isin(*KIN_TERMS), F.lit(None).cast("string")).otherwise(x["match"])))


def quote_from(text: Column, name: str, cap: int = 200) -> Column:
    """A sentence to quote for a person: the first with all words of the name, else with the
    first name, else the first; longer than 20 characters and no header; ends with a stop."""
    words = [w.lower() for w in name.split()]
    own = F.filter(sentences(text), lambda s: (F.length(s) > 20) & ~F.rlike(s, F.lit(r"^[A-Z0-9 .,:-]+$")))

    def with_all(s):
        hit = F.lit(True)
        for w in words:
            hit = hit & F.contains(F.lower(s), F.lit(w))
        return hit
    pick = F.coalesce(F.try_element_at(F.filter(own, with_all), F.lit(1)), F.try_element_at(F.filter(own, lambda s: F.contains(F.lower(s), F.lit(words[0]))), F.lit(1)),
                      F.try_element_at(own, F.lit(1)))
    cut = F.substring(pick, 1, cap)
    return F.when(F.rlike(cut, F.lit(r"[.!?]$")), cut).otherwise(F.concat(cut, F.lit(".")))


def doc_title(greeting: Column, text: Column, page: Column, cap: int = 48) -> Column:
    line = F.try_element_at(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(s) != ""), F.lit(1))
    return F.coalesce(F.nullif(greeting, F.lit("")), F.substring(F.trim(line), 1, cap), page)


def personable(relation: Column) -> Column:
    """A relation without notes in brackets, parentheses as dashes."""
    plain = F.regexp_replace(relation, r"\s*\[[^\]]*\]", "")
    return F.trim(F.regexp_replace(plain, r"\s*\(([^)]*)\)", " – $1"))


def struck_parts(text: Column) -> Column:
    """Parts (kind, text) of a line: ~~struck~~, ~underlined~ and plain."""
    marks = r"(~~[^~]+~~|~[^~]+~)"
    found, between = F.regexp_extract_all(text, F.lit(marks), F.lit(1)), F.split(text, marks, -1)

    def part(kind, t):
        return F.struct(kind.alias("kind"), t.alias("text"))
    pairs = F.zip_with(between, found, lambda b, v: F.array(part(F.lit("plain"), b), part(
        F.when(F.startswith(v, F.lit("~~")), F.lit("struck")).otherwise(F.lit("underlined")), F.regexp_replace(v, "^~+|~+$", ""))))
    return F.filter(F.flatten(pairs), lambda p: F.coalesce(p["text"] != "", F.lit(False)))


def markdown_blocks(lines: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """Lines with block_no and whether the block is a table: blank lines part blocks, and so
    does the change between table rows and prose."""
    w = Window.partitionBy(doc).orderBy(pos)
    own = lines.withColumns({"is_table": F.rlike(F.trim(text), F.lit(r"^\|.*\|$")), "blank": F.trim(text) == ""})
    opens = F.coalesce(F.lag("blank").over(w), F.lit(True)) | (F.lag("is_table").over(w) != F.col("is_table"))
    return own.withColumn("_o", (opens & ~F.col("blank")).cast("int")).withColumn("block_no", F.sum("_o").over(w)).where("not blank").drop("_o", "blank")


def holds_any(text: Column, words: tuple[str, ...], exempt: tuple[str, ...] = ()) -> Column:
    """Whether the text holds one of the words, once exempt phrases are taken out."""
    plain = F.lower(text)
    for e in exempt:
        plain = F.replace(plain, F.lit(e.lower()), F.lit(" "))
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(plain, w))
