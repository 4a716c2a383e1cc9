"""Quality classifier, HTML extraction, the registry and the pipeline."""

import random
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidewrack.llm import html_text, quality, weak

DATA = "/root/testdata/sf0.01"


def test_estimate_finds_the_bad_labeler():
    rng = random.Random(1)
    votes = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.7
        votes[tuple((1 if truth else -1) * (1 if rng.random() < p else -1) for p in (0.95, 0.9, 0.6))] += 1
    prior, like, post = weak.estimate(sorted(votes.items()), [weak.EITHER_WAY] * 3)
    assert abs(prior - 0.7) < 0.05 and like[1][0][2] > like[1][1][2] > like[1][2][2] and post[1, 1, 1] > 0.95 and post[-1, -1, -1] < 0.05
    assert weak.estimate([], [weak.EITHER_WAY])[0] == 0.5


def test_quality_on_labelled_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = quality.fit(train)
    rows = quality.score(held, model).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    right = [(r.quality_score >= 0.5) == (r.quality == 1) for r in rows]
    assert sum(right) / len(right) > 0.95
    clean = [r.quality_score >= 0.5 for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(clean) / len(clean) > 0.98


def test_quality_edges(spark, awkward):
    kept = quality.keep(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} >= {1} and not {2, 3, 4} & {r.doc_id for r in kept.collect()}
    model = quality.fit(awkward)
    scored = quality.score(awkward, model)
    assert scored.columns[-2:] == ["quality_score_", "quality_votes"] and scored.count() == awkward.count()
    assert quality.keep(awkward.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header><h2>Site name of the day</h2></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About the site</a></ul></nav>
<div class="cookie-notice">We use cookies to make the site better for you and for all of us, as the law of the land has it.</div>
<article><h1>The &amp; title</h1><p>It was&nbsp;the   best of times,<b> it was</b>
 the worst of times.<p>Short.<div class="advert">Buy the best of all the things that are on offer in the shop of the town today.</div>
<form><p>Sign up for the letter of the week</p><input></form><ul><li>One of the things</ul><p>caf&#233; &lt;tag&gt; 1 &lt 2</p>
<section id="comments"><p>I think that this is the best article that I have read on the site in the last year.</p></section></article>
<aside><p>More of the same that you may like to read, from the archive of the paper and its readers.</p></aside>
<footer><p>&copy; 2020 All of the rights are with the owner of the site and with no one else.</p></footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The & title\nIt was the best of times, it was the worst of times.\nShort.\nOne of the things\ncafé <tag> 1 < 2"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == html_text.main_text("<div class='a") == ""


def test_blocks_without_article_element():
    good = "It is the case that the men of the town went to the sea in the morning and that they did not come back from it. " * 3
    bad = "foo bar baz qux " * 20
    page = f"<div><p>Intro line</p><p>{good}</p><p>Short in between</p><p>{good}</p><p>{bad}</p><p>Late short</p></div><div><a href=x>one</a> <a href=y>two three</a></div>"
    assert html_text.main_text(page).split("\n") == [good.strip(), "Short in between", good.strip()]


PROSE = "It is the case that the men of the town went to the sea in the morning and that they did not come back from it"


@pytest.mark.parametrize("page, want", [
    (f"<body><form action=x><nav><a href=y>menu</a></nav><article><h1>Title</h1><p>{PROSE}.</p></article><input name=z></form></body>", ["Title", PROSE + "."]),
    (f"<body><form action=x><div><p>{PROSE}, and so on, {PROSE}.</p></div></form></body>", [f"{PROSE}, and so on, {PROSE}."]),
    (f"<article><div class='article-header'><h1>Title</h1></div><p>{PROSE}.</p><form><p>Write to us and say what you have seen of it.</p></form></article>", ["Title", PROSE + "."]),
    (f"<article><p>{PROSE}.</p><svg><path d='x'><p>After the drawing</p><p>{PROSE}!</p></article>", [PROSE + ".", "After the drawing", PROSE + "!"]),
    (f"<article><p>{PROSE}.</p><svg><g><svg></svg></g></svg><noscript>{PROSE}</noscript><p>Last</p></article>", [PROSE + ".", "Last"]),
    (f"<article><p>One line<br>and the same block<br/>{PROSE}</p></article>", [f"One line and the same block {PROSE}"]),
    ("<article><p>xyzzy plugh qwe</p><p>" + "zork " * 60 + "</p></article>", ["xyzzy plugh qwe", ("zork " * 60).strip()]),
    (f"<article><p>{PROSE}.</p><p><a href=a>read this</a> <a href=b>and that one too</a></p></article>", [PROSE + "."]),
    (f"<div class='content with-sidebar'><article><p>{PROSE}.</p></article></div>", [PROSE + "."]),
    (f"<div class=page><article><p>{PROSE}.</p></article><div id=comments>" + f"<article><p>{PROSE}? said the reader, and {PROSE}.</p></article>" * 5 + "</div></div>", [PROSE + "."]),
    (f"<div id=x class='post related-wide'><p>{PROSE}, and {PROSE}, and {PROSE}.</p></div>", [f"{PROSE}, and {PROSE}, and {PROSE}."]),
    (f"<div class=header><p>{PROSE}</p></div><article><p>{PROSE}.</p></article>", [PROSE + "."]),
])
def test_main_text_of_awkward_pages(page, want):
    assert html_text.main_text(page).split("\n") == want


class Walk(HTMLParser):
    """Text of the article element outside the parts that are named, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data(" ")
        elif tag not in ("img", "hr"):
            self.open.append((tag, dict(attrs).get("class", "")))
            self.edge(tag)

    def handle_endtag(self, tag):
        while self.open and self.open.pop()[0] != tag:
            pass
        self.edge(tag)

    def edge(self, tag):
        if tag not in ("b", "i", "a", "span"):
            self.blocks.append("")

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "article" in tags and not set(tags) & {"script", "style", "aside", "nav", "form"} and not any(c in ("share-box", "ad", "comments") for _, c in self.open):
            self.blocks[-1] += data


def test_main_text_of_generated_pages():
    rng = random.Random(12)
    words = "the of and to a in is that it was for on as with his they at be this from town harbour lantern Sigel caf&eacute; 1 &lt; 2 &amp; naïve".split()

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", " <b>x</b>", "<br>", " <i>of</i>", "<!-- c -->"]) for _ in range(n))

    def part():
        kind = rng.randrange(9)
        if kind < 4:
            return f"<p>{prose(rng.randrange(1, 120))}</p>"
        return (f"<h2>{prose(4)}</h2>", f"<ul><li>{prose(6)}</li><li>{prose(30)}</li></ul>", f"<aside><p>{prose(60)}</p></aside>", "<script>var a = '</p>' + 1 < 2;</script><div class='share-box'>Share the page</div>",
                f"<blockquote>{prose(25)}</blockquote><table><tr><td>{prose(9)}</td><td>{prose(3)}</td></tr></table>")[kind - 4]
    for _ in range(150):
        body = "".join(part() for _ in range(rng.randrange(1, 12)))
        page = (f"<html><head><title>{prose(5)}</title><style>p {{}}</style></head><body><header><p>{prose(40)}</p></header><nav><ul><li><a href=x>{prose(3)}</a></li></ul></nav><div class=ad>{prose(80)}</div>"
                f"<article><div class='article-header'><h1>{prose(6)}</h1></div>{body}</article><div class='comments'><p>{prose(90)}</p></div><footer>{prose(70)}</footer></body></html>")
        walk = Walk()
        walk.feed(page)
        assert html_text.main_text(page).split("\n") == [t for t in (" ".join(b.split()) for b in walk.blocks) if t]


def test_extract_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (3, "u", "", "x"), (1, "u", PAGE, "x"), (4, "u", "<p>" + "the of and " * 200_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("a.b", F.lit(1))
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "a.b", "text_"] and got.count() == 5
    assert [len(r.text_) for r in got.where("page_id in (2, 3)").collect()] == [0, 0] and len(got.where("page_id = 4").first().text_) > 1_000_000
    assert html_text.extract(df.limit(0)).count() == 0


def test_registry():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert {f"op{i}_" for i in range(1, 11)} == {n[:n.index("_") + 1] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_native import leaked
    from tests.llm.test_sets import brute
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tests = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name.replace(" ", "_"))
        stage(spark, before, DATA).write.parquet(out)
        after = spark.read.parquet(out)
        seen[name] = (before, after)
        before = after
    for name, (_, after) in list(seen.items())[:-1]:
        assert sorted(after.columns) == sorted(docs.columns), name
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    first = seen["quality classifier"][1].join(labels, "doc_id").groupBy("quality").count().collect()
    good = labels.where("quality = 1").count()
    assert {r.quality: r["count"] for r in first}[1] >= 0.98 * good and {r.quality: r["count"] for r in first}.get(0, 0) <= 10
    given, left = seen["n-gram Jaccard join"]
    want = {c for _, c in brute([(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()], 5, 80).values()}
    assert {r.doc_id for r in left.collect()} == want
    given, left = seen["benchmark decontamination"]
    gone = {r.doc_id: r.text for r in given.collect() if r.doc_id not in {x.doc_id for x in left.select("doc_id").collect()}}
    assert gone and all(any(leaked(t, q) for q in tests) for t in gone.values())
    given, left = seen["mixing sources to target weights"]
    words = lambda df: df.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert abs(words(left) - 1.5 * words(given)) < 0.01 * words(given)
    given, left = seen["sharding"]
    assert left.count() == given.count() and left.select("shard").distinct().count() == 24
    assert left.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gap")).where("gap <> 0").count() == 0
