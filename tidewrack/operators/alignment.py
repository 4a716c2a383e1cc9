"""Lines of a transcription and lines found on the page: who belongs to whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.text import MATCH_THRESHOLD, _comparison_form, line_words


def associate_lines(lines: DataFrame, boxes: DataFrame, page: str, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """(page, index, text, rec_text, y, box_source): transcribed lines (page, index, text) with
    the detections (page, text, y) that show them.

    From the top of the page, each detection claims the free line it overlaps most, the
    first of equals, from ``threshold`` on. What is left is matched by rank: the k-th line
    without box with the k-th unclaimed detection. The claims depend on one another, so a
    page is one group of an Arrow function; pages are independent and small.
    """
    kind = dict(lines.dtypes)[page]
    schema = f"{page} {kind}, index int, text string, rec_text string, y double, box_source string"

    def claim(key, a, b):
        import pandas as pd
        a, b = a.sort_values("index"), b.sort_values(["y", "text"], kind="stable")
        words = [set(_comparison_form(x).split()) for x in a["text"]]
        free, used, rows = dict.fromkeys(range(len(a))), set(), []
        holders: dict[str, set[int]] = {}  # lines by word: only lines that share a word can be claimed
        for i, w in enumerate(words):
            for x in w:
                holders.setdefault(x, set()).add(i)
        index, texts = a["index"].tolist(), a["text"].tolist()
        seen = list(zip(b["text"].tolist(), b["y"].tolist()))
        for j, (text, y) in enumerate(seen):
            own = set(_comparison_form(text).split())
            best, at = 0.0, -1
            for i in sorted(set().union(*(holders.get(x, ()) for x in own))):
                if i in free:
                    score = len(own & words[i]) / len(own | words[i])
                    if score > best:
                        best, at = score, i
            if at >= 0 and best >= threshold:
                del free[at]
                used.add(j)
                rows.append((index[at], texts[at], text, y, "content"))
        rest = [s for j, s in enumerate(seen) if j not in used]
        rows += [(index[i], texts[i], text, y, "positional") for i, (text, y) in zip(free, rest)]
        rows.sort()
        out = pd.DataFrame(rows, columns=["index", "text", "rec_text", "y", "box_source"])
        out.insert(0, page, key[0])
        return out
    return lines.select(page, "index", "text").groupBy(page).cogroup(boxes.select(page, "text", "y").groupBy(page)).applyInPandas(claim, schema)


def build_layout(lines: DataFrame, matches: DataFrame, told_boxes: DataFrame, doubts: DataFrame, page: str = "page") -> DataFrame:
    """(page, index, text, box_y, box_source, words): each line anchored by the reader's own
    box, else by content, else by position, else not at all; words flagged by the reader's
    doubts (line from 1, words from 1) where it gave any, else by what the detector saw."""
    own = lines.join(told_boxes.select(page, "index", F.col("y").alias("told_y")), [page, "index"], "left")
    own = own.join(matches.select(page, "index", "rec_text", F.col("y").alias("match_y"), "box_source"), [page, "index"], "left")
    own = own.join(doubts.select(page, (F.col("line") - 1).alias("index"), F.col("words").alias("doubted")), [page, "index"], "left")
    words = line_words(F.col("text"))
    seen = line_words(F.coalesce("rec_text", F.lit("")))
    conf = F.transform(words, lambda w, i: F.struct(w.alias("word"), F.when(F.startswith(w, F.lit("~~")), 0.0).when(
        F.col("doubted").isNotNull(), 1.0 - F.array_contains("doubted", i + 1).cast("double")).otherwise(F.array_contains(seen, w).cast("double")).alias("conf")))
    return own.select(page, "index", "text", F.coalesce("told_y", "match_y").alias("box_y"), F.when(F.col("told_y").isNotNull(), "vlm").otherwise(
        F.coalesce("box_source", F.lit("none"))).alias("box_source"), conf.alias("words"))


def rotate_box(box: Column, width: Column, height: Column, quarters: Column) -> Column:
    """A box on a page turned clockwise by quarter turns."""
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    q = F.pmod(quarters, F.lit(4))
    return F.when(q == 1, F.array(height - y1, x0, height - y0, x1)).when(q == 2, F.array(width - x1, height - y1, width - x0, height - y0)).when(
        q == 3, F.array(y0, width - x1, y1, width - x0)).otherwise(box)


def desired_quarters(rotation: Column) -> Column:
    return F.pmod(F.round(rotation / 90).cast("int"), F.lit(4))


def scale_box(box: Column, width: Column, height: Column, unit: int = 1000) -> Column:
    """A box in thousandths as pixels."""
    return F.transform(box, lambda v, i: F.round(v * F.when(i % 2 == 0, width).otherwise(height) / unit))


def bounding_box(boxes: Column) -> Column:
    at = lambda i: F.transform(boxes, lambda b: F.get(b, i))
    return F.array(F.array_min(at(0)), F.array_min(at(1)), F.array_max(at(2)), F.array_max(at(3)))


def inside_page(box: Column, width: Column, height: Column) -> Column:
    return (F.get(box, 0) >= 0) & (F.get(box, 1) >= 0) & (F.get(box, 2) <= width) & (F.get(box, 3) <= height) & (F.get(box, 0) < F.get(box, 2)) & (F.get(box, 1) < F.get(box, 3))


def fit_scale(box: Column, view_width: Column, view_height: Column) -> Column:
    """The zoom at which a box fills the view."""
    return F.least(view_width / (F.get(box, 2) - F.get(box, 0)), view_height / (F.get(box, 3) - F.get(box, 1)))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def best_class(scores: Column, labels: Column) -> Column:
    """The label of the highest score, the first of equals."""
    return F.get(labels, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
