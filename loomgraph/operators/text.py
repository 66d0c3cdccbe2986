"""Corpus operators: chunks, spans, paragraphs, windows."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.names import collapse
from loomgraph.operators import places

#: marks after which a chunk may end, best first
BREAKS = ("\n\n", "\n", ". ", ", ")
#: Unicode's spaces (Zs), which a second engine trims; between paragraphs stand lines of white space as its \s has it
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BLANK_LINE = r"\n[\t\n\f\r ]*\n"


def break_ends(text: str) -> list[np.ndarray]:
    """For each kind of mark the places right after one, ascending."""
    return [np.array([m.start() + len(k) for m in re.finditer(f"(?={re.escape(k)})", text)], np.int64) for k in BREAKS]


def chunk_bounds(text: str, size: int = 8000, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, end) of overlapping chunks.

    Of the places right after a mark that begins within the chunk's span but not at its start, a chunk ends at the last
    one of the best kind that has any; without one it takes the whole span.  The next chunk starts `overlap` before that
    end, and at least one character on, so that a break near the start doesn't hold it up.
    """
    ends, bounds = break_ends(text), []
    nexts = 0
    while nexts < len(text) and (not bounds or bounds[-1][1] < len(text)):
        span = (nexts, min(nexts + size, len(text)))
        if span[1] < len(text):
            # a mark must lie in the span as a whole
            last = [int(e[np.searchsorted(e, span[1], "right") - 1]) if len(e) and e[0] <= span[1] else 0 for e in ends]
            fit = [e for e, k in zip(last, BREAKS, strict=True) if e - len(k) > span[0]]
            span = (span[0], fit[0] if fit else span[1])
        bounds.append(span)
        nexts = max(span[1] - overlap, span[0] + 1)
    return bounds


def chunks(documents: DataFrame, size: int = 8000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk, chunk_id, start, end, text) of whole texts, each chunk trimmed; chunk_id is `<doc_id>_chunk_<n>`.
    An empty or null text has no chunk."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def bounds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in chunk_bounds(t or "", size, overlap)])

    cut = documents.select("doc_id", "text", F.posexplode(bounds("text")).alias("chunk", "b"))
    return cut.select(
        "doc_id", "chunk", F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("chunk_id"),
        F.col("b.start").alias("start"), F.col("b.end").alias("end"),
        F.regexp_replace(F.expr("substring(text, b.start + 1, b.end - b.start)"), r"(?U)^\s+|\s+$", "").alias("text"))


def contained_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the normalised span stands in the normalised text; an empty span stands nowhere.

    Texts are read in Arrow batches for the first characters of spans, wherever they stand (places.candidates); only texts
    that have them are fetched and tested.  No text meets a span by scanning.
    """
    texts = documents.select("doc_id", collapse(F.col("text")).alias("text"))
    asked = spans.select("item_id", collapse(F.col("text")).alias("span"))
    pairs = places.candidates(texts, asked).distinct()
    return texts.join(pairs, "doc_id").where(F.contains("text", "span")).select("item_id", "doc_id").distinct()


def pieces(text: Column, mark: str, least: int) -> Column:
    """The pieces of a text between marks, without the spaces around them, that are longer than `least` characters."""
    # F.trim itself would take the place that transform passes for the characters to trim
    return F.filter(F.transform(F.split(text, mark), lambda p: F.trim(p, F.lit(SPACES))), lambda p: F.length(p) > least)


def paragraphs(documents: DataFrame, mark: str = BLANK_LINE, least: int = 50) -> DataFrame:
    """(doc_id, paragraph, text) of pieces between blank lines longer than `least` characters; numbers count kept ones
    from 0."""
    return documents.select("doc_id", F.posexplode(pieces(F.col("text"), mark, least)).alias("paragraph", "text"))


def _merged(hits: str, around: int) -> Column:
    """An array of line numbers, ascending, folded into windows about them (end exclusive), none of which touch."""

    def merge(done, i):
        start, end = F.greatest(i - around, F.lit(0)), i + around + 1
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
        return F.when((F.size(done) > 0) & (last["end"] >= start), joined).otherwise(F.concat(done, F.array(F.struct(start.alias("start"), end.alias("end")))))

    return F.aggregate(hits, F.array().cast("array<struct<start:int,end:int>>"), merge)


def mention_windows(documents: DataFrame, needle: Column, around: int = 15) -> DataFrame:
    """(doc_id, start, end) line windows about lines that hold the needle; touching windows merge (end exclusive).

    Within a document only (a row at a time), so nothing is shuffled: hit lines are folded in an array.
    """
    lines = F.split("text", "\n")
    rows = documents.select("doc_id", F.transform(lines, lambda x, i: F.when(F.contains(F.lower(x), needle), i)).alias("hits"), F.size(lines).alias("n"))
    hits = rows.select("doc_id", "n", F.filter("hits", lambda x: x.isNotNull()).alias("hits")).where(F.size("hits") > 0)
    folded = hits.select("doc_id", "n", F.explode(_merged("hits", around)).alias("w"))
    return folded.select("doc_id", F.col("w.start").alias("start"), F.least("w.end", "n").alias("end"))


def within_budget(rows: DataFrame, group: str, order: str, size: str, budget: int, block: int = 1000) -> DataFrame:
    """Rows of each group in the order of an integer column while their sizes, none negative, add up to the budget at most.

    A group may hold a large share of all rows, so blocks of `block` values of the order are summed first; a block that
    starts beyond the budget is dropped before any row is sorted, and the others are added up side by side.
    """
    place = F.floor(F.col(order) / block)
    sums = rows.groupBy(group, place.alias("block")).agg(F.sum(size).alias("total"))
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before")).where(F.col("before") <= budget)
    run = Window.partitionBy(group, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("block", place).join(sums, [group, "block"])
    return near.withColumn("running", F.col("before") + F.sum(size).over(run)).where(F.col("running") <= budget).drop("block", "before")


# fixed values: where a line ends, and what stands around the pieces of a passage
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WINDOW_HEAD, WINDOW_HEAD_END, CUT = "\n--- corpus lines ", " ---\n", "\n... [truncated] ..."
SEED_HEAD, SPAN_HEAD, CLAIM_HEAD = "--- source.evidence_span (Phase 1 anchor) ---\n", "--- source.evidence_span ---\n", "\n--- treats edge evidence_span ---\n"
NO_SPAN, NO_CLAIM = "<no anchor>", "<no treats span>"


def paragraph_windows(documents: DataFrame, size: int = 1, stride: int = 1, mark: str = BLANK_LINE, least: int = 50) -> DataFrame:
    """(doc_id, first, text) of every `size` paragraphs of a document that follow each other, a window every `stride`
    paragraphs, joined by blank lines.  Within a document's own row; a document with fewer paragraphs has no window."""
    rows = documents.select("doc_id", pieces(F.col("text"), mark, least).alias("parts")).where(F.size("parts") >= size)
    starts = F.sequence(F.lit(0), F.size("parts") - size, F.lit(stride))
    cut = rows.select("doc_id", "parts", F.explode(starts).alias("first"))
    return cut.select("doc_id", "first", F.array_join(F.slice("parts", F.col("first") + 1, F.lit(size)), "\n\n").alias("text"))


def passages(documents: DataFrame, needles: DataFrame, around: int = 15, budget: int | None = 60_000, least_tail: int = 200, mark: str | None = None) -> DataFrame:
    """(item_id, doc_id, windows, passage): of each document the lines about those that hold a needle of an item, case and
    outer space apart, each window under a heading with its line numbers, `budget` characters at most (None: all).

    needles has (item_id, needle), several an item; those under three characters are none.  Documents are found by the first
    characters of needles (places.candidates), so few documents are held against needles that they don't have.  Lines end
    as str.splitlines has it, or stand between marks.  Windows merge where they touch.  The window that passes the budget is
    cut, with a mark, if more than `least_tail` characters are left for it, and ends the passage; `windows` counts all.
    """
    asked = needles.select("item_id", F.trim(places.lower(F.col("needle")), F.lit(SPACES)).alias("needle")).where(F.length("needle") >= 3).distinct()
    pairs = places.candidates(documents.select("doc_id", "text"), asked.withColumnRenamed("needle", "span")).withColumnRenamed("span", "needle")
    wanted = pairs.groupBy("item_id", "doc_id").agg(F.collect_set("needle").alias("needles"))
    split = F.split("text", mark or LINE_ENDS)
    lines = split if mark else F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    rows = documents.select("doc_id", lines.alias("lines")).join(wanted, "doc_id").withColumn("n", F.size("lines"))
    hits = F.transform("lines", lambda x, i: F.when(F.exists("needles", lambda s: F.contains(places.lower(x), s)), i))
    rows = rows.withColumn("hits", F.filter(hits, lambda x: x.isNotNull())).where(F.size("hits") > 0)
    rows = rows.withColumn("merged", F.transform(_merged("hits", around), lambda w: F.struct(w["start"].alias("start"), F.least(w["end"], "n").alias("end"))))

    def block(w):
        body = F.array_join(F.slice("lines", w["start"] + 1, w["end"] - w["start"]), "\n")
        return F.concat(F.lit(WINDOW_HEAD), (w["start"] + 1).cast("string"), F.lit("-"), w["end"].cast("string"), F.lit(WINDOW_HEAD_END), body)

    begin = F.struct(F.lit(0).alias("total"), F.array().cast("array<string>").alias("parts"), F.lit(False).alias("full"))

    def add(done, text):
        left = F.lit(budget) - done["total"]
        over = F.length(text) > left
        tail = F.when(left > least_tail, F.array(F.concat(F.substring(text, F.lit(1), left), F.lit(CUT)))).otherwise(F.array().cast("array<string>"))
        return F.when(done["full"], done).otherwise(F.struct(
            (done["total"] + F.length(text)).alias("total"), F.concat(done["parts"], F.when(over, tail).otherwise(F.array(text))).alias("parts"), over.alias("full")))

    blocks = F.transform("merged", block)
    outer = r"[ \t\n\r]" if mark else r"\s"
    found = blocks if budget is None else F.aggregate(blocks, begin, add)["parts"]
    return rows.select("item_id", "doc_id", F.size("merged").alias("windows"), F.regexp_replace(F.array_join(found, "\n"), rf"(?U)^{outer}+|{outer}+\z", "").alias("passage"))


def with_seed(passage: Column, seed: Column, other: Column) -> Column:
    """A passage behind the span that a source was known by; where there is neither, what is known of the claim besides."""
    trimmed = F.trim(F.coalesce(seed, F.lit("")), F.lit(SPACES))
    whole = F.concat(F.when(trimmed != "", F.concat(F.lit(SEED_HEAD), trimmed, F.lit("\n\n"))).otherwise(""), F.coalesce(passage, F.lit("")))
    bare = F.concat(F.lit(SPAN_HEAD), F.coalesce(F.nullif(seed, F.lit("")), F.lit(NO_SPAN)),
                    F.lit(CLAIM_HEAD), F.coalesce(F.nullif(other, F.lit("")), F.lit(NO_CLAIM)))
    return F.when(F.trim(whole) == "", bare).otherwise(whole)
