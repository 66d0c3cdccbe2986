"""Checks of a reviewer's answer that need no judge: fields, ranges, citations, loops and steps, as columns and one anti-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import tiers as T

# fixed values: fields that an answer must have, and those of them that are numbers from 0 to 1
REQUIRED = ("verdict", "biological_plausibility", "evidence_coherence", "key_evidence", "concerns", "rationale", "requires_human_review")
SCORES = ("biological_plausibility", "evidence_coherence")
#: what a piece of evidence cites: field and kind
CITED = (("compound", "compound"), ("target", "target"), ("reached_disease", "disease"))


def norm(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)), F.lit(""))


def missing_fields() -> Column:
    """Names of required fields that are null, in order."""
    return F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())


def score_fails(field: str) -> Column:
    """Why a score is none: no number, or outside 0 to 1; null if it is sound."""
    said = F.coalesce(F.col(field), F.lit("None"))
    number = F.col(field).try_cast("double")
    broken = number.isNull()
    outside = ~((number >= 0) & (number <= 1)) | F.isnan(number)
    return F.when(broken, F.concat(F.lit(f"{field}="), said, F.lit(" not a number"))).when(outside, F.concat(F.lit(f"{field}="), said, F.lit(" out of [0,1]")))


def claims_loop() -> Column:
    """Whether a rationale says that the loop closes."""
    text = F.lower(F.coalesce("rationale", F.lit("")))
    return F.contains(text, F.lit("loop closes")) | F.contains(text, F.lit("loop-closure")) | (
        F.contains(text, F.lit("loop closed")) & ~F.contains(text, F.lit("no loop")))


def misstated() -> Column:
    """Whether a step or an agreement is stated that isn't one; a step of 0 and no agreement are what they are without an
    opinion, and a verdict that lacks on either side says nothing."""
    known = (F.coalesce("pass1", F.lit("")) != "") & (F.coalesce("verdict", F.lit("")) != "")
    step = T.verdict_delta(F.col("verdict"), F.col("pass1"))
    wrong_step = F.coalesce((F.col("verdict_delta") != step) & (F.col("verdict_delta") != 0), F.lit(False))
    wrong_word = F.coalesce(F.col("agrees_with_pass1"), F.lit(False)) & (step != 0)
    return known & (wrong_step | wrong_word)


def unknown_citations(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """(case_id, unknown): how often a case's evidence cites what the case wasn't shown, by (case, kind, name) in lower case and trimmed;
    cases without a miss have no row.  Empty names cite nothing."""
    each = F.flatten(F.transform("key_evidence", lambda e: F.array(*[F.struct(F.lit(kind).alias("kind"), norm(e[field]).alias("name")) for field, kind in CITED])))
    cited = answers.where("has_payload").select("case_id", F.explode(each).alias("c")).select("case_id", "c.kind", "c.name").where("name <> ''")
    known = shown.select("case_id", "kind", norm(F.col("name")).alias("name")).distinct()
    return cited.join(known, ["case_id", "kind", "name"], "left_anti").groupBy("case_id").agg(F.count("*").alias("unknown"))


def checked(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """(case_id, schema_ok, missing, ranges_ok, range_fails, citations_ok, unknown, loop_ok, delta_ok), a row of each answer.

    answers holds case_id, pass1, paths_loop_closed, has_payload, verdict, biological_plausibility and evidence_coherence (text), key_evidence
    (array of compound, target, reached_disease), concerns (array), rationale, requires_human_review, verdict_delta, agrees_with_pass1;
    shown holds (case_id, kind, name).  A null field is a missing one.  Without a payload there is nothing to hold citations
    against, and they pass.
    """
    fails = F.filter(F.array(*[score_fails(c) for c in SCORES]), lambda x: x.isNotNull())
    rows = answers.join(unknown_citations(answers, shown), "case_id", "left").fillna(0, ["unknown"])
    return rows.select(
        "case_id", (F.size(missing_fields()) == 0).alias("schema_ok"), F.array_join(missing_fields(), ",").alias("missing"), (F.size(fails) == 0).alias("ranges_ok"),
        F.array_join(fails, "; ").alias("range_fails"), (F.col("unknown") == 0).alias("citations_ok"), "unknown",
        (~(claims_loop() & (F.coalesce("paths_loop_closed", F.lit(0)) == 0))).alias("loop_ok"), (~misstated()).alias("delta_ok"))
