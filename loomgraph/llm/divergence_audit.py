"""Operator 12: source divergence audit by two-dimensional group-block tiling."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import common

#: documents of its language that a kept term stands in at least, and ranks of terms that are returned
LEAST_DOCUMENTS, TOP_TERMS = 10, 10
#: groups of a block, terms of a vocabulary chunk, and chunks that one tile goes through
GROUP_BLOCK, CHUNK, CHUNKS_A_TILE = 16, 2_048, 8
#: distinct (group, term) entries that a task counts before it passes them on
ENTRIES = 300_000

#: bytes outside terms become spaces, A-Z become a-z; a byte of a longer UTF-8 sequence stays
TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group, summed within a task; a group without terms sends a null term."""

    def sent(counts, docs):
        for (lang, source), found in counts.items():
            terms = list(found)
            yield pa.record_batch({
                "lang": pa.array([lang] * (len(terms) + 1), pa.string()), "source": pa.array([source] * (len(terms) + 1), pa.string()),
                "term": pa.array([None, *terms], pa.binary()).cast(pa.string()), "n": pa.array([0, *found.values()], pa.int64()),
                "docs": pa.array([0, *map(docs[lang, source].__getitem__, terms)], pa.int64())})

    counts, docs, entries = {}, {}, 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = text.translate(TERM_BYTES).split()
            group = (lang, source)
            if group not in counts:
                counts[group], docs[group] = Counter(), Counter()
            before = len(counts[group])
            counts[group].update(words)
            docs[group].update(set(words))
            entries += len(counts[group]) - before
            if entries > ENTRIES:
                yield from sent(counts, docs)
                counts, docs, entries = {}, {}, 0
    yield from sent(counts, docs)


def _share(n, total, terms):
    """p = 1 + floor(10^9 (n + 2) / (total + 2 terms)) for numpy arrays, digit by digit: exact up to 9 * 10^15 terms in all."""
    whole, rest, found = total + 2 * terms, n + 2, 0
    for _ in range(3):
        found = 1000 * found + 1000 * rest // whole
        rest = 1000 * rest % whole
    return 1 + found


def share(n: Column, total: Column, terms: Column) -> Column:
    """The same as a column."""
    whole, rest, found = total + 2 * terms, n + 2, F.lit(0).cast("long")
    for _ in range(3):
        found = 1000 * found + _div(1000 * rest, whole)
        rest = (1000 * rest) % whole
    return 1 + found


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summed pair submatrix of each tile.

    Rows come by tile and, within it, by chunk; a chunk's rows are the packed counts of all groups of the tile's two
    blocks, so no more than two blocks' counts of one chunk are held.  Sums are of exact integers.
    """
    tile, chunk, held, sums = None, None, [], {}

    def add():
        width = held[0]["width"]
        if not width:
            for a in held:
                for b in held:
                    if a["source"] < b["source"] and _paired(tile, a, b):
                        sums.setdefault((a["source"], b["source"]), 0)
            return
        shares = []
        for r in held:
            counts = np.zeros(width, np.int64)
            counts[r["at"]] = r["n"]
            shares.append(_share(counts, r["total"], r["terms"]))
        p = np.array(shares)
        for i, a in enumerate(held):
            others = [j for j, b in enumerate(held) if a["source"] < b["source"] and _paired(tile, a, b)]
            if others:
                q = p[others]
                value = ((p[i] - q) ** 2 // (p[i] + q)).sum(axis=1)
                for j, v in zip(others, value.tolist(), strict=True):
                    pair = a["source"], held[j]["source"]
                    sums[pair] = sums.get(pair, 0) + v

    def done():
        pairs = list(sums)
        yield pa.record_batch({
            "lang": pa.array([tile[0]] * len(pairs), pa.string()), "a": pa.array([p[0] for p in pairs], pa.string()),
            "b": pa.array([p[1] for p in pairs], pa.string()), "value": pa.array(list(sums.values()), pa.int64())})

    for batch in batches:
        rows = batch.select([c for c in batch.schema.names if c not in ("at", "n")]).to_pylist()
        lists = {c: batch.column(c) for c in ("at", "n")}
        for i, r in enumerate(rows):
            at = r["lang"], r["block_a"], r["block_b"], r["span"]
            if (at, r["chunk"]) != (tile, chunk) and held:
                add()
                held = []
            if at != tile and tile is not None:
                yield from done()
                sums = {}
            tile, chunk = at, r["chunk"]
            held.append(r | {c: lists[c][i].values.to_numpy() if lists[c][i].is_valid else np.empty(0, np.int64) for c in lists})
    if held:
        add()
        yield from done()


def _paired(tile: tuple, a: dict, b: dict) -> bool:
    """Whether this tile is the one for the pair: one of either block, or both of the block on the diagonal."""
    return tile[1] == tile[2] or a["block"] != b["block"]


def audit(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, group_block: int = GROUP_BLOCK,
          chunk: int = CHUNK, chunks_a_tile: int = CHUNKS_A_TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) of how far the sources of each language lie apart, in exact arithmetic.

    Terms are runs of letters A-Z, lower-cased, and characters beyond ASCII.  A language keeps the terms that at least
    `least_documents` of its documents hold; of V kept terms, N occurrences in a group, a term with n of them has the
    share p = 1 + floor(10^9 (n + 2) / (N + 2 V)), and two shares differ by floor((p - q)^2 / (p + q)).  Part `pair` gives
    each group its distance from every other source of its language, part `term` the `top` terms that it holds and that
    its language has a smaller share of, by difference.  Ranks go by value falling, then item rising in UTF-8.

    Counts are summed by task before they are shuffled.  Terms are dealt to chunks of about `chunk` of them by hash; each
    group's counts of a chunk are packed into one row, and go to the tiles (group block by group block, a span of chunks)
    that need them; a tile goes through its chunks one by one and gives partial sums.

    Null text, lang and source are empty strings; a group without terms has share 1 + floor(2 * 10^9 / (2 V)) of each; a
    language that keeps no term gives value 0 for its pairs and no terms; a source alone in its language has no pairs;
    repeated rows count each; other columns, doc_id too, take no part; an empty table gives no rows.
    """
    blank = F.lit("")
    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("lang", "source")), F.coalesce("text", blank).cast("binary").alias("text"))
    counts = rows.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = common.materialize(counts, "term_counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = common.materialize(kept.where(F.col("docs") >= least_documents).drop("docs"), "kept_terms")
    langs = common.materialize(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "langs")
    langs = common.broadcast_if_small(langs)  # so that terms are dealt by their chunks, not by their language alone
    chunks = F.ceil(F.col("terms") / chunk)
    place = Window.partitionBy("lang", "chunk").orderBy("term")  # about `chunk` terms
    vocabulary = kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), chunks)).withColumn("at", F.row_number().over(place) - 1)
    words = common.materialize(counts.drop("docs").join(vocabulary, ["lang", "term"]), "group_terms")

    totals = words.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    widths = vocabulary.groupBy("lang", "chunk").agg(F.count("*").alias("width"))
    by_name = Window.partitionBy("lang").orderBy("source")  # the groups of a language: as many as each has pairs
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs.select("lang", "terms"), "lang", "left")
    groups = groups.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("lang")) / group_block)).select(
        "lang", "source", "blocks", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms")), ((F.row_number().over(by_name) - 1) % F.col("blocks")).alias("block"))
    groups = common.materialize(groups, "groups")

    packed = words.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("counts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / chunk)) - 1))
    present = groups.withColumn("chunk", every).join(widths, ["lang", "chunk"], "left").join(packed, ["lang", "source", "chunk"], "left")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    key = ["lang", "block_a", "block_b", "span"]
    dealt = present.withColumn("other", other).select(
        "lang", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), F.floor(F.col("chunk") / chunks_a_tile).alias("span"),
        "chunk", "block", "source", "total", "terms", F.coalesce("width", F.lit(0)).alias("width"), F.col("counts.at").alias("at"), F.col("counts.n").alias("n"))
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = dealt.repartition(partitions, *key).sortWithinPartitions(*key, "chunk").mapInArrow(_tiles, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.select("lang", both.alias("pair"), "value").select("lang", "pair.source", F.lit("pair").alias("part"), "pair.item", "value").withColumn("rank", F.row_number().over(ranked))

    p, q = F.col("p"), F.col("q")
    apart = words.join(totals, ["lang", "source"]).where("n > 0").select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    terms = apart.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _div((p - q) * (p - q), p + q).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between all sources of each language, and the terms that set each source apart."""
    return audit(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT row_no, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), g AS (
  SELECT lang, source, k.term, count(*) AS n FROM t JOIN kept k USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM d
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN g USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(g.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(g.n, 0) + 2)) // (s.total + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM totals s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN g ON g.lang = s.lang AND g.source = s.source AND g.term = k.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
