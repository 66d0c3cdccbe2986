"""Regions of text that speak of several sources: tagging by keywords, candidates, names brought together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import signals as S
from loomgraph.operators import paths as P
from loomgraph.operators import places, text
from loomgraph.plans.registry import Registry
from loomgraph.plans.tables import read
from loomgraph.sources.projection import Graph
from loomgraph.sources.snapshots import stored

ENTRIES = Registry()
entry = ENTRIES.entry
TABLES: dict = {}
REGION_CHARS, REGION_SOURCES = 200, 2


def on_tables(name: str, sql: str | None):
    def keep(f):
        TABLES[name] = (f, sql)
        return f

    return keep


def tagged(paragraphs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, paragraph, source): sources (source, keyword) of which a keyword stands in a paragraph as a whole, that is
    between ends of words, case apart; a keyword may be a phrase.  A keyword without a word in it stands nowhere.

    Paragraphs are read once, in Arrow batches, and only places of keywords leave a task; a keyword with marks at its ends
    is looked for in the texts that have what is between them.  A word is of letters, numbers and _.
    """
    known = keywords.select("source", places.lower(F.trim("keyword")).alias("keyword")).where("keyword <> ''").distinct()
    return places.words_found(paragraphs.select("doc_id", "paragraph", "text"), known).select("doc_id", "paragraph", "source").distinct()


def regions_of(windows: DataFrame, tags: DataFrame, size: int = 1, signals: S.Signals = S.Signals(), least: int = REGION_CHARS,
               sources: int = REGION_SOURCES, paragraphs_each: int = 1) -> DataFrame:
    """(doc_id, first, source) of windows (doc_id, first, text) of `size` paragraphs that are long enough, read like entries,
    not like remarks on compatibility alone, and name enough sources, each in enough of their paragraphs."""
    fit = windows.where((F.length("text") >= least) & S.is_entry(F.col("text"), signals) & ~S.is_compatibility_only(F.col("text"), signals)).select("doc_id", "first")
    return named_enough(fit, tags, size, sources, paragraphs_each)


def fit_windows(documents: DataFrame, size: int, mark: str, signals: S.Signals = S.Signals(), least: int = REGION_CHARS) -> DataFrame:
    """(doc_id, first) of the text.paragraph_windows of `size` paragraphs, one from every paragraph on, that regions_of takes.

    Paragraphs meet at a blank line, which no signal holds, so a window's signals and characters are sums of its
    paragraphs' and each paragraph is read once, not once a window."""
    counted = lambda p: F.struct(F.length(p).alias("chars"), *[S.count_of(p, getattr(signals, n)).alias(n) for n in ("entry", "therapy", "compatibility")])
    rows = documents.select("doc_id", F.transform(text.pieces(F.col("text"), mark, 50), counted).alias("parts"))
    starts = F.when(F.size("parts") >= size, F.sequence(F.lit(0), F.greatest(F.size("parts") - size, F.lit(0))))
    # not explode, for which Spark would count all signals a second time to see that there are any
    rows = rows.select("doc_id", "parts", F.explode_outer(starts).alias("first")).where("first IS NOT NULL")
    total = lambda n: F.aggregate(F.slice(F.col(f"parts.{n}"), F.col("first") + 1, F.lit(size)), F.lit(0), lambda a, x: a + x).alias(n)
    sums = rows.select("doc_id", "first", *map(total, ("chars", "entry", "therapy", "compatibility")))
    only = S.outnumbered(F.col("compatibility"), F.col("therapy"))
    return sums.where((F.col("chars") + 2 * (size - 1) >= least) & (F.col("entry") >= S.LEAST_ENTRY) & ~only).select("doc_id", "first")


def named_enough(fit: DataFrame, tags: DataFrame, size: int, sources: int, paragraphs_each: int = 1) -> DataFrame:
    """(doc_id, first, source) of windows (doc_id, first) of `size` paragraphs that name enough sources, each in enough of
    their paragraphs."""
    near = tags.select("doc_id", "source", F.explode(F.sequence(F.col("paragraph") - (size - 1), F.col("paragraph"))).alias("first"))
    named = near.join(fit, ["doc_id", "first"]).groupBy("doc_id", "first", "source").count().where(F.col("count") >= paragraphs_each)
    # one row for each window: as many sources as it names
    found = named.groupBy("doc_id", "first").agg(F.collect_list("source").alias("named")).where(F.size("named") >= sources)
    return found.select("doc_id", "first", F.explode("named").alias("source"))


def synthetic_regions(gold: DataFrame, others: DataFrame, regions: int, gold_each: int = 3, others_each: int = 7, seed: str = "42") -> DataFrame:
    """(region, source, is_gold): regions put together from sources that each were found alone, drawn least used first.

    gold and others are tables of (source).  Gold goes round in a seeded order, so none is drawn twice more than another; the
    others go round too, past those that are gold in the same region, which then come first in the next: of the least used
    the one that was drawn longest ago.  A region's gold is never that of an earlier one; where no new one is left, there are
    no more regions.  The order of drawing lives in one array of names, as large as a few regions or the names there are,
    whichever is less; texts join by name afterwards.
    """
    h = lambda c: F.md5(F.concat_ws("|", F.lit(seed), c).cast("binary"))

    def ordered(pool: DataFrame, most: int, name: str) -> DataFrame:
        order = pool.select("source").dropna().distinct().select(h(F.col("source")).alias("h"), "source").orderBy("h", "source").limit(most)
        return order.agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "source"))), lambda x: x["source"]).alias(name))

    pools = ordered(gold, regions * gold_each, "gold").crossJoin(ordered(others, regions * (gold_each + others_each), "others"))  # single rows
    size = F.size("gold")
    # gold comes round to the same set after size / gcd regions
    divisors = F.filter(F.sequence(F.lit(1), F.lit(gold_each)), lambda d: (size % d == 0) & (F.lit(gold_each) % d == 0))
    period = F.floor(size / F.array_max(divisors)).cast("int")
    count = F.when(size < gold_each, 0).otherwise(F.least(F.lit(regions), period))
    none = F.array().cast("array<string>")
    begin = F.struct(F.col("others").alias("queue"), F.array().cast("array<struct<gold:array<string>,others:array<string>>>").alias("made"))

    def draw(state, j):
        own = F.transform(F.sequence(F.lit(0), F.lit(gold_each - 1)), lambda i: F.element_at("gold", ((j * gold_each + i) % size + 1).cast("int")))
        free = F.slice(F.array_except(state["queue"], own), 1, others_each)
        return F.struct(
            F.concat(F.array_except(state["queue"], free), free).alias("queue"),
            F.concat(state["made"], F.array(F.struct(own.alias("gold"), free.alias("others")))).alias("made"))

    steps = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    made = pools.select(F.posexplode(F.aggregate(steps, begin, draw)["made"]).alias("region", "r"))
    parts = F.concat(
        F.transform("r.gold", lambda x: F.struct(x.alias("source"), F.lit(True).alias("is_gold"))),
        F.transform(F.coalesce("r.others", none), lambda x: F.struct(x.alias("source"), F.lit(False).alias("is_gold"))))
    return made.select("region", F.explode(parts).alias("p")).select("region", "p.source", "p.is_gold")


def region_texts(drawn: DataFrame, singles: DataFrame, seed: str = "42") -> DataFrame:
    """(region, text, gold, others) of drawn regions: each source's first text of singles (source, nth, text), mixed by seed."""
    first = singles.groupBy("source").agg(F.min(F.struct("nth", "text"))["text"].alias("text"))
    place = F.md5(F.concat_ws("|", F.lit(seed), F.col("region").cast("string"), "source").cast("binary"))
    rows = drawn.join(first, "source").withColumn("place", place)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    names = lambda own: F.array_sort(F.collect_set(F.when(F.col("is_gold") == own, F.col("source"))))
    return rows.groupBy("region").agg(F.array_join(texts, "\n\n").alias("text"), names(True).alias("gold"), names(False).alias("others"))


def first_of_each(regions: DataFrame) -> DataFrame:
    """Regions (region, source) kept when they are gone through in order and each must bring a source that no kept one has.

    The first region with a source is always kept, as nothing before it has that source; and a region that is first with
    none is never kept, as for each of its sources the first one was.  So one minimum a source tells, without going
    through them.
    """
    return regions.groupBy("source").agg(F.min("region").alias("region")).select("region").distinct()


#: signals that the tables at hand have: their commonest words in place of those of a herbal
COMMON = S.Signals(entry="the|and|with|la|de|der|die|und|et|le", therapy="that|was|this|que|nicht|les", compatibility="are|for|el|ist|dans")
#: p.s is the text with | in place of marks, so a keyword stands in it between spaces and marks
MATCH = " OR ".join(f"contains(p.s, '{a}' || k.keyword || '{b}')" for a in " |" for b in " |")
KEYWORDS_SQL = r"""
k AS (SELECT DISTINCT source, keyword FROM (
    SELECT item_id AS source, unnest(list_filter(string_split(lower(text), ' '), lambda w: regexp_full_match(w, '[a-z]{6,}'))) AS keyword FROM benchmark
    UNION ALL SELECT item_id, w[i] || ' ' || w[i + 1] FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark)) WHERE regexp_full_match(w[i], '[a-z]{3,}') AND regexp_full_match(w[i + 1], '[a-z]{3,}')))
"""
PARAGRAPHS_SQL = r"""
p AS (SELECT *, '|' || regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_ ]', '|', 'g') || '|' AS s FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS paragraph FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{mark}'), lambda x: trim(x)), lambda x: length(x) > 50) AS l FROM documents) WHERE len(l) > 0))
"""
TAGS_SQL = "tags AS (SELECT DISTINCT p.doc_id, p.paragraph, k.source FROM p JOIN k ON " + MATCH + ")"
WORDS_SQL = "WITH " + PARAGRAPHS_SQL.format(mark=r"\n\s*\n") + "," + KEYWORDS_SQL + "," + TAGS_SQL
LINES_SQL = "WITH RECURSIVE " + PARAGRAPHS_SQL.format(mark=r"\n") + "," + KEYWORDS_SQL + "," + TAGS_SQL


def counted_sql(alternatives: str, column: str = "text") -> str:
    """Letters beyond ASCII count as parts of words, which the second engine's \\b doesn't know."""
    return f"len(regexp_extract_all(regexp_replace({column}, '[^\\x00-\\x7F]', 'x', 'g'), '(?i)\\b(?:{alternatives})\\b'))"


FIT_SQL = f"length(text) >= 200 AND {counted_sql(COMMON.entry)} >= 2 AND NOT ({counted_sql(COMMON.compatibility)} >= 1 AND {counted_sql(COMMON.therapy)} < greatest(1, {counted_sql(COMMON.compatibility)} // 2))"
REGIONS_SQL = WORDS_SQL + f"""
, fit AS (SELECT doc_id, paragraph FROM p WHERE {FIT_SQL}), enough AS (SELECT doc_id, paragraph FROM tags JOIN fit USING (doc_id, paragraph) GROUP BY doc_id, paragraph HAVING count(*) >= 2)
, regions AS (SELECT doc_id, paragraph, source FROM tags JOIN enough USING (doc_id, paragraph))
"""


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each benchmark item: its words of six letters or more, and its pairs of words of three or more."""
    words = F.split(F.lower("text"), " ")
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source"), words.alias("w"))
    single = F.filter("w", lambda w: w.rlike("^[a-z]{6,}$"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.when(
        F.get("w", i - 1).rlike("^[a-z]{3,}$") & F.get("w", i).rlike("^[a-z]{3,}$"), F.concat_ws(" ", F.get("w", i - 1), F.get("w", i))))
    return rows.select("source", F.explode(F.array_distinct(F.array_compact(F.concat(single, pairs)))).alias("keyword"))


@on_tables("tx06_tagged_paragraphs", WORDS_SQL + "SELECT doc_id, paragraph, count(*) AS sources FROM tags GROUP BY doc_id, paragraph")
def tagged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagged(text.paragraphs(read(spark, sf_dir, "documents")), keyword_table(spark, sf_dir))
    return rows.groupBy("doc_id", "paragraph").agg(F.count("*").alias("sources"))


def candidate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, first, source) of paragraphs that are long enough, read like entries and name enough sources."""
    rows = text.paragraphs(read(spark, sf_dir, "documents"))
    return regions_of(rows.withColumnRenamed("paragraph", "first"), tagged(rows, keyword_table(spark, sf_dir)), signals=COMMON)


@on_tables("tx07_candidate_regions", REGIONS_SQL + "SELECT doc_id, paragraph, count(*) AS sources FROM regions GROUP BY doc_id, paragraph")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_regions(spark, sf_dir).groupBy("doc_id", F.col("first").alias("paragraph")).agg(F.count("*").alias("sources"))


@on_tables("tx09_regions_with_news", REGIONS_SQL + "SELECT DISTINCT r.doc_id, r.paragraph FROM (SELECT source, min({'doc_id': doc_id, 'paragraph': paragraph}) AS r FROM regions GROUP BY source)")
def regions_with_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidate_regions(spark, sf_dir).select(F.struct("doc_id", "first").alias("region"), "source")
    return first_of_each(found).select("region.doc_id", F.col("region.first").alias("paragraph"))


@on_tables("wn16_paragraph_windows", "WITH " + PARAGRAPHS_SQL.format(mark=r"\n") + """
, l AS (SELECT doc_id, list(text ORDER BY paragraph) AS parts FROM p GROUP BY doc_id HAVING count(*) >= 3), w AS (SELECT doc_id, parts, unnest(range(0, len(parts) - 2, 2)) AS first FROM l)
SELECT doc_id, first::integer AS first, length(array_to_string(parts[first + 1:first + 3], chr(10) || chr(10))) AS chars, md5(array_to_string(parts[first + 1:first + 3], chr(10) || chr(10))) AS digest FROM w""")
def windows_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three lines that follow each other, a window every two."""
    rows = text.paragraph_windows(read(spark, sf_dir, "documents"), 3, 2, mark=r"\n")
    return rows.select("doc_id", "first", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@on_tables("wn16_window_regions", LINES_SQL + f"""
, l AS (SELECT doc_id, list(text ORDER BY paragraph) AS parts FROM p GROUP BY doc_id HAVING count(*) >= 5), w AS (SELECT doc_id, first, array_to_string(parts[first + 1:first + 5], chr(10) || chr(10)) AS text FROM (SELECT doc_id, parts, unnest(range(0, len(parts) - 4)) AS first FROM l))
, fit AS (SELECT doc_id, first FROM w WHERE {FIT_SQL}), near AS (SELECT DISTINCT f.doc_id, f.first, t.source FROM fit f JOIN tags t ON t.doc_id = f.doc_id AND t.paragraph BETWEEN f.first AND f.first + 4)
SELECT doc_id, first::integer AS first, count(*) AS sources FROM near GROUP BY doc_id, first HAVING count(*) >= 2""")
def window_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate regions of five lines each, one from every line on."""
    documents = read(spark, sf_dir, "documents")
    tags = tagged(text.paragraphs(documents, r"\n"), keyword_table(spark, sf_dir))
    found = named_enough(fit_windows(documents, 5, r"\n", COMMON), tags, 5, REGION_SOURCES)
    return found.groupBy("doc_id", "first").agg(F.count("*").alias("sources"))


SINGLES_SQL = LINES_SQL + f"""
, alone AS (SELECT p.doc_id, p.paragraph, p.text, min(t.source) AS source FROM tags t JOIN p USING (doc_id, paragraph) WHERE {counted_sql(COMMON.therapy, 'p.text')} >= 1 GROUP BY p.doc_id, p.paragraph, p.text HAVING count(*) = 1)
, pool AS (SELECT DISTINCT source::varchar AS source, md5('42|' || source) AS h FROM alone), gold AS (SELECT list(source ORDER BY h) AS g FROM (SELECT * FROM pool WHERE CAST(source AS integer) % 2 = 0 ORDER BY h LIMIT 24))
, others AS (SELECT list(source ORDER BY h) AS o FROM (SELECT * FROM pool ORDER BY h LIMIT 80))
, f AS (SELECT -1 AS j, g, o AS queue, []::varchar[] AS own, []::varchar[] AS free FROM gold, others WHERE len(g) >= 3 UNION ALL
  SELECT j, g, list_concat(list_filter(queue, lambda x: NOT list_contains(free, x)), free), own, free FROM (
    SELECT j, g, queue, own, list_filter(queue, lambda x: NOT list_contains(own, x))[1:7] AS free FROM (
      SELECT f.j + 1 AS j, g, queue, [g[((f.j + 1) * 3 + i) % len(g) + 1] for i in range(3)] AS own FROM f WHERE f.j + 1 < least(8, len(g) // CASE WHEN len(g) % 3 = 0 THEN 3 ELSE 1 END))))
"""


def single_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, nth, text) of lines that name one source alone and speak of treatment."""
    lines = text.paragraphs(read(spark, sf_dir, "documents"), r"\n")
    tags = tagged(lines, keyword_table(spark, sf_dir))
    alone = tags.groupBy("doc_id", "paragraph").agg(F.count("*").alias("n"), F.min("source").cast("string").alias("source")).where("n = 1")
    return alone.join(lines, ["doc_id", "paragraph"]).where(S.is_treatment(F.col("text"), COMMON)).select("source", F.struct("doc_id", "paragraph").alias("nth"), "text")


@on_tables("tx10_synthetic_regions", SINGLES_SQL + """
, drawn AS (SELECT j, unnest(own) AS source, true AS is_gold FROM f WHERE j >= 0 UNION ALL SELECT j, unnest(free), false FROM f WHERE j >= 0)
, first AS (SELECT source::varchar AS source, arg_min(text, {'d': doc_id, 'p': paragraph}) AS text FROM alone GROUP BY source)
SELECT j AS region, md5(string_agg(text, chr(10) || chr(10) ORDER BY md5('42|' || j || '|' || source))) AS digest, string_agg(source, ';' ORDER BY source) FILTER (is_gold) AS gold, coalesce(string_agg(source, ';' ORDER BY source) FILTER (NOT is_gold), '') AS others
FROM drawn JOIN first USING (source) GROUP BY j""")
def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight regions of three gold sources and seven others, each found alone somewhere, least used first."""
    singles = single_paragraphs(spark, sf_dir)
    singles = stored(singles, "singles")
    drawn = synthetic_regions(singles.where("CAST(source AS int) % 2 = 0"), singles, 8)
    made = region_texts(drawn, singles)
    return made.select("region", F.md5(F.col("text").cast("binary")).alias("digest"), F.array_join("gold", ";").alias("gold"), F.array_join("others", ";").alias("others"))


@on_tables("tx04_passages", r"""
WITH a AS (SELECT item_id, trim(lower(x)) AS needle FROM (SELECT item_id, unnest([substr(text, 1, 15), substr(text, 30, 25)]) AS x FROM benchmark) WHERE length(trim(x)) >= 3)
, t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), h AS (SELECT doc_id, len(lines) AS n, lines, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM t)
, m AS (SELECT DISTINCT item_id, doc_id, n, i FROM h JOIN a ON contains(lower(line), needle)), w AS (SELECT *, greatest(i - 15, 0) AS s, i + 16 AS e FROM m)
, f AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY item_id, doc_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM w), g AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id, doc_id ORDER BY i) AS island FROM f)
, r AS (SELECT item_id, doc_id, min(s) AS s, least(max(e), any_value(n)) AS e FROM g GROUP BY item_id, doc_id, island)
, b AS (SELECT item_id, doc_id, s, '
--- corpus lines ' || (s + 1) || '-' || e || ' ---
' || array_to_string(lines[s + 1:e], chr(10)) AS block FROM r JOIN t USING (doc_id))
, p AS (SELECT item_id, doc_id, count(*) AS windows, trim(string_agg(block, chr(10) ORDER BY s), ' ' || chr(9) || chr(10) || chr(13)) AS passage FROM b GROUP BY item_id, doc_id)
SELECT item_id, doc_id, windows, length(whole) AS chars, md5(whole) AS digest FROM (SELECT item_id, doc_id, windows, CASE WHEN item_id % 2 = 0 THEN '--- source.evidence_span (Phase 1 anchor) ---' || chr(10) || trim(left(text, 40)) || chr(10) || chr(10) ELSE '' END || passage AS whole
  FROM p JOIN benchmark USING (item_id))""")
def passages_with_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages about each item in each document that speaks of it, every second behind the span it is known by."""
    items = read(spark, sf_dir, "benchmark")
    needles = items.select("item_id", F.explode(F.array(F.substring("text", 1, 15), F.substring("text", 30, 25))).alias("needle"))
    found = text.passages(read(spark, sf_dir, "documents"), needles, budget=None, mark="\n")
    seeds = items.select("item_id", F.when(F.col("item_id") % 2 == 0, F.left("text", F.lit(40))).alias("seed"))
    whole = text.with_seed(F.col("passage"), F.col("seed"), F.lit(None).cast("string"))
    rows = found.join(seeds, "item_id").select("item_id", "doc_id", "windows", whole.alias("whole"))
    return rows.select("item_id", "doc_id", F.col("windows").cast("long").alias("windows"), F.length("whole").cast("long").alias("chars"), F.md5(F.col("whole").cast("binary")).alias("digest"))


@entry("tx08_canonical_variants", """
, named AS (SELECT source_id, CASE WHEN source_id % 2 = 0 THEN upper(canonical_name) ELSE canonical_name END AS variant FROM source WHERE canonical_name IS NOT NULL)
, counts AS (SELECT n.variant, count(DISTINCT x.src) AS n FROM named n JOIN extracted x ON x.dst = n.source_id GROUP BY n.variant)
, best AS (SELECT lower(trim(variant)) AS key, arg_min(variant, (-n, ascii(variant), variant)) AS canonical, count(*) AS variants FROM counts GROUP BY 1)
SELECT b.canonical, b.variants, count(DISTINCT x.src) AS compounds FROM best b JOIN named n ON lower(trim(n.variant)) = b.key JOIN extracted x ON x.dst = n.source_id GROUP BY b.canonical, b.variants""")
def canonical_variants(g: Graph) -> DataFrame:
    """Variants of a name that differ by case only: the one with most compounds stands for all, with the compounds of all."""
    variant = F.when(F.col("source_id") % 2 == 0, F.upper("canonical_name")).otherwise(F.col("canonical_name"))
    named = g.source.where("canonical_name IS NOT NULL").select("source_id", variant.alias("variant"), F.lower(F.trim(variant)).alias("key"))
    rows = P.source_compounds(g).select("source_id", "compound_id").join(named, "source_id")
    counts = rows.groupBy("key", "variant").agg(F.count_distinct("compound_id").alias("n"))
    order = F.struct((-F.col("n")).alias("a"), F.ascii("variant").alias("b"), "variant")
    best = counts.groupBy("key").agg(F.min(order).alias("o"), F.count("*").alias("variants"))
    union = rows.groupBy("key").agg(F.count_distinct("compound_id").alias("compounds"))
    return best.join(union, "key").select(F.col("o.variant").alias("canonical"), "variants", "compounds")


@on_tables("fn36_signal_counts", f"""
SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(?:{S.ENTRY})\\b')) AS entry, len(regexp_extract_all(text, '(?i)\\b(?:{S.THERAPY})\\b')) AS therapy, len(regexp_extract_all(text, '(?i)\\b(?:{S.COMPATIBILITY})\\b')) AS compatibility FROM documents""")
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", *[
        S.count_of(t, p).cast("long").alias(n) for n, p in (("entry", S.ENTRY), ("therapy", S.THERAPY), ("compatibility", S.COMPATIBILITY))])


@on_tables("fn35_search_keywords", """
WITH n AS (SELECT DISTINCT 'Radix ' || p_name || 'ae Citri' AS name FROM part), w AS (SELECT name, unnest(string_split(lower(name), ' ')) AS w FROM n), f AS (SELECT name, w AS k FROM w WHERE w <> 'radix'
  UNION SELECT name, 'citrus' FROM n UNION SELECT name, left(w, -1) FROM w WHERE w LIKE '%i' AND length(w) > 4 AND w <> 'radix' UNION SELECT name, left(w, -2) FROM w WHERE (w LIKE '%ae' OR w LIKE '%is') AND length(w) > 5)
SELECT name, array_to_string(list(k ORDER BY k), ' ') AS keywords FROM f WHERE length(k) >= 4 GROUP BY name""")
def search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Radix "), "p_name", F.lit("ae Citri"))
    return read(spark, sf_dir, "part").select(name.alias("name")).distinct().select("name", F.array_join(S.search_keywords(F.col("name")), " ").alias("keywords"))
