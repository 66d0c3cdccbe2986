"""The star-schema tables seen as a typed evidence graph: six node tables and seven edge tables.

The joined star is written once, as nine tables are rolled up from it; the tables of the graph are declared once, by
DataFrame operations, and cached per application and directory until they are released.  The same graph in SQL stands
in loomgraph.plans.oracle for the tests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.sources.snapshots import stored


@dataclass(frozen=True)
class Graph:
    """Node tables source, compound, target, malady, disease, preparation; edge tables with src and dst ids."""

    source: DataFrame
    compound: DataFrame
    target: DataFrame
    malady: DataFrame
    disease: DataFrame
    preparation: DataFrame
    extracted: DataFrame  # compound -> source
    treats: DataFrame  # source -> malady
    maps: DataFrame  # malady -> disease
    targets: DataFrame  # compound -> target
    relates: DataFrame  # target -> disease
    known: DataFrame  # compound -> disease
    prepared: DataFrame  # source -> preparation

    @property
    def nodes(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ("source", "compound", "target", "malady", "disease", "preparation")}

    @property
    def edges(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ("extracted", "treats", "maps", "targets", "relates", "known", "prepared")}


def active(df: DataFrame, column: str = "archived") -> DataFrame:
    """Rows whose archived flag is false or null."""
    return df.where(~F.coalesce(F.col(column), F.lit(False)))


def primary(maps: DataFrame, strict: bool = False) -> DataFrame:
    """Primary mappings; a null flag counts as primary unless strict."""
    return maps.where(F.col("is_primary") if strict else F.coalesce("is_primary", F.lit(True)))


def _flag(key: Column, n: int) -> Column:
    return F.when(key % n == 0, True).when(key % n <= n // 2, False)


def _top(base: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent nations of a key, ties to the smaller nation."""
    order = Window.partitionBy(key).orderBy(F.desc("n_rows"), "n")
    counted = base.groupBy(key, "n").agg(F.count("*").alias("n_rows"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_cache: dict[tuple[str, str], Graph] = {}


def project(spark: SparkSession, sf_dir: str) -> Graph:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cache:
        _cache[key] = _project(spark, sf_dir)
    return _cache[key]


def release(spark: SparkSession) -> None:
    """Give back what the graphs of this application hold in the executors' memory."""
    for key in [k for k in _cache if k[0] == spark.sparkContext.applicationId]:
        graph = _cache.pop(key)
        for df in (*graph.nodes.values(), *graph.edges.values()):
            df.unpersist()


def _project(spark: SparkSession, sf_dir: str) -> Graph:
    def table(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    line = table("lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("ln"),
        F.col("l_quantity").alias("q"), F.col("l_discount").alias("dsc"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"))
    orders = table("orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("pr"))
    customer = table("customer").select("c_custkey", F.col("c_nationkey").alias("n"), "c_mktsegment")
    part = table("part")
    base = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(part.select("p_partkey", F.col("p_brand").alias("b")), F.col("p") == F.col("p_partkey"))
        .select("p", "s", "ln", "q", "dsc", "rf", "ls", "n", "pr", "b", F.concat_ws("/", "c_mktsegment", "pr").alias("m"),
                F.concat("b", "rf", "ls").alias("t"))
    )
    base = stored(base, "star")
    s, p, n = F.col("s_suppkey"), F.col("p_partkey"), F.col("n_nationkey")
    source = table("supplier").select(
        s.alias("source_id"), F.col("s_name").alias("name"), _flag(s, 13).alias("archived"),
        F.when(s % 13 == 0, F.when(s % 2 == 0, "merged").otherwise("orphan")).alias("archive_reason"),
        F.when(s % 5 != 0, F.concat(F.lit("canon "), (s % 9).cast("string"))).alias("canonical_name"),
        F.when(s % 5 != 0, F.lit("llm+index")).alias("canonical_source"),
        F.element_at(F.array(F.lit("organism"), F.lit("chemical")), (s % 2 + 1).cast("int")).alias("canonical_type"),
        F.when(s % 3 == 0, "root").otherwise("whole").alias("canonical_part"),
        F.when(s % 4 == 1, "linked").when(s % 4 == 2, "error").when(s % 4 == 3, "no_compounds_found").alias("linker_status"),
        F.concat(F.lit("doc"), (s % 7).cast("string")).alias("source_document"))
    compound = part.select(
        p.alias("compound_id"), F.col("p_name").alias("name"),
        F.concat(F.substring(F.md5(F.concat("p_brand", "p_type").cast("binary")), 1, 14), F.lit("-"), p.cast("string")).alias("inchikey"),
        F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("smiles"), _flag(p, 97).alias("archived"),
        F.when(p % 5 == 0, "").when(p % 7 != 0, F.concat(F.lit("CH"), p.cast("string"))).alias("chembl_id"),
        F.when(p % 4 == 1, "linked").when(p % 4 == 2, "error").when(p % 4 == 3, "no_targets_found").alias("target_linker_status"),
        F.when(p % 3 == 1, "linked").when(p % 3 == 2, "error").alias("kt_linker_status"))
    target = base.select("t", "b", "rf", "ls").distinct().select(
        F.col("t").alias("target_id"), F.concat(F.lit("T "), F.substring("t", 1, 8)).alias("name"), F.concat(F.lit("U"), "b").alias("uniprot_id"),
        F.when(F.col("rf") == "R", "SINGLE PROTEIN").when(F.col("rf") == "A", "PROTEIN COMPLEX").otherwise("ORGANISM").alias("target_type"),
        F.when(F.col("ls") == "F", F.when(F.col("rf") == "A", "error").otherwise("linked")).alias("td_linker_status"),
        F.lit(None).cast("boolean").alias("archived"))
    malady = base.select("m", "pr").distinct().select(
        F.col("m").alias("name"), F.concat(F.lit("about "), "m").alias("description"),
        F.when(F.col("m") == "MACHINERY/1-URGENT", True).when(F.col("pr") == "2-HIGH", False).alias("archived"),
        F.when(F.col("m") == "MACHINERY/1-URGENT", "orphan").alias("archive_reason"),
        F.when(F.col("pr") == "1-URGENT", "linked").when(F.col("pr") == "2-HIGH", "error").when(F.col("pr") == "3-MEDIUM", "unverified").alias("mapper_status"),
        F.concat(F.lit("doc"), F.substring("pr", 1, 1)).alias("source_document"))
    disease = table("nation").select(
        n.alias("disease_id"), F.col("n_name").alias("name"),
        F.when(n % 23 == 0, True).when(n % 2 == 0, False).alias("archived"),
        F.when(n % 23 == 0, "obsolete").alias("archive_reason"),
        F.when(n % 5 == 0, "").when(n % 7 != 0, F.concat(F.lit("D"), n.cast("string"))).alias("mesh_id"),
        F.when(n % 3 != 0, F.concat(F.lit("I"), n.cast("string"))).alias("icd10_code"))
    preparation = part.select(F.col("p_type").alias("name")).distinct().select("name", F.lit(None).cast("boolean").alias("archived"))

    extracted = base.where("q >= 44 AND dsc < 0.02 AND s % 11 <> 0").groupBy("p", "s").agg(F.min("ln").alias("ln")).select(
        F.col("p").alias("src"), F.col("s").alias("dst"),
        F.when(F.col("ln") <= 2, "coconut_organism_canonical").when(F.col("ln") <= 4, "coconut_organism_alias").when(F.col("ln") == 5, "pubchem_chemical_formula").otherwise("hand_note").alias("evidence_type"),
        F.when(F.col("ln") <= 2, 0.9).when(F.col("ln") <= 4, 0.7).otherwise(0.5).alias("confidence"))
    treats = base.where("rf = 'R' AND q >= 48").groupBy("s", "m").agg((F.max("q") / 50).alias("confidence")).select(
        F.col("s").alias("src"), F.col("m").alias("dst"), "confidence")
    ranked = _top(base.where("pr <> '4-NOT SPECIFIED'"), "m", 3)
    maps = ranked.select(
        F.col("m").alias("src"), F.col("n").alias("dst"), "rank",
        F.when(F.col("rank") > 1, False).when(F.length("m") % 3 != 0, True).alias("is_primary"),
        F.when(F.col("rank") == 1, 0.95).when(F.col("rank") == 2, 0.8).otherwise(0.6).alias("confidence"),
        F.when(F.col("rank") == 1, "gemini+mesh_exact").otherwise("gemini_unverified").alias("mapping_source"))
    targets = base.where("q >= 25 AND p % 3 <> 0").groupBy("p", "t").agg((F.max("q") / 5).alias("pchembl"))
    kind = F.when(F.col("pchembl") >= 9.6, "chembl_mechanism").when(F.col("pchembl") >= 7, "chembl_activity_strong").when(
        F.col("pchembl") >= 6, "chembl_activity_moderate").when(F.col("pchembl") > 5, "chembl_activity_weak").otherwise("unlisted_assay")
    sure = F.when(F.col("pchembl") >= 9.6, 0.95).when(F.col("pchembl") >= 7, 0.85).when(F.col("pchembl") >= 6, 0.7).otherwise(0.5)
    targets = targets.select(F.col("p").alias("src"), F.col("t").alias("dst"), "pchembl", kind.alias("evidence_type"), sure.alias("confidence"))
    relates = _top(base, "t", 2).select(
        F.col("t").alias("src"), F.col("n").alias("dst"),
        F.when(F.col("rank") == 1, "ot_association_strong").when(F.col("n") % 4 == 0, "text_mined").otherwise("ot_association_moderate").alias("evidence_type"),
        F.when(F.col("rank") == 1, 0.8).otherwise(0.5).alias("confidence"))
    known = base.where("q >= 45").groupBy("p", "n").agg(F.count("*").alias("c")).where("c >= 2").select(
        F.col("p").alias("src"), F.col("n").alias("dst"), (1 + F.col("c") % 4).cast("int").alias("clinical_phase"))
    kinds = part.select(F.col("p_partkey").alias("p"), "p_type")
    prepared = base.where("q >= 49").join(kinds, "p").select(F.col("s").alias("src"), F.col("p_type").alias("dst")).distinct()
    made = dict(
        source=source, compound=compound, target=target, malady=malady, disease=disease, preparation=preparation,
        extracted=extracted, treats=treats, maps=maps, targets=targets, relates=relates, known=known, prepared=prepared)
    return Graph(**{k: v.persist() for k, v in made.items()})
