"""SQL of the graph that loomgraph.sources.projection declares, for checking queries by a second engine."""

GRAPH = """
WITH RECURSIVE base AS (
  SELECT l_partkey AS p, l_suppkey AS s, l_linenumber AS ln, l_quantity AS q, l_discount AS dsc, l_returnflag AS rf,
    l_linestatus AS ls, c_nationkey AS n, o_orderpriority AS pr, p_brand AS b, p_type,
    c_mktsegment || '/' || o_orderpriority AS m, p_brand || l_returnflag || l_linestatus AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
), source AS (
  SELECT s_suppkey AS source_id, s_name AS name,
    CASE WHEN s_suppkey % 13 = 0 THEN true WHEN s_suppkey % 13 <= 6 THEN false END AS archived,
    CASE WHEN s_suppkey % 13 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'merged' ELSE 'orphan' END END AS archive_reason,
    CASE WHEN s_suppkey % 5 <> 0 THEN 'canon ' || (s_suppkey % 9) END AS canonical_name,
    CASE WHEN s_suppkey % 5 <> 0 THEN 'llm+index' END AS canonical_source,
    CASE WHEN s_suppkey % 2 = 0 THEN 'organism' ELSE 'chemical' END AS canonical_type,
    CASE WHEN s_suppkey % 3 = 0 THEN 'root' ELSE 'whole' END AS canonical_part,
    CASE s_suppkey % 4 WHEN 1 THEN 'linked' WHEN 2 THEN 'error' WHEN 3 THEN 'no_compounds_found' END AS linker_status,
    'doc' || (s_suppkey % 7) AS source_document
  FROM supplier
), compound AS (
  SELECT p_partkey AS compound_id, p_name AS name, substr(md5(p_brand || p_type), 1, 14) || '-' || p_partkey AS inchikey,
    'C' || p_size AS smiles, CASE WHEN p_partkey % 97 = 0 THEN true WHEN p_partkey % 97 <= 48 THEN false END AS archived,
    CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 <> 0 THEN 'CH' || p_partkey END AS chembl_id,
    CASE p_partkey % 4 WHEN 1 THEN 'linked' WHEN 2 THEN 'error' WHEN 3 THEN 'no_targets_found' END AS target_linker_status,
    CASE p_partkey % 3 WHEN 1 THEN 'linked' WHEN 2 THEN 'error' END AS kt_linker_status
  FROM part
), target AS (
  SELECT DISTINCT t AS target_id, 'T ' || substr(t, 1, 8) AS name, 'U' || b AS uniprot_id,
    CASE rf WHEN 'R' THEN 'SINGLE PROTEIN' WHEN 'A' THEN 'PROTEIN COMPLEX' ELSE 'ORGANISM' END AS target_type,
    CASE WHEN ls = 'F' THEN CASE WHEN rf = 'A' THEN 'error' ELSE 'linked' END END AS td_linker_status,
    CAST(NULL AS boolean) AS archived
  FROM base
), malady AS (
  SELECT DISTINCT m AS name, 'about ' || m AS description,
    CASE WHEN m = 'MACHINERY/1-URGENT' THEN true WHEN pr = '2-HIGH' THEN false END AS archived,
    CASE WHEN m = 'MACHINERY/1-URGENT' THEN 'orphan' END AS archive_reason,
    CASE pr WHEN '1-URGENT' THEN 'linked' WHEN '2-HIGH' THEN 'error' WHEN '3-MEDIUM' THEN 'unverified' END AS mapper_status,
    'doc' || substr(pr, 1, 1) AS source_document
  FROM base
), disease AS (
  SELECT n_nationkey AS disease_id, n_name AS name,
    CASE WHEN n_nationkey % 23 = 0 THEN true WHEN n_nationkey % 2 = 0 THEN false END AS archived,
    CASE WHEN n_nationkey % 23 = 0 THEN 'obsolete' END AS archive_reason,
    CASE WHEN n_nationkey % 5 = 0 THEN '' WHEN n_nationkey % 7 <> 0 THEN 'D' || n_nationkey END AS mesh_id,
    CASE WHEN n_nationkey % 3 <> 0 THEN 'I' || n_nationkey END AS icd10_code
  FROM nation
), preparation AS (SELECT DISTINCT p_type AS name, CAST(NULL AS boolean) AS archived FROM part
), extracted AS (
  SELECT p AS src, s AS dst,
    CASE WHEN min(ln) <= 2 THEN 'coconut_organism_canonical' WHEN min(ln) <= 4 THEN 'coconut_organism_alias' WHEN min(ln) = 5 THEN 'pubchem_chemical_formula' ELSE 'hand_note' END AS evidence_type,
    CASE WHEN min(ln) <= 2 THEN 0.9::double WHEN min(ln) <= 4 THEN 0.7::double ELSE 0.5::double END AS confidence
  FROM base WHERE q >= 44 AND dsc < 0.02::double AND s % 11 <> 0 GROUP BY p, s
), treats AS (SELECT s AS src, m AS dst, max(q) / 50 AS confidence FROM base WHERE rf = 'R' AND q >= 48 GROUP BY s, m
), maps AS (
  SELECT m AS src, n AS dst, rank,
    CASE WHEN rank > 1 THEN false WHEN length(m) % 3 <> 0 THEN true END AS is_primary,
    CASE rank WHEN 1 THEN 0.95::double WHEN 2 THEN 0.8::double ELSE 0.6::double END AS confidence,
    CASE rank WHEN 1 THEN 'gemini+mesh_exact' ELSE 'gemini_unverified' END AS mapping_source
  FROM (SELECT m, n, row_number() OVER (PARTITION BY m ORDER BY count(*) DESC, n) AS rank FROM base WHERE pr <> '4-NOT SPECIFIED' GROUP BY m, n)
  WHERE rank <= 3
), targets AS (
  SELECT p AS src, t AS dst, pchembl,
    CASE WHEN pchembl >= 9.6::double THEN 'chembl_mechanism' WHEN pchembl >= 7 THEN 'chembl_activity_strong'
      WHEN pchembl >= 6 THEN 'chembl_activity_moderate' WHEN pchembl > 5 THEN 'chembl_activity_weak' ELSE 'unlisted_assay' END AS evidence_type,
    CASE WHEN pchembl >= 9.6::double THEN 0.95::double WHEN pchembl >= 7 THEN 0.85::double WHEN pchembl >= 6 THEN 0.7::double ELSE 0.5::double END AS confidence
  FROM (SELECT p, t, max(q) / 5 AS pchembl FROM base WHERE q >= 25 AND p % 3 <> 0 GROUP BY p, t)
), relates AS (
  SELECT t AS src, n AS dst, CASE WHEN rank = 1 THEN 'ot_association_strong' WHEN n % 4 = 0 THEN 'text_mined' ELSE 'ot_association_moderate' END AS evidence_type,
    CASE rank WHEN 1 THEN 0.8::double ELSE 0.5::double END AS confidence
  FROM (SELECT t, n, row_number() OVER (PARTITION BY t ORDER BY count(*) DESC, n) AS rank FROM base GROUP BY t, n) WHERE rank <= 2
), known AS (
  SELECT p AS src, n AS dst, CAST(1 + count(*) % 4 AS integer) AS clinical_phase FROM base WHERE q >= 45 GROUP BY p, n HAVING count(*) >= 2
), prepared AS (SELECT DISTINCT s AS src, p_type AS dst FROM base WHERE q >= 49
)"""


def on_graph(sql: str) -> str:
    """A query over the graph: `sql` is a SELECT, or starts with a comma and further common tables."""
    sql = sql.strip()
    return f"{GRAPH}{'' if sql.startswith(',') else chr(10)}{sql}"
