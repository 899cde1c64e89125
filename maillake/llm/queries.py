"""The registered queries of this package: thin forms over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maillake.llm import bpe, divergence, licenses, lines, manifest, mixing, neardup, quality, rules, shards, substrings, tokencount, topk
from maillake.llm.common import table

ORACLE: dict[str, str] = {}

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents`` with a classifier learned from ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"),
                         quality.score(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license signatures of every whole text of ``documents``."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


N_SHARDS = 40


def op3_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 for all ``documents`` by the weighted hash tree; law ``key``."""
    placed = shards.assign(table(spark, sf_dir, "documents"), N_SHARDS)
    return placed.withColumn("law", F.lit("key"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the lines that stand on more than a tenth of their source's pages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs, F.col("source"), counts=("n_lines", "n_dropped"))


ORACLE["op4_line_dedup"] = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT source, trim(line, ' ' || chr(9) || chr(13)) AS k, count(DISTINCT doc_id) AS pages FROM l
      WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY ALL),
t AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
b AS (SELECT k.source, list(k.k) AS bad FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
      WHERE pages >= {lines.MIN_PAGES} AND pages > {lines.RATIO} * host_pages GROUP BY k.source),
d AS (SELECT doc_id, d.source, text, string_split(text, chr(10)) AS ls, coalesce(b.bad, []) AS bad
      FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
f AS (SELECT *, [x FOR x IN ls IF NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))] AS kept FROM d)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped
FROM f
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``; digests of the ids and of the decoded bytes."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of weakly supervised rules on every whole text of ``documents``, below two fixed base rules."""
    judged = rules.judge(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"),
                         (~failed & (F.col("quality_probability") >= 0.5)).alias("kept"), "quality_probability")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` whose sets of 3-word shingles share 85% of their union."""
    found = neardup.components(table(spark, sf_dir, "documents"), 3, 85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of 150% of all ``documents`` takes from each of them."""
    plan = mixing.copies(table(spark, sf_dir, "documents"))
    rows = plan.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products with all other rows of ``embeddings`` for every row with a vec_id divisible by 20.

    Rows that repeat a vec_id have a list each; the SQL twin holds for unique ids, as the given tables have.
    """
    index = topk.Index(topk.whole_numbers(table(spark, sf_dir, "embeddings")))
    return index.search(F.col("id") % 20 == 0, 20)


ORACLE["op9_exact_top_k"] = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(v.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the bytes of 400-byte strings that start anywhere else as well."""
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


COUNTED_FILE = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents`` in the vocabulary of ``COUNTED_FILE``."""
    import public_tokenizers

    counted = tokencount.count(table(spark, sf_dir, "documents"), tokencount.read_tokenizer(public_tokenizers.path(COUNTED_FILE)))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TAMPER_EVERY = 5


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents`` with every row's proof, checked against a copy in which some texts are lower-cased."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0
    claimed = F.when(tampered, manifest.leaf_digest(*fields, F.translate("text", UPPER, UPPER.lower())))
    proofs = manifest.prove(docs, manifest.leaf_digest(*fields, F.col("text")), claimed)
    siblings = F.col("siblings")
    return (proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof_text(siblings), 256).alias("proof_sha256"),
                          manifest.folded(siblings, F.col("claimed")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def _tree_sql(name: str, leaves: str, key: str) -> str:
    """Nodes of all levels and their runs of 16, for trees over ``leaves`` (key, idx, h, n)."""
    return f"""
{name}_nodes AS (SELECT {key}, 0 AS lvl, idx, h, n FROM {leaves}
  UNION ALL SELECT {key}, lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 15) // 16
  FROM {name}_nodes WHERE n > 1 GROUP BY {key}, lvl, idx // 16),
{name}_runs AS (SELECT {key}, lvl, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM {name}_nodes WHERE n > 1 GROUP BY ALL)"""


def _fold_sql(name: str, start: str, tree: str, key: str) -> str:
    """Walk from leaves up: the proof so far and the digest folded so far."""
    return f"""
{name} AS (SELECT rid, {key}, 0 AS lvl, idx, n, proof, cur FROM {start}
  UNION ALL SELECT rid, {key}, lvl + 1, idx // 16, (n + 15) // 16,
         proof || array_to_string(hs[:idx % 16], '') || array_to_string(hs[idx % 16 + 2:], ''),
         sha256(array_to_string(hs[:idx % 16], '') || cur || array_to_string(hs[idx % 16 + 2:], ''))
  FROM {name} JOIN {tree}_runs USING ({key}, lvl) WHERE n > 1 AND run = idx // 16)"""


def _leaf_sql(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


ORACLE["op12_manifest"] = f"""
WITH RECURSIVE crc AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                     FOR i IN range(256)] AS tab),
doc AS (SELECT row_number() OVER () AS rid, *,
          xor(list_reduce(list_concat([4294967295], [ascii(c) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
                          lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM documents, crc),
leaf AS (SELECT rid, doc_id, coalesce('s' || source, '') AS k, {_leaf_sql("text")} AS h,
         CASE WHEN crc % 5 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} ELSE {_leaf_sql("text")} END AS claimed FROM doc),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM leaf),
{_tree_sql("g", "placed", "k")},
top AS (SELECT k, h AS subroot FROM g_nodes WHERE n = 1),
over AS (SELECT 0 AS z, k, subroot AS h, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM top),
{_tree_sql("r", "over", "z")},
{_fold_sql("up", "(SELECT rid, k, idx, n, '' AS proof, claimed AS cur FROM placed)", "g", "k")},
{_fold_sql("whole", "(SELECT rid, z, over.idx, over.n, proof, cur FROM up JOIN over USING (k) WHERE up.n = 1)", "r", "z")}
SELECT doc_id, placed.h AS leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root.h AS verified
FROM placed JOIN top USING (k) JOIN whole ON whole.rid = placed.rid AND whole.n = 1, (SELECT h FROM r_nodes WHERE n = 1) AS root
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the words of every source of ``documents`` are from other sources and from its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE["op13_divergence"] = rf"""
WITH doc AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT rid, lang, source, unnest(ts) AS term FROM doc),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {divergence.MIN_DOCS}),
v AS (SELECT g.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM doc) AS g LEFT JOIN kept USING (lang) GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM doc) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
       CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2)) // (total + 2 * v) AS HUGEINT) AS p
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(sum(n), 0) + 2)) // (any_value(total) + 2 * any_value(v)) AS HUGEINT) AS q
      FROM p JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source AS xs, y.source AS ys, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS s
                    FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) AS f
         ON f.lang = a.lang AND xs = a.source AND ys = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pair
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_license_scan, op3_hash_tree, op4_line_dedup, op5_byte_bpe, op6_quality_rules, op7_near_duplicates, op8_mix,
    op9_exact_top_k, op10_repeated_bytes, op11_token_counts, op12_manifest, op13_divergence)}
