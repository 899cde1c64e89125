"""The registered training-data queries: names, columns, and those that SQL can express."""

import duckdb
import pytest

import __spark_entry__ as E
from maillake.llm.queries import ORACLE, QUERIES
from tools.check_oracle import TABLES, canon

SF = "/root/testdata/sf0.01"
COLUMNS = {
    1: "doc_id held_out score predicted", 2: "doc_id n_words n_base first_word last_word base_labels labels score",
    3: "doc_id size text_crc32 law shard slot grown_shard", 4: "doc_id source text", 5: "doc_id n_tokens ids_sha256 decoded_sha256",
    6: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 7: "doc_id n_shingles component_id kept",
    8: "doc_id size source_size target taken", 9: "query_id rank vec_id score", 10: "doc_id n_bytes n_removed n_spans kept_sha256",
    11: "doc_id n_bytes n_tokens over_limit", 12: "doc_id leaf subroot root proof_sha256 folded_root verified",
    13: "lang source part item value rank",
}


def test_entry_registers_all():
    assert {*QUERIES, "pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert set(COLUMNS[int(name[2:].split("_")[0])].split()) <= set(df.columns)
    if name not in ("op9_exact_top_k", "op13_divergence"):
        ids = [r["doc_id"] for r in df.select("doc_id").collect()]
        assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twins(spark, name):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLE[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in cur.description], cur.fetchall())


def test_line_dedup_runs_no_python(spark):
    plan = QUERIES["op4_line_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
