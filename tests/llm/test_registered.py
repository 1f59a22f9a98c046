"""The registered queries: SQL where there is some, the contract's columns, all rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import oracle_connection, rows_of
from ledgerlens.llm.oracle import ORACLE
from ledgerlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op2_ann": "query_id rank vec_id score",
    "op3_mixing": "doc_id size source_size target taken",
    "op4_quality": "doc_id held_out score predicted",
    "op5_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_simhash": "doc_id fingerprint component_id",
    "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_simple8b": "doc_id start n_tokens ids_crc32",
    "op10_suffix_array": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op12_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cursor = oracle_connection(SF).execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_the_contract(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns[:len(COLUMNS[name].split())] == COLUMNS[name].split()
    kinds = dict(df.dtypes)
    for column in ("doc_id", "size", "taken", "start", "length", "n_bytes", "n_removed", "n_spans", "slot",
                   "group_size", "ids_crc32", "text_crc32", "doc_tokens", "offset", "component_id"):
        assert kinds.get(column, "bigint") == "bigint"
    if name != "op2_ann":
        ids = {r.doc_id for r in df.select("doc_id").collect()}
        assert ids == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
