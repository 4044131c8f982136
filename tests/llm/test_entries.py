"""The registered queries: those with SQL give its rows; all return the contract's columns."""

import hashlib

import duckdb
import pytest

from varloom.llm import entries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id n_shingles component_id kept",
    2: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    3: "page_id payload_bytes payload_digest record_type refers_to",
    4: "doc_id held_out lang_pred score",
    5: "doc_id held_out score predicted",
    6: "doc_id size source_size target taken",
    7: "doc_id held_out n_tokens n_known train_tokens base_score score",
    8: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    9: "doc_id",
    10: "query_id rank vec_id score",
    11: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    12: "word form root n n_near form_n",
    13: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
}
TABLE = {3: "pages", 10: "embeddings"}


@pytest.mark.parametrize("name", sorted(entries.queries()))
def test_columns_and_rows(spark, name):
    n = int(name[2:].split("_")[0])
    out = entries.queries()[name](spark, DATA).toPandas()
    assert list(out.columns[: len(COLUMNS[n].split())]) == COLUMNS[n].split()
    if n in (11, 13):
        conversations = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id").distinct().count()
        assert len(out) == conversations + (n == 13)
    elif n not in (10, 12):
        table = spark.read.parquet(f"{DATA}/{TABLE.get(n, 'documents')}.parquet")
        assert len(out) == table.count()


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = con.sql(entries.oracle_sql()[name])
    got = entries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_the_added_conversation(spark):
    """Both rows of conversation -1 hold control strings, which come back unescaped; one assistant text is learned."""
    got = entries.op13_chat_format(spark, DATA).filter("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
