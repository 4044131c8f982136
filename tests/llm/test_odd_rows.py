"""Null and repeated ids, ids over different texts, null, empty and long texts, clashing column names, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from varloom.llm import langid, media, minhash, mixing, pieces, pii, pitman_yor, toxicity, warc
from varloom.llm.common import crc_rest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    same = text(60)
    rows = [(i, text(40), "en", "a") for i in range(20)]
    rows += [(None, text(50), None, None), (None, text(30), "fr", "b"), (5, text(70), "en", "a"), (6, None, None, "b"), (7, "", "fr", None), (30, same, "fr", "b"), (30, same, "fr", "b"), (None, same, "fr", "b"), (31, text(30_000), "fr", "b")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS).withColumns({"score": F.lit(1.0), "size": F.lit("x"), "copies": F.lit(2), "media": F.lit("m"), "ids": F.lit(0)})


def ids(df, name="doc_id"):
    return sorted((r[name] is None, r[name] or 0) for r in df.select(name).collect())


def test_every_row_comes_back(spark, odd):
    held = crc_rest(F.col("doc_id"), 5) == 1
    model = langid.train(odd, ~held)
    outputs = {
        "op1": minhash.near_duplicates(odd, 3, 85), "op2": media.read_back(media.store_texts(odd)), "op4": langid.predict(odd, model),
        "op6": mixing.mix(odd), "op7": pitman_yor.score(odd, held), "op9": pieces.encode(odd),
    }
    for name, out in outputs.items():
        assert ids(out) == ids(odd), name


def test_equal_rows_have_equal_results(spark, odd):
    held = crc_rest(F.col("doc_id"), 5) == 1
    outputs = [minhash.near_duplicates(odd, 3, 85), mixing.mix(odd).select("doc_id", "size", "taken"), pitman_yor.score(odd, held)]
    for out in outputs:
        a, b = (r for r in out.collect() if r["doc_id"] == 30)
        assert a == b
    assert {r["component_id"] for r in outputs[0].collect() if r["n_shingles"] == 58} == {30}


def test_repeated_pages(spark):
    long = "p" * 300
    df = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, "u", long), (None, "u", None)], "page_id long, url string, html string").withColumns({"record_type": F.lit("x"), "payload": F.lit(1), "offset": F.lit(2)})
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.archive_and_read(df).collect())
    assert got == [(0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    held = crc_rest(F.col("doc_id"), 5) == 1
    assert media.read_back(media.store_texts(none)).count() == 0 and mixing.mix(none).count() == 0
    assert langid.predict(none, langid.train(none, ~held)).count() == 0 and pitman_yor.score(none, held).count() == 0
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_stages_keep_clean_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    kept = P.deduplicate(spark, docs, "")
    # copies of the repeated text go, another text under one id and rows without ids stay
    assert ids(kept) == sorted([(False, i) for i in [*range(20), 5, 6, 7, 30, 31]] + [(True, 0), (True, 0)])
    masked = P.mask_personal_data(spark, docs, "")
    assert ids(masked) == ids(docs)
    assert ids(P.encode_pieces(spark, docs, "")) == ids(docs)


def test_callers_columns_of_any_name(spark):
    """Names that the operators use inside, with blanks, dots and backticks, come back as they were, values too."""
    names = ["_t", "a`b", "x y", "p.q", "c0", "text", "doc_id", "lang"]
    rows = [(1, 2, 3, 4, 5, f"some words here {k}", k, "en" if k % 2 else "fr") for k in range(6)]
    df = spark.createDataFrame(rows, names)
    held = crc_rest(F.col("doc_id"), 3) == 1
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int")
    outputs = {
        "language": langid.predict(df, langid.train(df, ~held)),
        "toxicity": toxicity.predict(df, toxicity.train(df, labels, ~held)),
        "encoded": pieces.encode(df),
        "decoded": pieces.decode(pieces.encode(df)),
        "personal": pii.find(df),
    }
    for name, out in outputs.items():
        assert out.columns[: len(names)] == names, name
        assert sorted(tuple(r)[: len(names)] for r in out.collect()) == sorted(rows), name
    assert [r["decoded"] for r in outputs["decoded"].orderBy("doc_id").collect()] == [r[5] for r in rows]
    stored = media.store_texts(df).withColumnRenamed("doc_id", "i`d").withColumnRenamed("media", "m.d")
    assert media.probe(stored, "i`d", "m.d").columns[0] == "i`d" and media.probe(stored, "i`d", "m.d").count() == 6


def test_foreign_media_and_unlike_sets(spark):
    df = spark.createDataFrame([(1, 4, None), (2, 4, bytearray(b"not a container")), (3, 4, bytearray(media.write_container(b"abcd" * 16)))], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media.read_back(df).collect()}
    assert got[1]["payload_bytes"] is None and got[1]["media_bytes"] == 0 and got[2]["feature"] is None and got[2]["media_bytes"] == 15
    assert got[3]["payload_bytes"] == 64 and got[3]["feature"].startswith("codec=")
    with pytest.raises(ValueError, match="percent"):
        minhash.near_duplicates(df.select("doc_id", F.lit("a b c").alias("text")), percent=50)
