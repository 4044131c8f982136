"""The text operators against brute force, exact round trips, held-out accuracy, and odd input."""

import hashlib
import os
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varloom.cluster import materialize
from varloom.llm import forest, langid, media, minhash, mixing, pieces, pii, pitman_yor, textsets, toxicity, warc
from varloom.llm.common import components, crc_rest, lookup

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, own string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, texts, first=0):
    """Documents with further columns, some of whose names the operators use themselves."""
    rows = [(first + i, t, "en", f"s{i % 3}", len(t or ""), 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- near-duplicates --------------------------------------------------------------------------------------


def shingles(text, n):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return {d: (len(sets[i]), min(ids[find(i)])) for i, (d, _) in enumerate(rows)}


def near_copies(seed):
    rng = random.Random(seed)
    texts = []
    passage = words(rng, 30)
    for _ in range(6):
        base = words(rng, rng.choice([4, 30, 120, 300]))
        for _ in range(rng.choice([1, 5, 25])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [" ".join(words(rng, 60) + passage) for _ in range(40)]
    texts += [texts[0]] * 5 + [texts[0].upper(), "", " \n", None, "one", "one two", "ONE\ttwo", " ".join(words(rng, 20_000))]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, seed, n, percent):
    texts = near_copies(seed)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts), n, percent).collect()}
    for d, (size, component) in brute_components(list(enumerate(texts)), n, percent).items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (size, component, d == component)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A group above the block size is dealt out and still found whole."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = near_copies(7)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, texts), 3, 85).collect()}
    assert got == {d: c for d, (_, c) in brute_components(list(enumerate(texts)), 3, 85).items()}


def test_near_duplicates_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z"), (2, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(rows, 3, 85).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", False)]
    assert minhash.near_duplicates(rows.limit(0), 3, 85).count() == 0


def test_word_bounds_and_hashes():
    import pyarrow as pa

    texts = ["Aa  bB c\x0bD", "", None, "é ü\x1fz", "tail ", "one"]
    found = []
    for _, _, data, offsets in textsets.blocks(pa.array(texts)):
        start, end, row = textsets.word_bounds(data, offsets)
        h = textsets.word_hashes(data, start, end)
        found += [(int(r), bytes(data[a:b]).decode(), int(x)) for a, b, r, x in zip(start, end, row, h, strict=True)]
    assert [(r, w) for r, w, _ in found] == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    same = {}
    for _, w, x in found:
        assert same.setdefault(lower(w), x) == x
    assert len(set(same.values())) == len(same)


def test_components(spark, tmp_path):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(7, 7)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}", "c").collect()}
    assert got == {a: find(a) for a in root}


def test_components_of_forests_that_change(spark, tmp_path):
    """Links of a group are any of its spanning forests, another one each time that a task is run."""

    def trees(batches):
        for batch in batches:
            rng = random.Random(os.urandom(8))
            rows = [rng.sample((g * 100 + rng.randrange(k), g * 100 + k), 2) for g in batch.column(0).to_pylist() for k in range(1, 40)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b"])

    edges = spark.range(20).mapInArrow(trees, "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, f"file://{tmp_path}", "c").collect()}
    assert got == {g * 100 + k: g * 100 for g in range(20) for k in range(40)}


def test_lookup_with_hot_keys(spark):
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(4000)], "k long, v long")
    small = spark.createDataFrame([(i, i * 10) for i in range(0, 4000, 2)] + [(1, 10)], "k long, x long")
    got = sorted(map(tuple, lookup(big, small, ["k"]).collect()), key=lambda r: r[1])
    assert got == [(k, i, k * 10 if k == 1 or k % 2 == 0 else None) for k, i in ((1 if i % 3 else i, i) for i in range(4000))]


# -- media ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 15, 16, 17, 64, 65, 128, 1000])
def test_media_round_trip(size):
    payload = bytes(random.Random(size).randrange(256) for _ in range(64 * size))
    data = media.write_container(payload)
    (track,) = media.read_tracks(data)
    assert media.samples(data, track) == payload
    assert (track["codec"], track["duration"], len(track["keys"])) == ("raw ", len(payload), -(-size // 16))
    assert data[track["begin"][0] : track["end"][0]] == payload[:64]


def test_media_of_texts(spark):
    texts = ["", None, "é" * 40, "x" * 64, "y" * 70_000, "same", "same"]
    got = {r["doc_id"]: r for r in media.read_back(media.store_texts(frame(spark, texts))).collect()}
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert got[5]["media_sha256"] == got[6]["media_sha256"] and got[5]["feature"] == got[6]["feature"]
    stored = media.store_texts(frame(spark, ["abc"]))
    broken = stored.unionByName(stored.limit(1).select("doc_id", "n_bytes", F.lit(b"junk").alias("media"))).unionByName(stored.limit(1).select("doc_id", "n_bytes", F.lit(None).cast("binary").alias("media")))
    (row,) = media.probe(broken, "doc_id", "media").collect()
    assert row["codec"] == "raw " and row["keyframes"][0]["end"] - row["keyframes"][0]["begin"] == 64


# -- archives ---------------------------------------------------------------------------------------------


def pages(spark):
    long = "<p>" + "q" * 200
    rows = [(3, "http://a/", long), (1, None, long), (2, "http://b/ c", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (7, "u", "é" * 90_000), (8, "u", "é" * 90_000)]
    rng = random.Random(1)
    rows += [(100 + i, f"http://h/{i}", "".join(rng.choice("abcdefgh <>") for _ in range(rng.randrange(3000)))) for i in range(200)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives(spark):
    rows, df = pages(spark)
    got = {r["page_id"]: r for r in warc.archive_and_read(df).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and h == html] if len(raw) >= 100 else [page]
        first = min(same)
        want = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == page else "revisit", None if first == page else first)
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want
    assert warc.archive_and_read(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [500, 7_000, 1 << 20])
def test_any_ranges_read_every_record_once(spark, tmp_path, size):
    _, df = pages(spark)
    warc.write_archives(df, f"file://{tmp_path}")
    got = warc.read_archives(spark, f"file://{tmp_path}/archives", size)
    assert got.count() == df.count()
    assert got.select("path", "offset").distinct().count() == df.count()


def test_damaged_members_are_passed_over(tmp_path):
    good = [warc.record("response", i, "u", "d", b"x" * 500, None) for i in range(4)]
    bad = bytearray(good[1])
    bad[30] ^= 0xFF
    (tmp_path / "a").write_bytes(good[0] + bytes(bad) + b"\x1f\x8b\x08junk" + good[2] + good[3])
    with open(tmp_path / "a", "rb") as file:
        found = [warc.parse(c)[0]["warc-record-id"] for _, c in warc.records_of(file, 0, 1 << 20)]
    assert found[0] == "<urn:page:0>" and found[-2:] == ["<urn:page:2>", "<urn:page:3>"]


# -- classifiers ------------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = crc_rest(F.col("doc_id"), 3) == 1
    model = langid.train(docs, ~held)
    found = langid.predict(docs.filter(held), model)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    odd = frame(spark, ["", None, "123 !!", "A", "the of " * 50_000])
    rows = langid.predict(odd, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and rows[3]["lang_pred"] in model.languages
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[0]["own"] == "x"
    nothing = langid.train(docs.limit(0), ~held)
    assert langid.predict(odd, nothing).filter("lang_pred <> 'und'").count() == 0


def test_codewords_differ():
    for n in (2, 3, 4, 6, 7, 20):
        code = langid.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else 2)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF[:-2]}1/{t}.parquet") for t in ("documents", "labels"))
    held = crc_rest(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels, ~held)
    found = toxicity.predict(docs.filter(held).select("doc_id", "text"), model).join(labels, "doc_id")
    toxic, clean = (found.filter(f"toxic = {k}").agg(F.avg("predicted"), F.avg("score")).first() for k in (1, 0))
    assert toxic[0] > 0.75 and clean[0] < 0.03
    rows = toxicity.predict(frame(spark, ["", None, "x" * 200_000]), model).collect()
    assert len(rows) == 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    none = toxicity.train(docs, labels.limit(0), ~held)
    assert toxicity.predict(docs.limit(3), none).filter("predicted = 1").count() == 0


def test_toxicity_of_many_rare_words(spark):
    """Four hundred toxic words, each in a few documents only, of which one stands in a toxic document."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnoprstuvw", k=n))
    bad, plain = [letters(8) for _ in range(400)], [letters(7) for _ in range(3000)]
    texts, toxic = [], []
    for i in range(6000):
        text = rng.choices(plain, k=40)
        if i % 4 == 0:
            text[rng.randrange(40)] = bad[i // 4 % 400]
        texts.append(" ".join(text))
        toxic.append(int(i % 4 == 0))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(toxic)] * 2 + [(None, 1), (5, None)], "doc_id long, toxic int")
    held = crc_rest(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs.unionByName(docs), labels, ~held)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.predict(docs.filter(held), model).collect()}
    caught = [got[i] for i in got if toxic[i]]
    alarms = [got[i] for i in got if not toxic[i]]
    assert sum(caught) / len(caught) > 0.8 and sum(alarms) / len(alarms) < 0.05
    assert toxicity.predict(docs.limit(0), model).count() == 0
    empty = toxicity.train(docs.limit(0), labels, ~held)
    assert 0 <= toxicity.predict(docs.limit(1), empty).first()["score"] <= 1


# -- mixing -----------------------------------------------------------------------------------------------


def mixed(spark, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 40, 300])), rng.choice(["b", "a", None, "a", "a", "é"])) for i in range(3000)]
    rows += [(9000, None, "a"), (9001, "", None), (9002, "w " * 5000, "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix(spark):
    rows, df = mixed(spark)
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    by = {}
    for i, _, s in rows:
        by.setdefault(s, []).append(i)
    order = sorted(s for s in by if s is not None) + [None]
    total = sum(size.values())
    held = {s: sum(size[i] for i in by[s]) for s in order}
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, target = set(), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * held[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * held[s]}
        if not over:
            target = share | {s: 3 * held[s] for s in capped}
            break
        capped |= over
    for s in order:
        taken = sum(got[i]["taken"] for i in by[s])
        assert all(abs(got[i]["target"] - target[s]) < 1e-6 * total and got[i]["source_size"] == held[s] for i in by[s])
        assert abs(taken - target[s]) <= 300
    for i, n in size.items():
        rate = got[i]["target"] / max(got[i]["source_size"], 1)
        assert got[i]["size"] == n and got[i]["taken"] in (n * int(rate + 1e-9), n * (int(rate + 1e-9) + 1)) and got[i]["taken"] <= 3 * n


def test_mix_does_not_depend_on_partitions(spark):
    _, df = mixed(spark)
    a = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(3)).collect()}
    b = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7).orderBy(F.desc("doc_id"))).collect()}
    assert a == b
    assert mixing.mix(df.limit(0)).count() == 0


def test_settle_keeps_sums_and_chances():
    size = np.array([500.0, 40, 30, 30, 20, 10, 10, 5, 5, 1] * 6)
    size[::-1].sort()
    start = np.full(len(size), 0.37)
    mean = np.zeros(len(size))
    for k in range(2000):
        p = start.copy()
        left = mixing.settle(size, p, np.random.default_rng(k))
        assert abs((p * size).sum() - (start * size).sum()) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != left)
        mean += p / 2000
    assert np.abs(mean - 0.37).max() < 0.06


# -- personal data: patterns ------------------------------------------------------------------------------


def test_pattern_confident_by_candidates(spark):
    """Few seeds follow 'ref code'; identifiers that it shares with 'card no' make it confident, and its own are found."""
    shared, own = [f"k{i % 10}q{'abcdefghijklmnopqrst'[i]}" for i in range(20)], [f"m{i}z" for i in range(10)]
    texts = [f"the card no u{i}@x.org" for i in range(5)] * 10 + [f"the card no {x}" for x in shared]
    texts += [f"the ref code u{i}@x.org" for i in range(5)] + [f"the ref code {x}" for x in shared + shared + own]
    got = pii.find(frame(spark, texts).select("doc_id", "text")).filter(F.col("text").startswith("the ref code m")).collect()
    assert len(got) == 10 and {r["masked"] for r in got} == {"the ref code [EMAIL]"}


# -- language model ---------------------------------------------------------------------------------------


def test_language_model_counts_and_probabilities(spark):
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randrange(0, 80), 150)).title() for _ in range(120)] + ["", None, "é é Ü", "new unseen"]
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in pitman_yor.score(df, crc_rest(F.col("doc_id"), 5) == 1).collect()}
    tokens = {i: [w.lower() if w.isascii() else lower(w) for w in WORD.findall(t or "")] + [""] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = {}
    for i, ws in tokens.items():
        for w in ws:
            count[w] = count.get(w, 0) + (not held[i])
    total, types = sum(count.values()), sum(c > 0 for c in count.values())
    for i, ws in tokens.items():
        r = got[i]
        base = sum(np.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), total)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
    assert pitman_yor.score(df.limit(0), F.lit(False)).count() == 0


def test_language_model_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = pitman_yor.score(docs, crc_rest(F.col("doc_id"), 5) == 1).filter("held_out")
    row = held.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.avg((F.col("score") > F.col("base_score")).cast("double")).alias("better")).first()
    assert row["s"] > row["b"] and row["better"] > 0.7


def test_lm_pairs_that_chunks_share(spark):
    """Texts' pairs are counted over all chunks, whatever chunk their documents lie in, and no table holds a row for each of them."""
    rng = random.Random(9)
    texts = [" ".join(words(rng, rng.randrange(0, 60), 40)) for _ in range(90)] + ["", None]
    df, held = frame(spark, texts), F.col("doc_id") % 4 == 1
    one, many = ({r["doc_id"]: r for r in pitman_yor.score(df.repartition(n), held).collect()} for n in (1, 7))
    assert all(abs(one[i]["score"] - many[i]["score"]) < 1e-6 for i in one) and len(one) == len(many) == len(texts)
    import pyarrow as pa

    chunks, tokens = [], [[w.encode() for w in lower(t).split()] for t in texts]
    for k in range(3):
        rows = [i for i in range(len(texts)) if i % 3 == k]
        (_, row) = pitman_yor._chunk_rows(k, pa.array(rows), np.array([i % 4 == 1 for i in rows]), pa.array([texts[i] for i in rows], pa.string()).fill_null(""))
        chunks += [pitman_yor.Chunk(row.to_pylist()[0])]
    want = {}
    for i, ws in enumerate(tokens):
        for pair in zip([b"", *ws], [*ws, b""], strict=True):
            want[pair] = want.get(pair, 0) + (i % 4 != 1)
    found = {}
    for chunk in chunks:
        for key, n in zip(chunk.key.tolist(), chunk.seen.tolist(), strict=True):
            found[key] = found.get(key, 0) + n
    assert sorted(found.values()) == sorted(want.values())


def test_lm_tables_stay_small(spark, monkeypatch):
    """The tables that stand at one time never take four times the bytes of the documents' file."""
    held, path = [], Path(SF) / "documents.parquet"

    def watched(df, folder, name, **more):
        made = materialize(df, folder, name, **more)
        held.append(sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob("*.parquet")))
        return made

    monkeypatch.setattr(pitman_yor, "materialize", watched)
    assert pitman_yor.score(spark.read.parquet(str(path)), crc_rest(F.col("doc_id"), 5) == 1).columns[0] == "doc_id"
    assert 0 < max(held) < 4 * path.stat().st_size


def plain_lm(texts, held):
    """Each text's score, with all words and pairs of words in one array each."""
    import pyarrow as pa

    tokens = [[w.encode() for w in lower(t).split()] + [b""] for t in texts]
    vocabulary = sorted({w for ws in tokens for w in ws})
    number, pairs, c = {w: i for i, w in enumerate(vocabulary)}, {}, np.zeros(len(vocabulary), np.int64)
    for ws, out in zip(tokens, held, strict=True):
        for a, b in zip([b"", *ws], ws, strict=False):
            pairs[number[a], number[b]] = pairs.get((number[a], number[b]), 0) + (not out)
            c[number[b]] += not out
    (first, second), n = np.array(list(pairs)).T, np.array(list(pairs.values()))
    known = pa.array(vocabulary, pa.binary())
    ids, (key, of) = pitman_yor.word_ids(known), pitman_yor.cells_of(known)
    added = lambda at, t: np.bincount(at, weights=t, minlength=len(c)).astype(np.int64)

    def sample_of(tables, sweep):
        cell, at = np.unique(key, return_inverse=True)
        customers = np.bincount(at, weights=tables[of])
        return pitman_yor.Sample(pitman_yor.Characters(cell[customers > 0], customers[customers > 0], sweep), tables.sum())

    d, p = pitman_yor.discount_of(n), 0.0
    people, opened = added(second, np.minimum(n, 1)), added(first, np.minimum(n, 1))
    sample = sample_of(np.minimum(people, 1), 0)
    for k in range(pitman_yor.SAMPLES):
        totals = pitman_yor.Totals(people.sum(), int((c > 0).sum()), pitman_yor.discount_of(people))
        tables, base = totals.seated(known, ids, people, sample, k)
        sample.tables = tables.sum()
        word = totals.predictive(people, tables, base, sample)
        t = pitman_yor.seat(pitman_yor.Chunk.ids_of(ids, first, second), n, (1 + d * opened[first]) * word[second], d, 100 + k)
        people, opened = added(second, t), added(first, t)
        p += (n - d * t + (1 + d * opened[first]) * word[second]) / (1 + c[first]) / pitman_yor.SAMPLES
        sample = sample_of(tables, k + 1)
    p = dict(zip(pairs, np.log10(p), strict=True))
    return [sum(p[number[a], number[b]] for a, b in zip([b"", *ws], ws, strict=False)) for ws in tokens]


def test_lm_against_plain_arrays(spark, monkeypatch):
    """Parts and chunks give the scores that one array of all words and one of all pairs give."""
    monkeypatch.setattr(pitman_yor, "PART_WORDS", 5)
    monkeypatch.setattr(pitman_yor, "PART_TOKENS", 50)
    rng = random.Random(10)
    texts = [" ".join(f"{'abcdefgh'[int(rng.random() ** 3 * 8)]}{int(rng.random() ** 3 * 40)}" for _ in range(rng.randrange(90))) for _ in range(120)] + ["", None, "é Ü", "new unseen"]
    want = plain_lm(texts, [i % 5 == 1 for i in range(len(texts))])
    got = pitman_yor.score(frame(spark, texts).repartition(6), F.col("doc_id") % 5 == 1).collect()
    assert len(got) == len(texts) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 for r in got)


def test_lm_word_order(spark):
    """A text's score depends on its words' order: the trained order beats the reverse one."""
    rng = random.Random(8)
    follow = [rng.sample(range(60), 2) for _ in range(60)]

    def chain(n):
        at, out = rng.randrange(60), []
        for _ in range(n):
            out.append(f"w{at}")
            at = rng.choice(follow[at])
        return out

    held = [chain(40) for _ in range(20)]
    texts = [" ".join(chain(40)) for _ in range(200)] + [" ".join(w) for w in held] + [" ".join(w[::-1]) for w in held]
    got = {r["doc_id"]: r for r in pitman_yor.score(frame(spark, texts), F.col("doc_id") >= 200).collect()}
    for i in range(200, 220):
        assert got[i]["base_score"] == pytest.approx(got[i + 20]["base_score"])
        assert got[i]["score"] > got[i + 20]["score"] + 5
    assert sum(got[i]["score"] for i in range(200, 220)) > sum(got[i]["base_score"] for i in range(200, 220)) + 200


def test_character_model_sums_to_one():
    import pyarrow as pa

    known = pa.array([w.encode() for w in ("the", "then", "than", "at", "ate", "")], pa.binary())
    key, _ = pitman_yor.cells_of(known)
    cells, n = np.unique(key, return_counts=True)
    model = pitman_yor.Characters(cells, n.astype(float), 1)
    context = int.from_bytes(b"\0\0th", "big")
    p = model._probability((context << 9) | np.arange(pitman_yor.SYMBOLS), pitman_yor.ORDER)
    assert abs(p.sum() - 1) < 1e-9 and p[ord("e")] > p[ord("z")]


def test_seating_is_about_right():
    """Mean tables against one customer at a time."""
    rng = np.random.default_rng(1)
    n, pull, d = 200, 3.0, 0.5
    plain = []
    for _ in range(400):
        t = 1
        for seated in range(1, n):
            t += rng.random() < pull / (pull + seated - d * t)
        plain.append(t)
    ids = np.arange(4000, dtype=np.uint64)
    fast = pitman_yor.seat(ids, np.full(4000, n), np.full(4000, pull), d, 1)
    assert abs(fast.mean() - np.mean(plain)) < 0.5 and fast.min() >= 1


# -- personal data ----------------------------------------------------------------------------------------

TEXT = "Mail Bo.b+1@mail.example.com, not @x or a@b; from 10.0.0.256 and 192.168.1.77 or 1.2.3.4.5. Card 4111 1111-1111 1111, 4111111111111112; call +1 (555) 010-9999 or +12 34. é 8.8.8.8"


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans(spark):
    texts = [TEXT, "", None, "nothing", "1" * 5000 + "@", TEXT * 40]
    got = {r["doc_id"]: r for r in pii.digests(pii.find(frame(spark, texts))).collect()}
    for d, t in enumerate(texts):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t or ""))
        assert got[d]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[d]["spans"] == want
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in plain_spans(t or "")) for k in pii.KINDS]
    assert pii.find(frame(spark, texts).limit(0)).count() == 0


def test_confident_contexts_find_more(spark):
    rng = random.Random(3)
    seen = [f"text here ; reach me user{i}@mail{i}.example.org today" for i in range(30)]
    unseen = ["so reach me user77[at]mail.org now", "reach me soon"]
    clean = [" ".join(words(rng, 60)) + f" on the {i}.example" for i in range(40)]
    rows = pii.find(frame(spark, seen + unseen + clean)).collect()
    more = {r["doc_id"]: r["text"][s["start"] : s["end"]] for r in rows for s in r["more_spans"]}
    assert more == {30: "user77[at]mail.org"}
    assert [r["masked"] for r in rows if r["doc_id"] == 30] == ["so reach me [EMAIL] now"]
    assert [r["own"] for r in rows] == ["x"] * len(rows)


# -- pieces -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.MODEL_PATH)


def brute_segmentations(v, byte_score, text, n):
    s = "▁" + text.replace("▁", "\U0010ffff").replace(" ", "▁")
    number = {p: i for i, p in enumerate(v.pieces) if v.usable[i]}
    best = [[] for _ in range(len(s) + 1)]
    best[0] = [0.0]
    for end in range(1, len(s) + 1):
        found = [x + v.scores[number[s[a:end]]] for a in range(max(0, end - 16), end) if s[a:end] in number for x in best[a]]
        if s[end - 1] not in number:
            size = len(("▁" if s[end - 1] == "\U0010ffff" else s[end - 1]).encode())
            found += [x + byte_score * size for x in best[end - 1]]
        best[end] = sorted(found, reverse=True)[:n]
    return best[-1]


TEXTS = ["Hello world", "  a  b\n", "ab▁c", "\tx\n\ny ", "日本語 é😀", "a", "internationalization of  the\nfoo", "x" * 300, "the the the the", "'s <s> </s> <0x41>"]


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_nbest_against_all_paths(vocabulary, n):
    lattice = pieces.Lattice(vocabulary)
    pieces.Block(lattice, TEXTS[:4])  # some segments are known, others new
    block = pieces.Block(lattice, TEXTS)
    flat, start = block.ids()
    for i, (t, found) in enumerate(zip(TEXTS, block.nbest(n), strict=True)):
        want = brute_segmentations(vocabulary, lattice.byte_score, t, n)
        assert np.allclose([s for s, _ in found], want, rtol=1e-9)
        mine = memoryview(flat[start[i] : start[i + 1]].astype("<i4").tobytes())
        ids = [np.frombuffer(b"".join(block.path(i, mine, c)), "<i4") for _, c in found]
        assert all(lattice.decode(x) == t.encode() for x in ids)
        assert len({x.tobytes() for x in ids}) == len(ids)


def test_encode_and_decode(spark):
    texts = [*TEXTS, "", None, "word " * 30_000]
    out = pieces.decode(pieces.encode(frame(spark, texts))).orderBy("doc_id").collect()
    for t, r in zip(texts, out, strict=True):
        assert r["decoded"] == (t or "") and r["round_trip"] and r["n_pieces"] == len(r["ids"]) and r["own"] == "x"
        assert r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True) and len(r["nbest_sha256"]) == len(r["nbest_scores"])
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert pieces.encode(frame(spark, texts).limit(0)).count() == 0


def test_all_best_segmentations_are_given_and_decoded(spark, vocabulary):
    """The ids of the n best ones themselves, not their digests alone; each decodes to the text."""
    lattice = pieces.Lattice(vocabulary)
    texts = [*TEXTS, "", None]
    for t, r in zip(texts, pieces.nbest_ids(pieces.encode(frame(spark, texts), n=5)).orderBy("doc_id").collect(), strict=True):
        ways = [np.array(x, "<i4") for x in r["nbest_ids"]]
        assert len(ways) == len(brute_segmentations(vocabulary, lattice.byte_score, t, 5)) if t else len(ways) == 1
        assert ways[0].tolist() == r["ids"] and r["round_trip"] and all(lattice.decode(x) == (t or "").encode() for x in ways)
        assert [hashlib.sha256(x.tobytes()).hexdigest() for x in ways] == r["nbest_sha256"]


def test_pieces_of_any_vocabulary_are_in_the_lattice():
    """Pieces over a space inside, and pieces of characters that aren't pieces themselves, against all paths."""
    made = {"▁": -3.0, "a": -4.0, "b": -4.5, "▁a": -5.0, "a▁b": -2.0, "b▁▁a": -2.5, "cd": -1.5, "a▁": -6.0, "cé": -2.0, "▁a▁b": -2.25}
    v = pieces.Vocabulary(["<unk>", *made, *(f"<0x{b:02X}>" for b in range(256))], [0.0, *made.values(), *[0.0] * 256], [len(made) + 1 + b for b in range(256)], [False, *[True] * len(made), *[False] * 256])
    lattice = pieces.Lattice(v)
    texts = ["a b a", "ab  a b", "cd c", "cé acd", "z", "d cd a b", "é▁cé a  b a b"]
    block = pieces.Block(lattice, texts)
    flat, start = block.ids()
    for i, (t, found) in enumerate(zip(texts, block.nbest(6), strict=True)):
        assert np.allclose([s for s, _ in found], brute_segmentations(v, lattice.byte_score, t, 6), rtol=1e-6)
        mine = memoryview(flat[start[i] : start[i + 1]].astype("<i4").tobytes())
        ids = [np.frombuffer(b"".join(block.path(i, mine, c)), "<i4") for _, c in found]
        assert all(lattice.decode(x) == t.encode() for x in ids) and len({x.tobytes() for x in ids}) == len(ids)


# -- neighbours -------------------------------------------------------------------------------------------


def brute_neighbours(vectors, k):
    usable = {i: np.array(v, np.float64) for i, v in vectors if v is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in usable.items():
        if i % 50 == 0:
            score = sorted((-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), j) for j, w in usable.items() if j != i and len(v) == len(w))
            if score:
                out[i] = score[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(600)]
    vectors += [(600 + i, vectors[7][1]) for i in range(100)] + [(800, None), (850, [0.0] * 16), (900, [float("nan")] * 16), (1000, [None] * 16)]
    # scaled copies tie with the query itself; rows of another length are compared with each other alone
    vectors += [(1040 + i, [x * 2.0 ** (i % 9) for x in vectors[50][1]]) for i in range(40)]
    vectors += [(1100 + i, rng.standard_normal(3).astype(np.float32).tolist()) for i in range(60)]
    df = spark.createDataFrame([(i, v, 0.5, i, 1) for i, v in vectors + vectors[:3]], "vec_id long, embedding array<float>, score double, key long, rank int")
    got = {}
    for r in forest.nearest(df, F.col("vec_id") % 50 == 0, search_share=16.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    want = brute_neighbours(vectors, 5)
    assert set(got) == set(want)
    for q, rows in want.items():
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in rows], atol=1e-12) and [j for _, j in got[q]] == [j for _, j in rows]
    assert [j for _, j in got[50]] == [1040, 1041, 1042, 1043, 1044]
    few = forest.nearest(df.filter("vec_id < 3"), F.col("vec_id") % 50 == 0)
    assert few.count() == 2 and forest.nearest(df.limit(0), F.lit(True)).count() == 0


def test_forest_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in docs.collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in forest.nearest(docs, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in got:
        s = x @ x[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -9
        hit += len(got[q] & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hit / (5 * len(got)) >= 0.9


def test_bootstrapping_finds_planted_identifiers(spark):
    """Precision and recall of unseen identifiers, with and without digits; found entities induce further patterns."""
    rng = random.Random(11)
    name = lambda: "".join(rng.choices("abcdefghij", k=7))
    texts, want = [], {}

    def add(left, value, right, hidden):
        before, after = " ".join(words(rng, 20)), " ".join(words(rng, 20))
        if hidden:
            start = len(f"{before} {left} ")
            want[len(texts)] = (start, start + len(value))
        texts.append(f"{before} {left} {value} {right} {after}".replace("  ", " "))

    hidden = [f"{name()}[at]{name()}[dot]org" for _ in range(30)]
    for i in range(40):
        add("mail me:", f"{name()}{i}@{name()}.org", "soon please", False)
        add("call office", f"+1 (555) 010-{1000 + i}", "after noon", False)
    for v in hidden:
        add("mail me:", v, "soon please", True)  # without a digit
    for i in range(20):
        add("call office", f"555.010.{2000 + i}", "after noon", True)
    for v in hidden + [f"{name()}[at]{name()}[dot]net" for _ in range(5)]:
        add("kontakt über", v, "bitte schreiben", True)  # a context that no fixed pattern knows
    for i in range(100):
        add("chapter", f"{i}.{i}a", "tells of", False)  # odd words in contexts of their own
        add("mail", "me: never", "soon", False) if i < 4 else None
    order = list(range(len(texts)))
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["more_spans"]] for r in pii.find(frame(spark, texts)).collect()}
    found = {(d, s) for d in order for s in got[d]}
    right = {(d, s) for d, s in want.items()}
    assert len(found & right) / len(right) >= 0.95 and len(found & right) / len(found) >= 0.99


def test_personal_data_odd_rows(spark):
    """Null ids, repeated rows and odd column names stay; slices of patterns find what one pass finds."""
    texts = [f"please reach me user{i}@mail{i}.example.org today ok" for i in range(12)] + ["please reach me user77[at]mail.org today ok", None, ""]
    df = frame(spark, texts).withColumn("a`b", F.lit(1)).withColumn("masked", F.lit("x"))
    df = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    rows = pii.find(df).collect()
    assert len(rows) == 3 * len(texts) and all(r["a`b"] == 1 for r in rows)
    assert sum(len(r["more_spans"]) for r in rows) == 3 and sum(r["masked"] is None for r in rows) == 3
