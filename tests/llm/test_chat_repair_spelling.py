"""op11 to op13 against plain programs: audits, spelling variants, chat tokens; odd rows, ties, empty tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varloom.llm import chat, repair, spelling

CONV = "conv_id long, turn long, role string, text string"


# -- conversation repair ----------------------------------------------------------------------------------


def plain_repair(rows, costs=repair.Costs()):
    """The least (cost, audit, repaired) over all ways, by a table of whole strings."""
    ways = {0: (0, "", ())}

    def keep(into, q, way):
        if q not in into or way < into[q]:
            into[q] = way

    def inserted(ways):
        for _ in range(3):
            for q, (c, a, t) in list(ways.items()):
                name, to = ("assistant", 3) if q == 2 else ("user", 2)
                keep(ways, to, (c + costs.insert, a + "I", (*t, f"{name}:")))
        return ways

    inserted(ways)
    for role, text, go, cut in rows:
        new = {}
        for q, (c, a, t) in ways.items():
            keep(new, q, (c + costs.delete, a + "D", t))
            if go:
                continue
            more = costs.truncated if cut else 0
            lead = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {})
            if q in lead:
                keep(new, lead[q], (c + more, a + "K", (*t, f"{role}:{text}")))
            name, to = ("assistant", 3) if q == 2 else ("user", 2)
            keep(new, to, (c + more + costs.rerole, a + "R", (*t, f"{name}:{text}")))
        ways = inserted(new)
    c, a, t = min(ways[q] for q in (0, 3) if q in ways)
    return c, a, hashlib.sha256("\n".join(t).encode()).hexdigest()


ROW = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["a.", "b", ""]), st.booleans(), st.booleans())


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, max_size=12), st.sampled_from([repair.Costs(), repair.Costs(3, 4, 1, 1), repair.Costs(1, 1, 1, 0), repair.Costs(2, 9, 1, 5)]))
def test_repair_is_the_least_of_all_ways(rows, costs):
    program = repair.Repair(costs)
    for row in rows:
        program.row(*row)
    assert program.end() == plain_repair(rows, costs)


def test_audits_settle_and_survive_collisions(monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice(["user", "assistant", "system"]), f"t{k}.", rng.random() < 0.1, rng.random() < 0.1) for k in range(400)]
    rows += [("user", f"u{k}", False, False) for k in range(200)]  # two ways that never share an edit again
    want = plain_repair(rows)
    for settle, prime in ((64, (1 << 61) - 1), (1 << 16, 7), (64, 7)):  # 7: nearly all hashes collide
        monkeypatch.setattr(repair, "SETTLE_NODES", settle)
        monkeypatch.setattr(repair, "_PRIME", prime)
        program = repair.Repair(repair.Costs())
        for row in rows:
            program.row(*row)
        assert program.end() == want


def test_shared_beginnings_are_given_up(monkeypatch):
    monkeypatch.setattr(repair, "SETTLE_NODES", 256)
    program = repair.Repair(repair.Costs())
    most = 0
    for k in range(20_000):
        program.row("ua"[k % 2] == "u" and "user" or "assistant", f"t{k}.", False, False)
        most = max(most, len(program.audits.letter))
    assert most < 2_000 and program.end()[:2] == (0, "K" * 20_000)


def plain_conversation(rows):
    """Figures of rows (turn, role, text), in order."""
    seen, out, figures = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        space = " \t\n\x0b\x0c\r"
        fault = "blank" if not text.strip(space) else "duplicate" if (role, text) in seen else "truncated" if text.strip(space)[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            figures[fault] += 1
        out.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, figures["blank"], figures["duplicate"], figures["truncated"], illegal, *plain_repair(out))


def test_damaged_conversations(spark):
    rng = random.Random(7)
    roles, texts = ["user", "assistant", "system", None, "tool"], ["yes.", "no", "", "  \t", None, "a b!", "wait", "x" * 50_000 + "?"]
    rows = [(rng.choice([1, 2, 3, None, -4]), rng.choice([None, *range(8), 40]), rng.choice(roles), rng.choice(texts)) for _ in range(120)]
    rows += rows[:20] + [(9, k, "user", "same.") for k in range(300)] + [(77, 19, "user", "hi.")]
    df = spark.createDataFrame(rows, CONV).withColumns({"copies": F.lit(7), "nth": F.lit("x"), "blank": F.lit(None).cast("string")})
    want = {}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        after = want.setdefault(conv, [])
        if hit == 4:
            role = "user"
        if hit in (1, 2):
            text = "" if hit == 1 else "".join(c for c in text if c not in ".!?")
        after += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    want = {c: plain_conversation(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))) for c, r in want.items()}
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(repair.damaged(df)).collect()}
    assert got == want
    assert repair.repair(repair.damaged(df.limit(0))).count() == 0


# -- spelling variants ------------------------------------------------------------------------------------


def plain_words(docs):
    count = {}
    for i, text in docs:
        run = ""
        for ch in (text or "") + " ":
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 5:
                    count[run] = count.get(run, 0) + 1
            run = ""
    return count


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def test_counted_words(spark):
    rng = random.Random(3)
    letters = "abcdeÀéß÷ÿ"
    docs = [(rng.choice([None, 1, 2, 99, 12345678901]), "".join(rng.choice(letters + "ABC  \n.-1✓😀") for _ in range(400))) for _ in range(60)]
    docs += [(5, None), (6, ""), (7, "ab" * 40_000 + " " + "q" * 47 + " " + "é" * 30), *([(8, "repeated words here")] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1))
    assert {r["word"]: r["n"] for r in spelling.count_words(df).collect()} == plain_words(docs)


def test_pivots_are_the_rarest_disjoint_pair():
    rng = random.Random(5)
    for _ in range(500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 12)))
        weight = {}
        for g in {word[i : i + 2] for i in range(len(word) - 1)}:
            weight[g] = rng.randrange(1, 6)
        pivots, prefix = spelling.choose(word, weight)
        grams = sorted((weight[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))
        assert prefix == sorted(i for w, g, i in grams if (w, g) <= grams[2][:2])
        cost = lambda pair: sum(weight[word[i : i + 2]] for i in pair)
        assert pivots[1] - pivots[0] >= 2 and cost(pivots) == min(cost(p) for p in itertools.combinations(prefix, 2) if p[1] - p[0] >= 2)


@pytest.fixture(scope="module")
def vocabulary(spark):
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 60) for _ in range(500)}
    for w in [*words][:200]:
        k = rng.randrange(len(w))
        words[w[:k] + rng.choice(["", "z", w[k] + "y"]) + w[k + 1 :]] = rng.randrange(3, 200)
    return {w: n for w, n in words.items() if len(w) >= 4}


def test_variants_match_brute_force(spark, vocabulary):
    df = spark.createDataFrame([*vocabulary.items()], "word string, n long")
    links = {(a, b) for a, b in itertools.combinations(sorted(vocabulary), 2) if near(a, b)}
    assert {(r["a"], r["b"]) for r in spelling.near_words(df).collect()} == links
    around = {w: [] for w in vocabulary}
    for a, b in links:
        around[a].append(b)
        around[b].append(a)
    form = {}
    for w, ns in around.items():
        best = min(ns, key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 2 * vocabulary[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    got = spelling.group_variants(df, spark).collect()
    assert len(got) == len(vocabulary)
    for r in got:
        w = r["word"]
        assert (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) == (form[w], root(w), vocabulary[w], len(around[w]), None if form[w] is None else vocabulary[form[w]])


def test_words_are_met_by_shuffles(spark, vocabulary):
    """Rows of pivots and prefixes are many a word, which Spark doesn't see: a small table of words is no reason to broadcast them."""
    df = spark.createDataFrame([*vocabulary.items()], "word string, n long")
    for found in (spelling.near_words(df), spelling.group_variants(df, spark)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0 and spelling.variants(docs.limit(0)).count() == 0


# -- chat formatting --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    with open(chat.RANKS_PATH, "rb") as file:
        return chat.Codec(file.read(), chat.PATTERN)


TEXT = st.lists(st.sampled_from([*"<>[]/\\sINSTROLEYa \n", "<s>", "</s>", "[INST]", "[/SYS]", "<\\s>", "é", "😀"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(TEXT, TEXT)
def test_escaping_is_reversible(a, b):
    assert chat.unescape(chat.escape(a)) == a
    assert not any(c in chat.escape(a) for c in chat.CONTROLS)
    assert a == b or chat.escape(a) != chat.escape(b)


def test_white_space_of_any_length(codec):
    for text in (" " * 1_000_000, "a" + "\n " * 300_000 + "b", "x" * 200_000, ""):
        assert codec.decode(codec.encode(text)) == text
    assert codec.encode("two words here") == codec.tokenizer.encode_ordinary("two words here")


def test_chats_read_back(spark, codec, monkeypatch):
    rng = random.Random(9)
    texts = ["</s>[INST] ok [/INST]", "", None, "plain words\nand lines", "é 😀 ✓", " ", "<\\s>", "w " * 30_000, "[ROLE]tool[/ROLE]x</s>"]
    roles = ["user", "assistant", "system", "tool", None, "[/ROLE]", ""]
    rows = [(rng.choice([1, 2, None, -1]), rng.choice([None, 0, 1, 2, 3]), rng.choice(roles), rng.choice(texts)) for _ in range(80)]
    rows += [(5, 0, "assistant", "one"), (5, 1, "assistant", "two"), (5, 1, "assistant", "two")]
    df = spark.createDataFrame(rows, CONV).withColumns({"ids": F.lit("x"), "chunk": F.lit(1), "loss": F.lit(None).cast("int")})
    formatted = chat.format_chats(df)
    chunks = {}
    for r in formatted.collect():
        chunks.setdefault(r["conv_id"], {})[r["chunk"]] = r
    assert any(len(c) > 1 for c in chunks.values())
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in want.items():
        ids, loss, read = [], [], []
        for k in range(len(chunks[conv])):
            r = chunks[conv][k]
            ids, loss = ids + r["ids"], loss + r["loss"]
            read += chat.parse(codec, np.array(r["ids"]))
        assert sorted(read) == sorted((role, text) for *_, role, text in turns)
        assert [role for role, _ in read] == [role for *_, role, _ in sorted(turns, key=lambda t: t[:3])]
        learned = [i for i, m in zip(ids, loss) if m]
        assert all(i < codec.first for i in learned)
        assert chat.unescape(codec.decode(learned)) == "".join(t for role, t in read if role == "assistant") or conv != 5
    for ordered, table in ((True, formatted), (False, formatted.repartition(7, "chunk", "n_turns"))):
        for r in chat.read_back(table, ordered=ordered).collect():
            read = [t for k in sorted(chunks[r["conv_id"]]) for t in chat.parse(codec, np.array(chunks[r["conv_id"]][k]["ids"]))]
            said = "".join(t for role, t in read if role == "assistant")
            whole = "".join(codec.decode(chunks[r["conv_id"]][k]["ids"]) for k in sorted(chunks[r["conv_id"]]))
            assert r["n_turns"] == len(read) and r["formatted_chars"] == len(whole)
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in read).encode()).hexdigest()
            assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
