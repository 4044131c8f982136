"""Models that SQL can't express against plain programs over the same rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from varloom.llm import entries, langid, pii, toxicity

DATA = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


# -- language ---------------------------------------------------------------------------------------------


def plain_grams(text):
    text = text.lower()
    kept = "".join((ch if ch.isalpha() else " ") for i, ch in enumerate(text) if ch.isalpha() or (i and text[i - 1].isalpha()))
    if not kept:
        return []
    kept, out = f" {kept} ", []
    for order in (1, 2, 3):
        for i in range(len(kept) - order + 1):
            h = order
            for ch in kept[i : i + order]:
                h = (h + ord(ch)) * 0x9E3779B97F4A7C15 & MASK
                h ^= h >> 29
            out.append(h % langid.BUCKETS)
    return out


def test_languages_match_a_plain_program(spark):
    """Counts, bits, their reliability and loss-weighted decoding, over a whole table."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    grams = {d: plain_grams(t or "") for d, t, _ in rows}
    learned = [(d, lang) for d, t, lang in rows if zlib.crc32(str(d).encode()) % 3 != 1 and lang is not None and t is not None]
    assert len(learned) < langid.CALIBRATION_DOCS  # so all of them calibrate
    languages = sorted({lang for _, lang in learned})
    code = langid.codewords(len(languages))
    counts = {lang: Counter() for lang in languages}
    for d, lang in learned:
        counts[lang].update(grams[d])
    share = np.array([[(counts[lang][g] + 0.5) / (counts[lang].total() + 0.5 * langid.BUCKETS) for g in range(langid.BUCKETS)] for lang in languages])
    weights = np.array([np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0)) for b in range(code.shape[1])])
    margin = {d: weights[:, g].sum(1) / len(g) ** 0.5 for d, g in grams.items() if g}
    n, right, size = Counter(), defaultdict(lambda: np.zeros(code.shape[1])), np.zeros(code.shape[1])
    for d, lang in learned:
        if d in margin:
            n[lang] += 1
            right[lang] += margin[d] * code[languages.index(lang)] > 0
            size += abs(margin[d])
    sure = np.array([np.clip((right[lang] + 1) / (n[lang] + 2), 0.05, 1) for lang in languages])
    trust, scale = sure / sure.sum(1, keepdims=True), size / n.total() / 1.5
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in entries.queries()["op4_language_id"](spark, DATA).collect()}
    assert set(got) == set(grams)
    for d in grams:
        if d not in margin:
            assert got[d] == ("und", 0.0)
            continue
        loss = [sum(trust[k, b] * np.exp(-min(max(code[k, b] * margin[d][b] / scale[b], -4), 4)) for b in range(code.shape[1])) for k in range(len(languages))]
        best, second = sorted(loss)[:2]
        assert loss[languages.index(got[d][0])] - best < 1e-5
        assert abs(got[d][1] - 1 / sum(np.exp(-3 * (x - best) / second) for x in loss)) < 1e-3


# -- toxicity ---------------------------------------------------------------------------------------------


def plain_features(text):
    text = re.sub("[ \t-\r]", " ", f" {text.lower()} ")
    return {text[i : i + n] for n in (4, 5, 6) for i in range(len(text) - n + 1) if " " not in text[i + 1 : i + n - 1]}


def test_toxicity_fit_is_the_least_loss(spark, monkeypatch):
    """The fit against Newton's method, run to the end on a dense matrix of n-grams that aren't hashed.

    Carried on, the fit comes to the same scores; by default it stops after STEPS steps, within 0.1 of them here.
    """
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(4, 8)))
    bad, plain = [word() for _ in range(6)], [word() for _ in range(30)]
    rows = []
    for i in range(240):
        toxic = int(i % 4 == 0)
        text = rng.choices(plain, k=12) + (rng.choices(bad, k=2) if toxic and i % 12 else []) + (rng.choices(bad, k=1) if not toxic and i % 20 == 1 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text).upper() if i % 5 == 0 else " ".join(text), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    scores = []
    for steps in (toxicity.STEPS, 100):
        monkeypatch.setattr(toxicity, "STEPS", steps)
        model = toxicity.train(docs, labels, F.lit(True))
        scores.append({r["doc_id"]: r["score"] for r in toxicity.predict(docs, model).collect()})

    y = np.array([r[2] for r in rows], float)
    found = [plain_features(r[1]) for r in rows]
    names = sorted(set().union(*found))
    has = np.array([[g in f for g in names] for f in found], float)
    up, down = has[y == 1].sum(0), has[y == 0].sum(0)
    ratio = np.log((up + 1) / (y.sum() + 2)) - np.log((down + 1) / ((1 - y).sum() + 2))
    ratio = np.sign(ratio) * np.maximum(0, abs(ratio) - np.sqrt(1 / (up + 1) + 1 / (down + 1)))
    x = np.column_stack(((has * ratio)[:, ratio != 0], np.ones(len(rows))))
    ridge = np.full(x.shape[1], 0.3)
    ridge[-1] = 0

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + (ridge * w * w).sum() / 2

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w - size * step
    best = 1 / (1 + np.exp(-x @ w))
    short, whole = (np.array([got[r[0]] for r in rows]) for got in scores)
    assert (ratio != 0).sum() == len(model.places) > 50
    assert abs(best - whole).max() < 0.02 and best.min() < 0.1 and best.max() > 0.8
    assert abs(best - short).max() < 0.1


# -- personal data ----------------------------------------------------------------------------------------


class Plain:
    """The pattern-instance graph of some texts, in dictionaries."""

    def __init__(self, texts):
        self.texts, self.words, self.places, self.seeds, self.candidates = texts, [], [], [], []
        for row, text in enumerate(texts):
            found = [m.span() for m in re.finditer("[^ \t-\r]+", text)]
            self.places.append(found)
            self.words.append([re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]) for a, b in found])
            covered = set()
            for kind, a, b in pii.base_spans(text):
                i, j = (max(k for k, (s, _) in enumerate(found) if s <= at) for at in (a, b - 1))
                covered |= set(range(i, j + 1))
                if set(text[found[i][0] : a] + text[b : found[j][1]]) <= set(pii.EDGE):
                    self.seeds.append((row, kind, i, j, a, b))
            for i, (s, e) in enumerate(found):
                raw = text[s:e]
                runs = re.findall(rb"[0-9A-Za-z\x80-\xff'-]+", raw.encode())
                if i in covered or (len(runs) < 2 and not re.search("[0-9]", raw)):
                    continue
                value = raw.strip(pii.EDGE)
                a = s + len(raw) - len(raw.lstrip(pii.EDGE))
                self.candidates += [(row, kind, i, i, a, a + len(value)) for kind in pii.fits(value)]

    def patterns(self, row, i, j):
        w = self.words[row]
        return [(kind, w[a], w[b]) for kind, (a, b) in enumerate(((i - 2, i - 1), (i - 1, j + 1), (j + 1, j + 2))) if a >= 0 and b < len(w)]

    def confident(self):
        graph, seed, totals = defaultdict(Counter), set(), Counter(p for row, w in enumerate(self.words) for i in range(len(w)) for p in self.patterns(row, i, i))
        for of, is_seed in ((self.seeds, True), (self.candidates, False)):
            for row, kind, i, j, a, b in of:
                entity = self.texts[row][a:b]
                for p in self.patterns(row, i, j):
                    graph[p, kind][entity] += 1
                    if is_seed:
                        seed.add((p, kind, entity))
        graph = {k: v for k, v in graph.items() if len(v) >= 5}
        score = None
        for _ in range(4):
            best = defaultdict(float)
            for (p, kind), found in graph.items() if score else ():
                for entity in found:
                    if (p, kind, entity) not in seed:
                        best[entity, kind] = max(best[entity, kind], score[p, kind])
            new = {}
            for (p, kind), found in graph.items():
                belief = {e: 1.0 if (p, kind, e) in seed else best[e, kind] for e in found}
                support = sum(b >= 0.8 for b in belief.values())
                new[p, kind] = sum(n * belief[e] for e, n in found.items()) / max(found.total(), totals[p]) if support >= 5 else 0.0
            score = new
        sure = {}
        for (p, kind), s in score.items():
            if s >= 0.8:
                sure[p] = max(sure.get(p, (0.0, -9)), (s, -kind))
        return {p: (-kind, s) for p, (s, kind) in sure.items()}

    def more(self):
        sure, best = self.confident(), {}
        for row, kind, i, j, a, b in self.candidates:
            for p in self.patterns(row, i, j):
                if sure.get(p, (None,))[0] == kind:
                    best[row, a, b] = max(best.get((row, a, b), (0.0, -9)), (sure[p][1], -kind))
        return {(row, pii.KINDS[-kind], a, b) for (row, a, b), (_, kind) in best.items()}


def test_pattern_scores_match_a_plain_program(spark):
    """Confident patterns with their scores, and all added spans: identifiers in good, mixed and useless contexts."""
    rng = random.Random(21)
    name = lambda: "".join(rng.choices("abcdefghé", k=6))
    some = lambda: " ".join(rng.choices(["alpha", "beta", "Gamma,", "delta.", "über"], k=rng.randrange(0, 6)))
    hidden = [f"{name()}(at){name()}.org" for _ in range(6)]
    texts = ["", " ", "mail me"]
    for i in range(30):
        texts.append(f"{some()} mail me: {name().replace("é", "e")}{i}@x.org soon please {some()}")
        texts.append(f"{some()} Call office \"+1 (555) 010-{1000 + i}\", after noon {some()}")
        texts.append(f"{some()} now and {'y%d@z.org' % i if i % 3 else 'then'} again or {some()}")
        texts.append(f"{some()} seen at 10.0.0.{i} by {name()} {some()}")
    for v in hidden:
        texts += [f"{some()} mail me: {v} soon please {some()}", f"{some()} kontakt über {v} bitte schreiben {some()}"]
    for i in range(8):
        texts += [f"call office 555.010.{2000 + i} after noon", f"kontakt unter q{i}(at)r.net bitte lesen", f"chapter {i}.{i}a tells of", f"now and z{i}.z again or"]
    rng.shuffle(texts)
    plain = Plain(texts)
    want, more = plain.confident(), plain.more()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [(r["kind"], round(r["score"], 9)) for r in pii.learn(docs).collect()]
    assert Counter(got) == Counter((k, round(s, 9)) for k, s in want.values())
    found = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in pii.find(docs).collect() for s in r["more_spans"]}
    assert found == more and len(more) > 15 and len({s for _, s in want.values()}) > 2
