"""Queries and the pipeline against plain Python on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import bpe, mixing, pu_quality, quality_rules, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_token_counts_from_texts(spark, library):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    real = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = token_counts.op5_token_counts(spark, SF).collect()
    assert {r["n_tokens"]: r["n_docs"] for r in got} == Counter(real)
    for r in got:
        at = r["n_tokens"]
        assert r["docs_ge"] == sum(n >= at for n in real) and r["tokens_ge"] == sum(n for n in real if n >= at) and r["docs_cut"] == sum(n > at for n in real)
        assert r["truncated_total"] == sum(min(n, at) for n in real) and r["docs_total"] == len(real) and r["tokens_total"] == sum(real)
    odd = spark.createDataFrame([(None,), ("",), ("a b",), ("a b",)], "text string")
    assert [r["n_tokens"] for r in token_counts.encoded_lengths(odd).orderBy("n_tokens").collect()] == [0, 0, 2, 2]


def risk(w, b, pos, unl, prior):
    """Non-negative risk of logistic loss, written out."""
    zp, zu = w[pos].sum(axis=1) + b, w[unl].sum(axis=1) + b
    plus, minus = lambda z: np.logaddexp(0, -z), lambda z: np.logaddexp(0, z)
    return prior * plus(zp).mean() + max(0.0, minus(zu).mean() - prior * minus(zp).mean())


def test_risk_is_as_low_as_a_direct_minimisation_finds():
    rng = np.random.default_rng(5)
    good, bad = lambda n: np.minimum(rng.poisson(1.0, (n, 2)), 3), lambda n: np.minimum(rng.poisson(2.5, (n, 2)), 3)
    flat = lambda x: x + np.array([0, 4])
    pos, unl = flat(good(600)), flat(np.concatenate([good(700), bad(300)]))
    ours = risk(*pu_quality._minimise(pos, unl, 8, 0.7), pos, unl, 0.7)
    # Coordinate search from zero, with ever smaller steps.
    at, best, step = np.zeros(9), risk(np.zeros(8), 0.0, pos, unl, 0.7), 1.0
    while step > 1e-3:
        moved = False
        for k in range(9):
            for d in (step, -step):
                to = at.copy()
                to[k] += d
                if (r := risk(to[:8], to[8], pos, unl, 0.7)) < best - 1e-9:
                    at, best, moved = to, r, True
        step = step if moved else step / 2
    assert ours <= best + 0.01


def test_prior_by_the_best_bin():
    rng = np.random.default_rng(6)
    for true in (0.3, 0.6, 0.9):
        pos, unl = rng.normal(2, 1, 6000), np.concatenate([rng.normal(2, 1, int(6000 * true)), rng.normal(-2, 1, 6000 - int(6000 * true))])
        cuts = np.quantile(pos, np.linspace(0, 0.95, 96))
        ratios = [(unl >= c).mean() / (pos >= c).mean() for c in cuts]
        got = pu_quality.estimate_prior(pos, unl)
        assert min(ratios) - pu_quality.LEEWAY - 0.03 <= got <= true + 0.03


def test_classifier_on_held_out_rows(spark):
    """The query at its own scale of production parameters: held-out ranking on the table."""
    out = pu_quality.op4_pu_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality is not null")
    rows = [(r["score"], r["quality"]) for r in out.filter("held_out").join(labels, "doc_id").collect()]
    good, bad = [s for s, q in rows if q == 1], [s for s, q in rows if q == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.95 and np.mean([s >= pu_quality.CUT for s in good]) > 0.95


# Mixing, document by document.


def plain_exponent(tokens, entropy, repetition):
    """The exponent and budget of mixing.exponent, by bisection."""
    total = sum(tokens.values())
    x = {s: math.log(t / total) for s, t in tokens.items() if t}

    def state(a):
        z = sum(math.exp(v * a) for v in x.values())
        w = {s: math.exp(v * a) / z for s, v in x.items()}
        budget = max(math.exp(v) / w[s] for s, v in x.items())
        h = -sum(p * math.log(p) for p in w.values()) / math.log(len(x)) if len(x) > 1 else 1.0
        return h, budget * max(w[s] / math.exp(v) for s, v in x.items()), budget

    def last(holds):
        if not holds(0.0):
            return 0.0
        if holds(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return hi

    a = round(max(last(lambda a: state(a)[0] >= entropy), last(lambda a: state(a)[1] > repetition)), 6)
    return a, state(a)[2]


def plain_copies(rows, alpha, passes, block_docs, block_at):
    """rows: (key, source, tokens, spot); how often each is drawn, by whole passes and a permutation of blocks."""
    tokens, docs = defaultdict(int), defaultdict(int)
    for _, s, t, _ in rows:
        tokens[s] += t
        docs[s] += 1
    total = sum(tokens.values())
    z = sum((t / total) ** alpha for t in tokens.values() if t)
    copies = {}
    for s in docs:
        mine = [r for r in rows if r[1] == s]
        blocks = -(-docs[s] // block_docs)
        weight = (tokens[s] / total) ** alpha / z if tokens[s] else 0.0
        target = math.floor(weight * total * passes + tokens[s] * 1e-6)
        whole, left = (target // tokens[s], target % tokens[s]) if tokens[s] else (1, 0)
        for key, *_ in mine:
            copies[key] = whole
        by_block = defaultdict(list)
        for key, _, t, spot in mine:
            by_block[spot % blocks].append((spot, t, key))
        start = 0
        for b in sorted(by_block, key=lambda b: (block_at(s, whole, b), b)):
            size = sum(t for _, t, _ in by_block[b])
            if left and start + size <= left:
                for *_, key in by_block[b]:
                    copies[key] += 1
            elif start < left:
                # The budget ends in this block: documents by their spot, as long as they fit.
                used = start
                for _, t, key in sorted(by_block[b]):
                    used += t
                    if used > left:
                        break
                    copies[key] += 1
            start += size
    return copies


def test_mixing_draws_document_by_document(spark):
    rng = random.Random(8)
    texts = [(i, " ".join("w" for _ in range(rng.randint(1, 30))), rng.choice("aaaaaabbc")) for i in range(900)] + [(900, "", "z"), (901, None, "z")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    light = df.select("doc_id", "source", mixing.word_tokens("text").alias("t"), F.xxhash64(F.lit(17), "doc_id", F.coalesce("text", F.lit(""))).alias("spot"))
    rows = [tuple(r) for r in light.collect()]
    tokens = Counter()
    for _, s, t, _ in rows:
        tokens[s] += t
    sources = mixing.shares(light.withColumnRenamed("t", "tokens"), "source", "tokens")
    for entropy, repetition in ((0.9, 4.0), (0.7, 100.0), (0.999, 1.5)):
        a, budget = mixing.exponent(sources, entropy, repetition)
        want, want_budget = plain_exponent(tokens, entropy, repetition)
        assert abs(a - want) < 2e-6 and abs(budget - want_budget) < 1e-4
    for passes in (0.37, 1.0, 2.71):
        drawn, m = mixing.draw(df, passes=passes, block_docs=16)
        got = {r["doc_id"]: r["copies"] for r in drawn.select("doc_id", f"{m}.copies").collect()}
        alpha, _ = mixing.exponent(sources, passes=passes)
        plan = mixing.plan(sources, alpha, passes, 16)
        places = plan.select("source", "whole", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
        at = {(r["source"], r["whole"], r["block"]): r["at"] for r in places.withColumn("at", F.xxhash64(F.lit(17), "source", "whole", "block")).collect()}
        assert got == plain_copies(rows, alpha, passes, 16, lambda s, w, b: at[s, w, b])


# The five stages in plain Python.


def plain_measures(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    again = {j for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    chars = sum(map(len, w))
    mean = 100 * chars // max(1, len(w))
    step = 10 ** max(0, len(str(mean)) - 3)
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    bins = {"sym_pm": 1000 * len(re.findall(r"[#*$%&|<>]", text)) // max(1, chars), "dup_pm": 1000 * (len(lines) - len(set(lines))) // max(1, len(lines)),
            "adj_pm": 1000 * sum(a == b for a, b in zip(w, w[1:])) // max(1, len(w)), "len_pc": mean // step * step}
    return failed, bins


def plain_quality(docs):
    judged = {d["doc_id"]: plain_measures(d["text"] or "") for d in docs}

    def ends(values, p):
        values, n = sorted(values), len(values)
        half = quality_rules.Z * math.sqrt(n * (p * (1 - p)))
        at = lambda rank: values[math.ceil(rank) - 1]
        return at(n * p), at(n * p - half) if n * p - half > 0 else None, at(n * p + half) if n * p + half <= n else None

    def moved(wide, low, high):
        x = wide if low is None else max(wide, low)
        return x if high is None else min(x, high)

    def kept(d):
        failed, own = judged[d["doc_id"]]
        for k, (spreads, least, upper, lower) in quality_rules.RULES.items():
            q = {}
            for p in (0.25, 0.5, 0.75):
                of = lambda same: [judged[e["doc_id"]][1][k] for e in docs if same(e) and not judged[e["doc_id"]][0]]
                every, lang, group = of(lambda e: True), of(lambda e: e["lang"] == d["lang"]), of(lambda e: (e["lang"], e["source"]) == (d["lang"], d["source"]))
                if failed or not group:
                    return False
                q[p] = moved(moved(ends(every, p)[0], *ends(lang, p)[1:]), *ends(group, p)[1:])
            if upper and own[k] > q[0.5] + spreads * (q[0.5] - q[0.25]) + least or lower and own[k] < q[0.5] - spreads * (q[0.75] - q[0.5]) - least:
                return False
        return True

    return [d for d in docs if kept(d)]


def plain_exact(docs):
    groups = defaultdict(list)
    for d in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", d["text"] or "")].append(d)
    return [min(g, key=lambda d: (-len(d["text"] or ""), d["doc_id"])) for g in groups.values()]


def plain_near(docs):
    sets = []
    for d in docs:
        w = d["text"].lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 10 >= len(a | sets[j]) * 8:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(docs):
        r = find(i)
        if r not in best or d["doc_id"] < best[r]["doc_id"]:
            best[r] = d
    return list(best.values())


def test_pipeline_row_by_row(spark, library, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    vocab = {la: ["".join(rng.choice(la * 2 + "aeiounrst") for _ in range(rng.randint(2, 8))) for _ in range(400)] for la in ("en", "fr")}
    texts = []
    for i in range(220):
        la, x = rng.choice(["en", "en", "fr"]), rng.random()
        w = [rng.choice(vocab[la]) for _ in range(rng.randint(25, 120))]
        source = rng.choice(["web", "web", "web", "news", "code"])
        if x < 0.1 and texts:
            t, la = texts[rng.randrange(len(texts))][:2]
            t = (t or "").replace(" ", "  ", 1)
        elif x < 0.25 and texts:
            t, la = texts[rng.randrange(len(texts))][:2]
            cut = (t or "a").split(" ")
            cut[rng.randrange(len(cut))] = "changed"
            t = " ".join(cut)
        elif x < 0.32:
            t = rng.choice([None, "", "too short", "a b c d " * 30, "$$$ ### " * 40, " ".join("x" * rng.randint(60, 90) for _ in range(30))])
        else:
            t = " ".join(w[:20]) + "\n" + " ".join(w[20:]) + rng.choice([".", "!", " <|endoftext|>"])
        texts.append((t, la, source))
    docs = [{"doc_id": i, "text": t, "lang": la, "source": s, "n_chars": len(t or "")} for i, (t, la, s) in enumerate(texts)]
    rng.shuffle(docs)
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(d[k] for k in ("doc_id", "text", "lang", "source", "n_chars")) for d in docs], kinds).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = plain_quality(docs)
    exact = plain_exact(kept)
    near = plain_near(exact)
    assert len(docs) > len(kept) > len(exact) > len(near) > 50
    light = spark.createDataFrame([(d["doc_id"], d["text"], d["source"]) for d in near], "doc_id long, text string, source string").select(
        "doc_id", "source", mixing.word_tokens("text").alias("t"), F.xxhash64(F.lit(17), "doc_id", F.coalesce("text", F.lit(""))).alias("spot"))
    rows, tokens = [tuple(r) for r in light.collect()], Counter()
    for _, s, t, _ in rows:
        tokens[s] += t
    alpha, budget = plain_exponent(tokens, mixing.ENTROPY, mixing.REPETITION)
    places = spark.createDataFrame([(s, w, b) for s in tokens for w in range(6) for b in range(3)], "source string, whole long, block long").withColumn("at", F.xxhash64(F.lit(17), "source", "whole", "block"))
    at = {(r["source"], r["whole"], r["block"]): r["at"] for r in places.collect()}
    copies = plain_copies(rows, alpha, budget, mixing.BLOCK_DOCS, lambda s, w, b: at[s, w, b])
    want = Counter()
    for d in near:
        ids = library.encode(d["text"], add_special_tokens=False).ids
        want[d["doc_id"], d["lang"], d["source"], len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)] += copies[d["doc_id"]]
    got = Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
