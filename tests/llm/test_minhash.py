"""Near-dedup of the pipeline's stage against brute force over all pairs."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from loomline.llm import minhash


def test_near_stage_equals_all_pairs(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(3, 150))]
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(base) if rng.random() < 0.7 else texts[-1].split()
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 500)}"
            texts.append(" ".join(copy))
    rows = [*enumerate(texts), (900, None), (901, ""), (902, " \n"), (902, " \n"), (None, texts[0]), (3, texts[0] + " tail")]
    rng.shuffle(rows)
    sets = []
    for _, t in rows:
        ws = (t or "").lower().split()
        sets.append({tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 10 >= len(a | sets[j]) * 8:
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), 1 << 60), k)
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(4)
    got = corpus_pipeline.near(spark, df, "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(low.values()) and got.columns == df.columns
    assert corpus_pipeline.near(spark, df.limit(0), "").count() == 0


def test_bucket_of_several_components_is_compared_on(spark):
    """Members that are not like the first centres are still compared with each other."""
    members, sets = [], []
    for g in range(8):
        for v in range(2):
            hashes = [(100 * g + i) << 20 for i in [*range(9), 50 + v]]
            members.append((1, 2 * g + v, 10, minhash.parity_sketch(np.array(hashes, np.uint64))))
            sets.append((2 * g + v, hashes))
    buckets = spark.createDataFrame(members, "key long, node long, n long, bits struct<b0: long, b1: long, b2: long, b3: long>")
    links = minhash._rooted(buckets, spark.createDataFrame(sets, "node long, hashes array<long>"), 0.8)
    assert {(r["node"], r["root"]) for r in links.collect()} == {(m, m - m % 2) for _, m, *_ in members}


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        both = rng.integers(0, 1 << 63, rng.integers(1, 400), np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, rng.integers(0, 60), np.uint64)]) for _ in range(2))
        bits = [np.array(minhash.parity_sketch(x)).view(np.uint64) for x in (a, b)]
        assert sum(int(x).bit_count() for x in bits[0] ^ bits[1]) <= len(a) + len(b) - 2 * len(both)


def test_balls_of_fingerprints_bring_texts_together(spark, monkeypatch):
    """Texts whose fingerprints lie within three bits are linked by the balls alone, if their sets are similar."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(400))]
    bits = [minhash._fingerprint(minhash.shingles(t)) for t in texts]
    assert ((bits[0] ^ bits[1]) & (1 << 64) - 1).bit_count() <= 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(minhash, "_sketched", _unbanded(minhash._sketched))
    assert sorted(r["doc_id"] for r in minhash.near_texts(df).collect()) == [0, 2]


def _unbanded(sketched):
    return lambda docs, shingle: sketched(docs, shingle).withColumn("keys", F.array().cast("array<long>"))
