"""Suffix arrays, trees, prefixes of several lengths and the family of levels, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomline.llm import prefix_trees, sampling, suffix_levels


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    texts = [[rng.randint(0, 2) for _ in range(rng.randint(3, 40))] for _ in range(30)]
    symbols, starts, suffixes = [], [], []
    for k, t in enumerate(texts):
        for i in range(len(t)):
            starts.append(len(symbols) + i)
            suffixes.append((*t[i:], 100 + k))
        symbols += [*t, 100 + k]
    order, common = prefix_trees.suffix_array(np.array(symbols), np.array(starts), 41)
    got = [suffixes[i] for i in order]
    assert got == sorted(suffixes)
    for k in range(1, len(got)):
        n = next(j for j, (a, b) in enumerate(zip(got[k - 1], got[k])) if a != b)
        assert common[k] == n


def test_repeat_depths_are_the_longest_shared_with_a_smaller_document():
    rng = random.Random(2)
    for _ in range(20):
        n = rng.randint(1, 30)
        common = np.array([0, *(rng.randint(0, 9) for _ in range(n - 1))])
        low = np.array([rng.randint(0, 5) for _ in range(n)])
        got = prefix_trees.repeat_depths(common, low, 3)
        for i in range(n):
            best = 0
            for j in range(n):
                if low[j] < low[i]:
                    a, b = sorted((i, j))
                    best = max(best, int(common[a + 1:b + 1].min()))
            assert got[i] == (best if best >= 3 else 0)


def test_subtrees_give_maximal_repeats():
    import pyarrow as pa

    unit = sampling.Words(3, (2, 3), 9)
    a, b = b"a b c d e f g", b"x a b c d e y"
    table = pa.table({"did": [1, 2], "h": [10, 20], "start": pa.array([5, 0], pa.int32()), "ctx": pa.array([a, b], pa.binary())})
    assert prefix_trees.subtrees(table, unit).to_pylist() == [{"did": 2, "h": 20, "lo": 1, "hi": 6}]


def test_prefixes_grow_until_a_group_fits(spark, monkeypatch):
    """A phrase of two words in many places is dealt out by three, a repeated window by itself."""
    rng = random.Random(3)
    w = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    rows = [(i, f"{w(6)} the phrase {w(6)}" if i % 2 else f"{w(5)} one two three four five {w(5)}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    unit, levels, sizes = sampling.Words(5, (2, 3, 5), 3), [], []
    real, trees = sampling.finer, prefix_trees.grouped_by_gram
    monkeypatch.setattr(sampling, "finer", lambda rows, unit, level: levels.append(level) or real(rows, unit, level))
    monkeypatch.setattr(prefix_trees, "grouped_by_gram", lambda rows, group_rows, total: sizes.append(rows.groupBy("gram").count().agg(F.max("count")).first()[0] or 0) or trees(rows, group_rows, total))
    out = {r["did"]: [tuple(s) for s in r["spans"]] for r in prefix_trees.dedup(df, unit=unit, group_rows=10).collect()}
    assert levels and max(sizes) <= 10 and len(sizes) > 1
    assert all(out[i] == ([(5, 10)] if i % 2 == 0 and i else []) for i, _ in rows)


def test_family_of_levels(spark):
    rng = random.Random(4)
    rows = [(g, 1000 * b + k, k, 0) for b in range(7) for k, g in enumerate(rng.sample(range(150), 40))]
    df = spark.createDataFrame(rows, "gram long, key long, start int, more int")
    family, known, sizes = suffix_levels.Family(), [], []
    for b in range(7):
        batch = [r for r in rows if r[1] // 1000 == b]
        got = {tuple(r) for r in family.add(df.filter(F.col("key").between(1000 * b, 1000 * b + 999))).collect()}
        met = {r[0] for r in batch} & {r[0] for r in known}
        assert got == {r[:3] for r in batch + known if r[0] in met}
        known += batch
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1], [4, 2, 1]]
    assert sum(level.count() for _, level in family.levels) == len(rows)


def test_spans_come_from_the_family(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"{i * 7919} the same words here {i * 104729}") for i in range(8)], "doc_id long, text string")
    unit = sampling.Bytes(12, (4, 8, 12), 7)
    assert suffix_levels.dedup(df, unit=unit).filter(F.size("spans") > 0).count() == 8
    monkeypatch.setattr(suffix_levels.Family, "add", lambda self, batch: batch.select("gram", "key", "start").limit(0))
    assert suffix_levels.dedup(df, unit=unit).filter(F.size("spans") > 0).count() == 0


def test_texts_move_once_for_contexts_of_light_and_heavy_prefixes(spark, monkeypatch):
    """What goes on to longer prefixes is a checkpoint, no second join with the texts."""
    rng = random.Random(8)
    w = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    rows = [(i, f"{w(5)} one two three four five {w(5)}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for module, unit in ((prefix_trees, sampling.Words(5, (2, 3, 5), 3)), (suffix_levels, sampling.Bytes(20, (8, 12, 20), 32, 1))):
        plans, real = [], module.extended
        monkeypatch.setattr(module, "extended", lambda rows, *a, real=real, plans=plans: plans.append(rows._jdf.queryExecution().toString()) or real(rows, *a))
        out = {r["did"]: [tuple(s) for s in r["spans"]] for r in module.dedup(df, unit=unit, group_rows=10).collect()}
        assert len(plans) == 1 and "Join" not in plans[0]
        assert all(out[i] for i, _ in rows if i)
