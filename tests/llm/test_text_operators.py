"""The operators over texts against brute force on small fixtures."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import bpe, exact_dedup, html_text, mixing, prefix_trees, pu_quality, quality_rules, sampling, simhash, suffix_levels, token_counts


def words(rng, n, kinds=40):
    return " ".join(f"w{rng.randint(0, kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        x = rng.random()
        t = words(rng, rng.randint(0, 60)) if x < 0.5 else "a b " * rng.randint(1, 30) if x < 0.65 else "z" * rng.randint(0, 90) if x < 0.75 else (rows[rng.randrange(len(rows))][1] or "") + rng.choice(["", " tail", "\n"]) if rows else ""
        rows.append((i, t))
    rows += [(60, None), (61, ""), (62, " \n"), (62, " \n"), (None, rows[0][1]), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, keep_id int").repartition(3), rows


def test_bpe_equals_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(1)
    texts = ["Hello WORLD's <|endoftext|> x", "", None, "a" * 3000, "İΑΣ ¼²", *["".join(rng.choice("abehit 'ÀßΣ01²\x85\xa0_#-é́中😀") for _ in range(rng.randint(0, 50))) for _ in range(300)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df)).collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False)
        assert got[i]["ids"] == want.ids and got[i]["decoded"] == lib.decode(want.ids, skip_special_tokens=False)
    assert bpe.encode(df, ids_col="text").columns == ["doc_id", "text", "text_"]
    both = {r["doc_id"]: r for r in bpe.encode_and_decode(df).collect()}
    assert all(both[i]["ids"] == got[i]["ids"] and both[i]["decoded"] == got[i]["decoded"] for i in got)


def test_bpe_digests_equal_library(spark):
    """The query's columns, for null, empty, very long and repeated texts, over several slices of a batch."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "word " * 60_000 + "é" * 5000), (4, "same text"), (4, "same text"), (None, "x<|endoftext|>y")] + [(10 + i, words(rng, 400, 5000)) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.digests(df).collect())) == want
    assert bpe.digests(df.limit(0)).count() == 0 and bpe.encode(df.limit(0)).count() == 0


def test_slices_cover_a_batch():
    import pyarrow as pa

    from loomline.llm.common import slices

    batch = pa.RecordBatch.from_pydict({"i": list(range(50)), "t": [None if i % 7 == 0 else "x" * (i * i) for i in range(50)]})
    parts = list(slices(batch, 1, 2000))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(50)) and len(parts) > 10
    assert max(p.num_rows for p in parts) < 30 and list(slices(batch.slice(0, 0), 1)) == []

def test_simhash_components(spark, docs):
    df, rows = docs
    fps = [simhash.fingerprint(t) for _, t in rows]
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                root[find(a)] = find(b)
    low = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            low[find(f)] = min(low.get(find(f), 1 << 60), i)
    want = Counter((i, f, low.get(find(f))) for (i, _), f in zip(rows, fps))
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.components(df).collect()) == want
    assert simhash.near_dedup(df).count() == len({find(f) for f in fps}) and simhash.near_dedup(df).columns == df.columns
    assert simhash.components(df.limit(0)).count() == 0


def test_simhash_links_dense_balls(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(25):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    ours = {f: f for f in fps}

    def find(m, x):
        while m[x] != x:
            x = m[x]
        return x

    for r in simhash.links(df).collect():
        assert bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 3
        ours[find(ours, r["a"])] = find(ours, r["b"])
    true = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                true[find(true, a)] = find(true, b)
    classes = lambda m: {frozenset(f for f in fps if find(m, f) == r) for r in {find(m, f) for f in fps}}
    assert classes(ours) == classes(true)


def test_exact_dedup(spark, docs):
    df, rows = docs
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    for kw in ({}, {"block_chars": 3, "hash_bits": 4}):
        got = exact_dedup.decisions(df, **kw).collect()
        assert len(got) == len(rows)
        groups = {}
        for i, t in rows:
            groups.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append((len(t or ""), i))
        for r in got:
            g = groups[r["text_sha256"]]
            most = max(n for n, _ in g)
            assert r["group_size"] == len(g) and r["keep_id"] == min((i for n, i in g if n == most and i is not None), default=None)
        assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_quality_rules_measures_and_filter(spark, docs):
    df, rows = docs
    got = Counter((r["doc_id"], r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) for r in quality_rules.judge(df).collect())

    def model(t):
        w = (t or "").split()
        seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        return len(w), len(hit), len(lines) - len(set(lines))

    assert got == Counter((i, *model(t)) for i, t in rows)
    judged = quality_rules.judge(df)
    assert quality_rules.quality_filter(df).count() == judged.filter("kept").count() and quality_rules.quality_filter(df).columns == df.columns
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_quality_fences_adapt(spark):
    clean = [(i, " ".join(f"word{(i * 31 + k * 7) % 997}" for k in range(60)), "en", "a") for i in range(120)]
    junk = [(1000 + i, " ".join(f"w{(i + k) % 89}$$$" for k in range(60)), "en", "a") for i in range(20)]
    noisy = [(2000 + i, " ".join(f"w{(i * 13 + k * 5) % 991:03d}$$$" for k in range(60)), "en", "code") for i in range(80)]
    df = spark.createDataFrame(clean + junk + noisy, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.judge(df).filter("kept").collect()}
    assert {i for i, *_ in clean} <= kept and not kept & {i for i, *_ in junk}
    # Where symbols are the rule of a source they are no reason to reject.
    assert {i for i, *_ in noisy} <= kept


def test_quality_keeps_text_without_spaces(spark):
    """Mean word lengths of 60 to 68 are no reason to reject where all documents have them; an odd one out is."""
    rng = random.Random(4)
    rows = [(i, " ".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(60, 68))) for _ in range(30)), "zh", "web") for i in range(200)]
    rows += [(500, " ".join("x" * 5000 for _ in range(25)) + " ", "zh", "web")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()}
    assert all(kept[i] for i in range(200)) and not kept[500]
    renamed = quality_rules.judge(df.withColumn("n_words", F.lit(1)), keep=("doc_id", "n_words", "text"))
    assert renamed.columns[:4] == ["doc_id", "n_words", "text", "n_words_"] and renamed.filter("n_words = 1 and n_words_ >= 25 and kept").count() == 200


def test_quality_quartiles_move_as_far_as_documents_compel(spark):
    """A few documents take their language's fence, many their own; in between the interval of the quartile decides."""
    rows = [("en", "big", 10, 950), ("en", "few", 400, 4), ("en", "some", 400, 40), ("en", "split", 400, 25), ("en", "split", 10, 15)]
    hist = spark.createDataFrame([(la, s, "sym_pm", b, n) for la, s, b, n in rows], "lang string, source string, measure string, bin long, n long")
    got = {r["t_source"]: r["sym_pm_hi"] for r in quality_rules.thresholds(hist).collect()}
    assert got == {"big": 30, "few": 30, "some": 420, "split": 30}


def test_pu_quality_finds_negatives_without_labels():
    rng = np.random.default_rng(0)
    pos = lambda n: np.abs(rng.normal(0.3, 0.05, (n, len(pu_quality.MEASURES))))
    neg = lambda n: np.abs(rng.normal(0.6, 0.05, (n, len(pu_quality.MEASURES))))
    model = pu_quality.fit_arrays(pos(2000), np.concatenate([pos(1600), neg(400)]))
    assert abs(model.prior - 0.8) < 0.06
    assert (model.score(pos(300)) >= pu_quality.CUT).mean() > 0.97 and (model.score(neg(300)) < pu_quality.CUT).mean() > 0.97


def test_pu_quality_scores_every_row(spark, docs):
    df, rows = docs
    model = pu_quality.fit(df, df.filter("doc_id < 20").select("doc_id"))
    scores = [r["score"] for r in pu_quality.score(df, model).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    empty = pu_quality.fit(df.limit(0), df.limit(0).select("doc_id"))
    assert pu_quality.score(df, empty).agg({"score": "max"}).first()[0] == 0.5


def test_token_counts(spark):
    lengths = [0, 3, 3, 7, 5000, 5001, 2048, None]
    df = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    sums = token_counts.suffix_sums(token_counts.histogram(df))
    real = [n or 0 for n in lengths]
    for r in sums.collect():
        at = r["n_tokens"]
        assert r["docs_ge"] == sum(n >= at for n in real) and r["tokens_ge"] == sum(n for n in real if n >= at)
        assert r["truncated_total"] == sum(min(n, at) for n in real) and r["docs_le"] == sum(n <= at for n in real)
    cut = {r["limit"]: (r["docs_cut"], r["truncated_total"]) for r in token_counts.truncated_totals(sums, [1, 4096]).collect()}
    assert cut == {k: (sum(n > k for n in real), sum(min(n, k) for n in real)) for k in (1, 4096)}
    assert {r["share"]: r["n_tokens"] for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: 3, 1.0: 5001}
    assert token_counts.suffix_sums(token_counts.histogram(df.limit(0))).count() == 0


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (5 + i % 9), "hot" if i % 10 < 7 else f"s{i % 10}", i % 3) for i in range(4000)] + [(5000, None, None, 0), (5001, "a b", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pass int")
    drawn, m = mixing.draw(df, entropy=0.8, repetition=1e6, block_docs=16)
    got = drawn.select("doc_id", "source", f"{m}.*").toPandas()
    assert len(got) == len(rows) and (got.copies >= 1).all()
    got["drawn"] = got.tokens * got.copies
    by = got.groupby(got.source.fillna("-"))[["tokens", "drawn"]].sum()
    w = by.drawn / by.drawn.sum()
    assert abs(-(w * np.log(w)).sum() / np.log(len(w)) - 0.8) < 0.01
    assert by.drawn["hot"] == by.tokens["hot"]
    capped, m = mixing.draw(df, entropy=0.99, repetition=2.0, block_docs=16)
    clash = df.toDF("at", "text", "last", "blocks")
    again, m2 = mixing.draw(clash, source_col="last", id_col="at", entropy=0.8, repetition=1e6, block_docs=16)
    assert again.columns == [*clash.columns, m2] and again.select(f"{m2}.copies").groupBy().sum().first()[0] == got.copies.sum()
    reps = capped.select("source", f"{m}.*").toPandas().assign(drawn=lambda x: x.tokens * x.copies).groupby("source")[["tokens", "drawn"]].sum()
    assert (reps.drawn / reps.tokens).max() <= 2.001
    assert mixing.mix(df).columns == df.columns and mixing.mix(df.limit(0)).count() == 0


def repeats_7(rows, window):
    first = {}
    cut = [(1 << 62 if i is None else i, (t or "").split()) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, 1 << 62), i)
    out = []
    for i, w in cut:
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for j in range(k, k + window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def repeats_10(rows, window):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[k:k + window] for r in raws for k in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = {j for k in range(len(r) - window + 1) if seen[r[k:k + window]] > 1 for j in range(k, k + window)}
        out.append((len(r), len(gone), sum(j - 1 not in gone for j in gone), bytes(x for k, x in enumerate(r) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("group_rows", [10_000, 12, 1])
def test_substring_dedup(spark, docs, group_rows):
    df, rows = docs
    out = prefix_trees.dedup(df, unit=sampling.Words(5, (2, 3, 5), 3), group_rows=group_rows).collect()
    assert Counter((r["n_words"], sum(s["hi"] - s["lo"] for s in r["spans"]), r["kept"]) for r in out) == repeats_7(rows, 5)
    out = suffix_levels.dedup(df, unit=sampling.Bytes(20, (8, 16, 20), 7), group_rows=group_rows).collect()
    assert Counter((r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in out) == repeats_10(rows, 20)


def test_substring_dedup_of_nothing(spark, docs):
    df, _ = docs
    assert prefix_trees.dedup(df.limit(0)).count() == 0 and suffix_levels.dedup(df.limit(0)).count() == 0


def test_word_arrays_and_runs_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(2)
    raws = ["".join(rng.choice("ab é\n\t　") for _ in range(rng.randint(0, 200))).encode() for _ in range(100)] + [b"", b" ", b"x" * 200, b"y " * 60 + b"z" * 120]
    unit = sampling.Words(4, (2, 4), 3)
    whole = sampling.text_runs(unit, unit.symbols(raws))
    monkeypatch.setattr(sampling, "CHUNK", 50)
    sampling._POWERS.clear()
    for i, h, s, e in sampling.word_arrays(raws):
        assert [raws[i][a:b] for a, b in zip(s, e)] == raws[i].split()
    monkeypatch.setattr(sampling, "AT_ONCE", 10)
    cut = sampling.text_runs(sampling.Bytes(20, (8, 16, 20), 7), sampling.Bytes().symbols(raws))
    assert sum(cut[2]) == sum(max(0, len(r) - 19) for r in raws)
    sampling._POWERS.clear()
    assert sum(whole[2]) == sum(max(0, len(r.split()) - 3) for r in raws)


def test_html_gradients_and_accuracy():
    made = html_text.made_pages(6, 5)
    model = html_text.Labeller(1)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    pages = [html_text.features(b) for _, b, _ in made]
    labels = np.zeros((len(made), max(len(y) for *_, y in made)))
    for i, (*_, y) in enumerate(made):
        labels[i, :len(y)] = y

    def loss():
        x, mask = model.inputs(pages)
        z, _ = model.logits(x.astype(np.float64), mask)
        return float(((np.logaddexp(0, z) - labels * z) * mask).sum() / mask.sum())

    grads = model.gradients(pages, labels)
    for k, at in (("fh", (3, 5)), ("bx", (2, 7)), ("oh", (4, 0)), ("fb", (9,))):
        was = model.w[k][at]
        model.w[k][at] = was + 1e-4
        up = loss()
        model.w[k][at] = was - 1e-4
        down = loss()
        model.w[k][at] = was
        assert abs((up - down) / 2e-4 - grads[k][at]) < 2e-3
    trained = html_text.trained()
    for disguised, least in ((0.0, 0.99), (1.0, 0.92)):
        held = html_text.made_pages(150, 77, disguised)
        right = [(a == (y > 0)).mean() for a, (*_, y) in zip(trained.label([html_text.features(b) for _, b, _ in held]), held)]
        assert np.mean(right) > least


def test_html_blocks():
    page = "<!doctype html><head><title>t</title></head><body><!-- <p>no --><script>'<p>x'</script><p>One&nbsp;&amp; <b>tw</b>o<p>three<br>four<ul><li>a<li>b</ul>end"
    assert [t for _, t, _ in html_text.leaf_blocks(page)] == ["One & two", "three", "four", "a", "b", "end"]
    assert html_text.leaf_blocks(None) == [] and html_text.leaf_blocks("<<<") != None  # noqa: E711


def test_html_extract(spark):
    page = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Title here</h1><p>Some text of the article, long enough.</p></article><footer>&copy; x</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    text = "Title here Some text of the article, long enough."
    assert got == {1: (text, len(text)), 2: ("", 0), None: ("", 0)}
    assert html_text.extract(df.limit(0)).count() == 0
