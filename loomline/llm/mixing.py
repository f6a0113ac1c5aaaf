"""Temperature mixing of sources to target weights.

Token shares s are raised to an exponent a between 0 (uniform) and 1 (as found) and
normalised. Entropy falls and repetition of the smallest source falls as a grows, so
the exponent is found by sectioning the interval; each step is one aggregation that
evaluates several exponents over the sources, and only those sums come to the driver.

Weights are realised within a budget of tokens: a source is drawn in whole passes, and
the rest of its budget is taken from a keyed permutation of its blocks. Blocks, not
documents, are put in order, and the block where the budget ends is taken up to the
last document that fits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm.common import WS, durable, free_name, numbered_columns, small

#: Documents in a block, on average.
BLOCK_DOCS = 256
ENTROPY = 0.9
REPETITION = 4.0
POINTS = 16


def word_tokens(text_col: str) -> F.Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), WS + "+"), lambda w: w != "")).cast("long")


def shares(sized: DataFrame, source_col: str, tokens_col: str) -> DataFrame:
    """(source, docs, tokens, x): x is the natural logarithm of the source's share of tokens; without tokens null."""
    by = sized.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("docs"), F.sum(tokens_col).alias("tokens"))
    total = by.agg(F.sum("tokens").alias("total"))
    return by.join(F.broadcast(total)).select("source", "docs", "tokens", F.when(F.col("tokens") > 0, F.log(F.col("tokens") / F.col("total"))).alias("x"))


def _evaluate(sources: DataFrame, points: list[float], passes: float | None) -> list[tuple[float, float, float]]:
    """For each exponent: entropy over its largest value, passes of the most repeated source, budget in passes."""
    cols = []
    for i, a in enumerate(points):
        e = F.exp(F.col("x") * a)
        cols += [F.sum(e).alias(f"z{i}"), F.sum(e * F.col("x")).alias(f"e{i}")]
    row = sources.filter("x is not null").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("top"), *cols).first()
    if not row["n"]:
        return [(1.0, 0.0, 0.0)] * len(points)
    out = []
    for i, a in enumerate(points):
        z, e = row[f"z{i}"], row[f"e{i}"]
        budget = passes if passes is not None else z / math.exp((a - 1) * row["top"])
        h = (math.log(z) - a * e / z) / math.log(row["n"]) if row["n"] > 1 else 1.0
        out.append((h, budget * math.exp((a - 1) * row["low"]) / z, budget))
    return out


def exponent(sources: DataFrame, entropy: float = ENTROPY, repetition: float = REPETITION,
             passes: float | None = None, rounds: int = 6) -> tuple[float, float]:
    """(exponent, budget in passes over the corpus).

    The exponent is the largest one with the entropy asked for (as a share of its
    largest value), and larger where the smallest source would otherwise be drawn more
    often than `repetition` allows. Without `passes` the budget is the least that draws
    every source whole, so that no document is left out.
    """

    def boundary(holds) -> float:
        """Where `holds`, true below and false above, turns."""
        lo, hi = 0.0, 1.0
        for k in range(rounds):
            points = [lo + (hi - lo) * i / POINTS for i in range(POINTS + 1)]
            true = [holds(v) for v in _evaluate(sources, points, passes)]
            if k == 0 and not true[0]:
                return 0.0
            if k == 0 and true[-1]:
                return 1.0
            last = max(i for i, t in enumerate(true) if t)
            lo, hi = points[last], points[min(last + 1, POINTS)]
        return hi

    a = max(boundary(lambda v: v[0] >= entropy), boundary(lambda v: v[1] > repetition))
    a = round(a, 6)
    return a, _evaluate(sources, [a], passes)[0][2]


def plan(sources: DataFrame, alpha: float, passes: float, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(source, docs, tokens, weight, target, whole, rest, blocks) of each source.

    target: its tokens in the budget; whole: full passes; rest: tokens of the last one.
    A source without tokens has weight 0; its documents cost nothing and are drawn once.
    """
    z = sources.agg(F.sum(F.exp(F.col("x") * alpha)).alias("z"), F.sum("tokens").alias("total"))
    weight = F.coalesce(F.exp(F.col("x") * alpha) / F.col("z"), F.lit(0.0))
    # A target within a millionth of a whole number of passes is that number.
    target = F.floor(weight * F.col("total") * passes + F.col("tokens") * 1e-6).cast("long")
    out = sources.join(F.broadcast(z)).withColumn("weight", weight).withColumn("target", target)
    return out.select(
        "source", "docs", "tokens", "weight", "target",
        F.expr("case when tokens > 0 then target div tokens else 1 end").alias("whole"),
        F.expr("case when tokens > 0 then target % tokens else 0 end").alias("rest"),
        F.expr(f"(docs + {block_docs - 1}) div {block_docs}").alias("blocks"))


def draw(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", tokens_col: str | None = None,
         entropy: float = ENTROPY, repetition: float = REPETITION, passes: float | None = None, seed: int = 17,
         block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, str]:
    """`docs` with a struct column (its name comes second) of tokens, block and copies: how often a row is drawn.

    Tokens are words, or `tokens_col`. A null source is a source; null texts have no
    tokens. The draws of a source fall short of its target by less than one document.
    Columns of any name come through as they are.
    """
    m, (plain, at) = free_name(docs, "mix"), numbered_columns(docs)
    drawn = _draw(plain, at[source_col], at[text_col], at[id_col], at.get(tokens_col), entropy, repetition, passes, seed, block_docs)
    return drawn.toDF(*docs.columns, m), m


def _draw(docs: DataFrame, source_col: str, text_col: str, id_col: str, tokens_col: str | None, entropy: float, repetition: float, passes: float | None, seed: int, block_docs: int) -> DataFrame:
    m = "mix"
    tokens = word_tokens(text_col) if tokens_col is None else F.coalesce(F.col(tokens_col).cast("long"), F.lit(0).cast("long"))
    spot = F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    sized = docs.select(*docs.columns, F.struct(F.col(source_col).alias("source"), tokens.alias("tokens"), spot.alias("spot")).alias(m))
    light = durable(sized.select(f"{m}.*"))
    sources = durable(shares(light, "source", "tokens"))
    alpha, budget = exponent(sources, entropy, repetition, passes)
    planned = durable(plan(sources, alpha, budget, block_docs))
    block = F.expr("pmod(spot, blocks)")
    keys = small(planned.select(F.col("source").alias("p_source"), "whole", "rest", "blocks"))
    blocks = light.join(keys, F.col("source").eqNullSafe(F.col("p_source"))).groupBy("source", "whole", "rest", block.alias("block")).agg(F.sum("tokens").alias("t"))
    # The permutation of a source's blocks, cut into at most 1,024 stretches, so that sums run over few rows.
    blocks = durable(blocks.withColumn("at", F.xxhash64(F.lit(seed), "source", "whole", "block")).withColumn("stretch", F.shiftright("at", 54)))
    before = lambda w: F.coalesce(F.sum("t").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = blocks.groupBy("source", "stretch").agg(F.sum("t").alias("t"))
    runs = runs.select(F.col("source").alias("r_source"), F.col("stretch").alias("r_stretch"), before(W.partitionBy("source").orderBy("stretch")).alias("start"))
    on = F.col("source").eqNullSafe(F.col("r_source")) & (F.col("stretch") == F.col("r_stretch"))
    within = before(W.partitionBy("source", "stretch").orderBy("at", "block"))
    cut = blocks.join(runs, on).withColumn("start", F.col("start") + within)
    cut = durable(cut.select(
        F.col("source").alias("c_source"), F.col("block").alias("c_block"), "at", "whole",
        ((F.col("rest") > 0) & (F.col("start") + F.col("t") <= F.col("rest"))).alias("in_rest"),
        F.when((F.col("start") < F.col("rest")) & (F.col("start") + F.col("t") > F.col("rest")), F.col("rest") - F.col("start")).alias("left")))
    # The documents of the one block of a source where its budget ends.
    edge = light.join(keys, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("block", block)
    on = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("block") == F.col("c_block"))
    edge = edge.join(cut.filter("left is not null").select("c_source", "c_block", "left"), on).groupBy("source", "block", "left", "spot").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(W.partitionBy("source", "block").orderBy("spot"))
    edge = edge.withColumn("upto", upto).filter("upto <= left").groupBy("source", "block").agg(F.max("spot").alias("last"))
    edge = durable(edge.select(F.col("source").alias("e_source"), F.col("block").alias("e_block"), "last"))
    on = F.col("c_source").eqNullSafe(F.col("e_source")) & (F.col("c_block") == F.col("e_block"))
    cut = durable(cut.join(edge, on, "left").select("c_source", "c_block", "at", "whole", "in_rest", "last"))
    plain = sized.join(small(planned.select(F.col("source").alias("p_source"), "blocks")), F.col(f"{m}.source").eqNullSafe(F.col("p_source")))
    on = F.col(f"{m}.source").eqNullSafe(F.col("c_source")) & (F.expr(f"pmod({m}.spot, blocks)") == F.col("c_block"))
    out = plain.join(cut, on)
    copies = F.col("whole") + F.when(F.col("in_rest") | (F.col(f"{m}.spot") <= F.col("last")), 1).otherwise(0)
    return out.select(*docs.columns, F.struct(f"{m}.tokens", F.col("c_block").alias("block"), F.col("at").alias("block_at"), copies.cast("int").alias("copies")).alias(m))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """Each row of `docs` as often as it is drawn, with the columns it had."""
    plain, at = numbered_columns(docs)
    cols = {k: at[kw.pop(k, v)] for k, v in (("source_col", "source"), ("text_col", "text"), ("id_col", "doc_id"))}
    if kw.get("tokens_col"):
        cols["tokens_col"] = at[kw.pop("tokens_col")]
    drawn, m = draw(plain, **cols, **kw)
    rows = drawn.filter(f"{m}.copies > 0").withColumn("c_pass", F.explode(F.expr(f"sequence(1, {m}.copies)")))
    return rows.select(*plain.columns).toDF(*docs.columns)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each draw: which pass over its source it belongs to, and where in that pass."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    drawn, m = draw(docs)
    rows = drawn.select("doc_id", "source", f"{m}.*").filter("copies > 0").withColumn("pass", F.explode(F.expr("sequence(1, copies)")))
    return rows.select("doc_id", "source", F.col("tokens").alias("n_tokens"), "block", "pass", F.xxhash64("block_at", "pass").alias("block_order"))
