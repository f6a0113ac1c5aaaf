"""Audit of how the sources of a language diverge in their terms.

Postings hold, for each kept term of a language, the sources that use it and how often.
Two things are read from them.

*Pairs of sources* are summed from the postings that two sources share. A term that a
source lacks has one value for the whole source, so what all other terms add to a pair
follows from the source's counts in order, and no pair looks at a term that neither uses.

*Terms of a source* are searched by upper bounds. A source's terms fall into buckets by
count; a bucket's bound is the share of its highest count less the least share that any of
its terms has in the language. Buckets are evaluated from the best bound down, and a
source is done once the bounds of what it has not seen are all strictly below its k-th
value, so ties at the k-th place are always seen.

All shares are whole numbers of a billionth, and sums are exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm.common import durable, mapped, slices, small

#: Documents of a language that a kept term occurs in, at least.
MIN_DOCS = 30
#: Places of the report of terms.
TOP = 50
#: What is added to each count, and the whole that shares are parts of.
ADDED, UNIT = 5, 1_000_000_000
#: Counts that a worker holds before it gives them on.
HELD = 200_000
#: Terms of a source that the first round evaluates, and how many times as many each further one.
FIRST, FASTER = 64, 16
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, from `docs(lang, source, text)`; nulls count as ''.

    A term is a longest run of ASCII letters and characters beyond ASCII; only A-Z are
    lower-cased. UTF-8 keeps both apart from all else byte by byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            rows = [(g, t, n, seen[t]) for g, (all_, seen) in counts.items() for t, n in all_.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([g[0] for g, *_ in rows], pa.string()), pa.array([g[1] for g, *_ in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()),
                pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for part in (p for whole in batches for p in slices(whole, 2)):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()):
                own = Counter(m.group() for m in _TERM.finditer(text.lower())) if len(text) > 1 << 22 else Counter(_TERM.findall(text.lower()))
                all_, seen = counts.setdefault((lang, source), (Counter(), Counter()))
                before = len(all_)
                all_.update(own)
                seen.update(own.keys())
                held += len(all_) - before
            if held > HELD:
                yield flush()
                held = 0
        if counts:
            yield flush()

    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = mapped(named, run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, of: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (of + ADDED * terms)), exact beyond 64 bits."""
    wide = (n + ADDED).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, (of + ADDED * terms).cast("decimal(20,0)")) + 1


class Audit:
    """Shares of kept terms by source, written once; `pairs` and `top_terms` read them."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        counts = term_counts(docs)
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("posts")).filter(F.col("docs") >= min_docs)
        postings = durable(kept.select("lang", "term", "total", F.inline("posts")))
        langs = postings.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("of_lang"))
        own = postings.groupBy("lang", "source").agg(F.sum("n").alias("of"))
        every = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
        groups = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("of"), zero("of_lang"), zero("terms"))
        # The share of a term that the source lacks; no terms, no share.
        self.groups = durable(groups.withColumn("none", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("of"), F.col("terms")))))
        self.entries = durable(postings.join(small(self.groups), ["lang", "source"]).select(
            "lang", "source", "term", "n", "none", _share(F.col("n"), F.col("of"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("of_lang"), F.col("terms")).alias("q")))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): for each two sources of a language, the sum of |p - q| over all kept terms; 0 without terms."""
        e, g = self.entries, self.groups
        two = g.select("lang", "source", "terms", "none").join(g.select("lang", F.col("source").alias("item"), F.col("none").alias("other")), "lang").filter("source <> item")
        # What a source's own terms add against a source that has none of them: its counts in the order of
        # their shares, and the other sources' shares of an absent term, told in the same order.
        hist = e.groupBy("lang", "source", F.col("p").alias("x")).agg(F.count("*").alias("m"))
        line = hist.select("lang", "source", F.lit(None).cast("string").alias("item"), "x", "m").unionByName(two.select("lang", "source", "item", F.col("other").alias("x"), F.lit(0).cast("long").alias("m")))
        up = W.partitionBy("lang", "source").orderBy("x").rangeBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy("lang", "source")
        mx = F.col("m") * F.col("x")
        told = line.select("lang", "source", "item", "x", F.sum("m").over(up).alias("n_le"), F.sum(mx).over(up).alias("s_le"), F.sum("m").over(whole).alias("n_all"), F.sum(mx).over(whole).alias("s_all")).filter("item is not null")
        alone = told.select("lang", "source", "item", "n_all", (F.expr("x * n_le - s_le + (s_all - s_le) - x * (n_all - n_le)")).alias("apart"))
        side = two.join(alone, ["lang", "source", "item"]).select(
            "lang", "source", "item", (F.col("apart") - F.col("n_all") * F.abs(F.col("none") - F.col("other"))).alias("side"), (F.col("terms") * F.abs(F.col("none") - F.col("other"))).alias("base"))
        # What shared terms add beyond that, once for each two sources of a posting.
        a = e.select("lang", "term", F.col("source").alias("one"), F.col("p").alias("p1"), F.col("none").alias("z1"))
        b = e.select("lang", "term", F.col("source").alias("two"), F.col("p").alias("p2"), F.col("none").alias("z2"))
        both = a.join(b, (a["lang"] == b["lang"]) & (a["term"] == b["term"]) & (F.col("one") < F.col("two"))).select(
            a["lang"], "one", "two", F.expr("abs(p1 - p2) - abs(p1 - z2) - abs(z1 - p2) + abs(z1 - z2)").alias("d")).groupBy("lang", "one", "two").agg(F.sum("d").alias("shared"))
        ordered = side.select("lang", F.least("source", "item").alias("one"), F.greatest("source", "item").alias("two"), "side", "base")
        value = ordered.groupBy("lang", "one", "two").agg(F.sum("side").alias("side"), F.max("base").alias("base")).join(both, ["lang", "one", "two"], "left").select(
            "lang", "one", "two", F.coalesce(F.expr("base + side + coalesce(shared, 0)"), F.lit(0)).cast("long").alias("value"))
        turned = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
        return value.select("lang", turned.alias("s"), "value").select("lang", "s.source", "s.item", "value")

    def top_terms(self, k: int = TOP, first: int = FIRST) -> DataFrame:
        """(lang, source, item, value, rank): a source's k terms that exceed the language's share most, by value, then term."""
        # Buckets of counts: exact below 16, then eight to each doubling.
        n = F.col("n")
        low = F.greatest(F.length(F.bin(n)) - 4, F.lit(0))
        e = self.entries.withColumn("bucket", low * 16 + F.call_function("shiftright", n, low))
        best = W.partitionBy("lang", "source").orderBy(F.col("bound").desc(), "bucket")
        buckets = durable(
            e.groupBy("lang", "source", "bucket").agg(F.count("*").alias("size"), (F.max("p") - F.min("q")).alias("bound")).filter("bound > 0")
            .withColumn("before", F.coalesce(F.sum("size").over(best.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
        place = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        found, seen, reach = None, 0, first
        while True:
            now = buckets.filter((F.col("before") >= seen) & (F.col("before") < reach))
            left = buckets.filter(F.col("before") >= reach)
            if found is not None:
                kth = found.filter(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
                open_ = lambda b: b.join(kth, ["lang", "source"], "left").filter("kth is null or bound >= kth").drop("kth")
                now, left = open_(now), open_(left)
            new = e.join(small(now.select("lang", "source", "bucket")), ["lang", "source", "bucket"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            found = durable((new if found is None else found.drop("rank").unionByName(new)).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k))
            kth = found.filter(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
            if left.join(kth, ["lang", "source"], "left").filter("kth is null or bound >= kth").isEmpty():
                return found
            seen, reach = reach, reach * FASTER


def report(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of `docs(lang, source, text, ..)`.

    Part `pair`: every other source of the language, the most distant first. Part `term`:
    the k terms by which a source exceeds its language. Ranks go by value, then item in the
    order of UTF-8. Null text, lang and source count as ''; sources without kept terms have
    pairs and no terms; a lone source has no pair; an empty table gives no rows; repeated
    rows count as often as they come; further columns are not looked at.
    """
    audit = Audit(docs, min_docs)
    far = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = audit.pairs().select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(far).alias("rank"))
    return pairs.unionByName(audit.top_terms(k).withColumn("part", F.lit("term")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
with d as (
  select coalesce(lang, '') lang, coalesce(source, '') source,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') terms
  from documents),
used as (select lang, source, unnest(terms) term from d),
docs as (select lang, term, count(*) n_docs from (select lang, unnest(list_distinct(terms)) term from d) group by all having count(*) >= 30),
kept as (select lang, term from docs),
grp as (select distinct lang, source from d),
cnt as (select lang, source, term, count(*) n from used join kept using (lang, term) group by all),
v as (select lang, count(*) v from kept group by all),
dense as (select g.lang, g.source, k.term, coalesce(c.n, 0) n from grp g join kept k using (lang) left join cnt c using (lang, source, term)),
n_group as (select lang, source, sum(n) n_all from dense group by all),
of_group as (select x.lang, x.source, x.term, x.n, 1 + (1000000000::hugeint * (x.n + 5)) // (g.n_all + 5 * v.v)::hugeint p
  from dense x join n_group g using (lang, source) join v using (lang)),
of_term as (select lang, term, sum(n) n from cnt group by all),
n_lang as (select lang, sum(n) n_all from of_term group by all),
of_lang as (select t.lang, t.term, 1 + (1000000000::hugeint * (t.n + 5)) // (l.n_all + 5 * v.v)::hugeint q from of_term t join n_lang l using (lang) join v using (lang)),
apart as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value from of_group a join of_group b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, b.source item, coalesce(x.value, 0) value from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
term as (select g.lang, g.source, g.term item, g.p - l.q value from of_group g join of_lang l using (lang, term) where g.n > 0 and g.p > l.q),
ranked as (
  select lang, source, 'pair' part, item, value, row_number() over (partition by lang, source order by value desc, item) rank from pair
  union all
  select lang, source, 'term' part, item, value, row_number() over (partition by lang, source order by value desc, item) rank from term)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 50
"""
