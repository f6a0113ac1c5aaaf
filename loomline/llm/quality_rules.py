"""Quality rules with thresholds that adapt to language and source; DataFrame functions only.

Each measure becomes an integer bin, and counts by bin are the quantile sketch of a
group: counters that merge by addition, equal for any partitioning and exact to one
bin. Shares in thousandths are bins themselves; the mean word length, which has no
upper end, keeps its three leading digits, so there are 900 bins for each power of ten
and none holds what differs by over a hundredth. Documents are compared by their bins.

Sketches of (language, source) merge into sketches of a language and of all rows. A
group's quartile is its language's, moved no further than the group's own documents
compel: into the interval that holds the group's quartile with 99 % confidence, read
off the sketch as two order statistics. A language's quartile is that of all rows,
moved alike. So few documents say little, many decide, and no size switches the rule.
The fences that come out are joined to the documents.

A fence lies beyond the median by the spread of the half that junk does not reach (for
an upper fence the lower half), so up to half of a group may be junk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm.common import NOT_WS, WS, durable, free_name, numbered_columns, small

WINDOW = 8
MIN_WORDS = 20
#: Standard errors on either side of a quartile's interval.
Z = 2.576
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
#: measure: (spreads beyond the median, least distance from the median, upper, lower)
RULES = {
    "sym_pm": (6, 20, True, False),
    "dup_pm": (6, 500, True, False),
    "adj_pm": (6, 100, True, False),
    "len_pc": (6, 200, True, True),
}


def _leading(x: str, kind: str) -> str:
    """SQL for the three leading digits of a whole number, zeros after them; `kind` is the engine's type of strings."""
    step = f"cast(pow(10, greatest(length(cast({x} as {kind})) - 3, 0)) as bigint)"
    over = "div" if kind == "string" else "//"
    return f"({x} {over} {step}) * {step}"


def measures(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """`docs` with one struct column of counts and binned measures, and that column's name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    m, words, lines, grams, starts = (free_name(docs, c) for c in ("m", "m_words", "m_lines", "m_grams", "m_starts"))
    step = docs.withColumn(words, F.filter(F.split(text, WS + "+"), lambda w: w != ""))
    step = step.withColumn(lines, F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_WS)))
    step = step.withColumn(grams, F.expr(
        f"case when size({words}) >= {WINDOW} then transform(sequence(1, size({words}) - {WINDOW - 1}), "
        f"i -> xxhash64(slice({words}, i, {WINDOW}))) else cast(array() as array<bigint>) end"))
    # Starts of windows found twice or more: sort (hash, start) and compare neighbours.
    twice = F.array_sort(F.transform(F.expr(f"""element_at(transform(array(sort_array(transform({grams}, (h, i) -> struct(h as h, i as i)))), s ->
        filter(s, (x, k) -> (k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k + 1 < size(s) and s[least(k + 1, size(s) - 1)].h = x.h))), 1)"""), lambda x: x["i"]))
    none = F.size(F.array_distinct(grams)) == F.size(grams)
    step = step.withColumn(starts, F.when(none, F.expr("cast(array() as array<int>)")).otherwise(twice))
    # Plain columns, so that the optimizer evaluates each once for all that refer to it.
    counts = {
        "n_words": F.size(words), "word_chars": F.length(F.regexp_replace(text, WS + "+", "")), "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_lines": F.size(lines),
        "n_repeat_words": F.expr(f"aggregate({starts}, struct(0L as n, -{WINDOW} as last), (a, x) -> struct(a.n + least({WINDOW}, x - a.last) as n, x as last), a -> a.n)"),
        "n_adjacent": F.size(F.expr(f"filter({words}, (w, i) -> i > 0 and w = {words}[greatest(i - 1, 0)])")),
    }
    at = {k: free_name(step, f"{m}_{k}") for k in counts}
    step = step.withColumns({at[k]: c.cast("long") for k, c in counts.items()}).drop(words, lines, grams, starts)
    least = lambda k: f"greatest({at[k]}, 1L)"
    out = step.withColumn(m, F.struct(
        *[F.col(at[k]).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.expr(f"{at['n_words']} < {MIN_WORDS} or 100 * {at['n_repeat_words']} > 30 * {at['n_words']}").alias("base_failed"),
        F.expr(f"1000 * {at['n_symbols']} div {least('word_chars')}").alias("sym_pm"),
        F.expr(f"1000 * {at['n_dup_lines']} div {least('n_lines')}").alias("dup_pm"),
        F.expr(f"1000 * {at['n_adjacent']} div {least('n_words')}").alias("adj_pm"),
        F.expr(f"100 * {at['word_chars']} div {least('n_words')}").alias("len_pc"),
    ))
    out = out.withColumn(m, F.col(m).withField("len_pc", F.expr(_leading(f"{m}.len_pc", "string"))))
    return out.drop(*at.values()), m


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n) of rows with (lang, source) and the columns of RULES.

    Rows that fail the base rules are left out. At most 1001 rows for each group and
    measure in thousandths, and 900 for each power of ten of the mean word length.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("bin")) for k in RULES]))
    return (
        measured.filter("not base_failed").select("lang", "source", pairs.alias("p"))
        .groupBy("lang", "source", "p.measure", "p.bin").agg(F.count("*").alias("n"))
    )


def _rank(p: float, side: str = "") -> str:
    """SQL for the rank of a quantile among `total` values, or of an end of its interval."""
    total = "cast(total as double)"
    return f"({total} * {p}e0 {side} {Z}e0 * sqrt({total} * {p * (1 - p)}e0))" if side else f"({total} * {p}e0)"


def _order_statistics() -> dict[str, str]:
    """SQL over bins with `upto` values at or below, of `total`: each quartile, and the ends of its interval, null where it is open."""
    first = lambda rank, has="true": f"min(case when {has} and upto >= {rank} then bin end)"
    out = {}
    for q, p in QUARTILES.items():
        low, high = _rank(p, "-"), _rank(p, "+")
        out |= {q: first(_rank(p)), f"{q}_lo": first(low, f"{low} > 0"), f"{q}_hi": first(high, f"{high} <= total")}
    return out


def _quartiles(hist: DataFrame, *by: str) -> DataFrame:
    """(*by, measure, and _order_statistics()), one row for each group and measure."""
    g = hist.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    every = W.partitionBy(*by, "measure")
    g = g.withColumn("upto", F.sum("n").over(every.orderBy("bin"))).withColumn("total", F.sum("n").over(every))
    return g.groupBy(*by, "measure", "total").agg(*[F.expr(e).alias(k) for k, e in _order_statistics().items()])


def _moved(q: str, wider: str, own: str) -> str:
    """SQL for the wider group's quartile, moved into the interval of the group's own."""
    return f"least(greatest({wider}, coalesce({own}{q}_lo, {wider})), coalesce({own}{q}_hi, greatest({wider}, coalesce({own}{q}_lo, {wider}))))"


def _fences() -> dict[str, str]:
    """SQL over a group's measures with their quartiles: the bounds of each rule."""
    out = {}
    for k, (spreads, least, upper, lower) in RULES.items():
        if upper:
            out[f"{k}_hi"] = f"max(case when measure = '{k}' then q50 + {spreads} * (q50 - q25) + {least} end)"
        if lower:
            out[f"{k}_lo"] = f"max(case when measure = '{k}' then q50 - {spreads} * (q75 - q50) - {least} end)"
    return out


BOUNDS = list(_fences())


def thresholds(hist: DataFrame) -> DataFrame:
    """(t_lang, t_source, bounds), one row for each group of the sketches; nulls are groups."""
    part = lambda df, to: df.select(*[F.col(c).alias(f"{to}{c}") for c in df.columns])
    own, lang = part(_quartiles(hist, "lang", "source"), "o_"), part(_quartiles(hist, "lang"), "l_")
    every = part(_quartiles(hist.withColumn("one", F.lit(1)), "one"), "a_")
    joined = own.join(lang, F.col("o_lang").eqNullSafe(F.col("l_lang")) & (F.col("o_measure") == F.col("l_measure"))).join(F.broadcast(every), F.col("o_measure") == F.col("a_measure"))
    joined = joined.withColumns({f"m_{q}": F.expr(_moved(q, f"a_{q}", "l_")) for q in QUARTILES})
    moved = joined.select("o_lang", "o_source", F.col("o_measure").alias("measure"), *[F.expr(_moved(q, f"m_{q}", "o_")).alias(q) for q in QUARTILES])
    return moved.groupBy(F.col("o_lang").alias("t_lang"), F.col("o_source").alias("t_source")).agg(*[F.expr(e).alias(b) for b, e in _fences().items()])


def verdict() -> str:
    return " and ".join([f"coalesce({k} <= {k}_hi, true)" for k in RULES] + ["coalesce(len_pc >= len_pc_lo, true)"])


def judge(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, the counts, base_failed and kept, one row for each document.

    Null texts have no words and fail the base rules. Null languages and sources are
    groups of their own. Tied values share a bin. Other columns are not read. New names
    get underscores where `keep` has them.
    """
    measured, m = measures(docs.select(*dict.fromkeys([*keep, lang_col, source_col, text_col])), text_col)
    flat = measured.select(
        F.struct(*keep).alias("kept_columns"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), f"{m}.*")
    # Measuring costs more than writing: the texts are measured once, for the sketches and for the verdicts.
    flat = durable(flat)
    fences = small(durable(thresholds(durable(sketches(flat)))))
    on = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    new = {k: F.col(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")} | {"kept": F.expr(f"not base_failed and {verdict()}")}
    columns = docs.select(*keep)
    return flat.join(fences, on, "left").select("kept_columns.*", *[c.alias(free_name(columns, k)) for k, c in new.items()])


def quality_filter(docs: DataFrame, **kw) -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns they had, clashing names included."""
    plain, at = numbered_columns(docs)
    # Numbered names clash with none of the new ones.
    judged = judge(plain, lang_col=at[kw.pop("lang_col", "lang")], source_col=at[kw.pop("source_col", "source")],
                   text_col=at[kw.pop("text_col", "text")], keep=tuple(plain.columns), **kw)
    return judged.filter("kept").select(*plain.columns).toDF(*docs.columns)


def op3_quality_rules(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _op3_sql() -> str:
    every = ", ".join(f"{{'measure': '{k}', 'bin': {k}}}" for k in RULES)
    def quartiles(name: str, by: str) -> str:
        part = f"PARTITION BY {by}measure"
        return f"""{name}_c AS (SELECT {by}measure, bin, sum(n) AS n FROM h GROUP BY {by}measure, bin),
{name}_u AS (SELECT *, sum(n) OVER ({part} ORDER BY bin) AS upto, sum(n) OVER ({part}) AS total FROM {name}_c),
{name} AS (SELECT {by}measure, {', '.join(f'{e} AS {k}' for k, e in _order_statistics().items())} FROM {name}_u GROUP BY {by}measure, total)"""

    moved = lambda wider, own: ", ".join(f"{_moved(q, f'{wider}.{q}', f'{own}.')} AS {q}" for q in QUARTILES)
    return rf"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
starts AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM starts) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
m AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x, k: k > 1 AND x = w[k - 1])) AS n_adjacent
  FROM t LEFT JOIN rep USING (doc_id)),
b0 AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS sym_pm,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_pm, 1000 * n_adjacent // greatest(n_words, 1) AS adj_pm, 100 * word_chars // greatest(n_words, 1) AS len_pc FROM m),
b AS (SELECT * REPLACE ({_leading('len_pc', 'varchar')} AS len_pc) FROM b0),
h AS (SELECT lang, source, p.measure AS measure, p.bin AS bin, count(*) AS n FROM (SELECT lang, source, unnest([{every}]) AS p FROM b WHERE NOT base_failed) GROUP BY ALL),
{quartiles('o', 'lang, source, ')},
{quartiles('l', 'lang, ')},
{quartiles('a', '')},
lm AS (SELECT l.lang, l.measure, {moved('a', 'l')} FROM l JOIN a ON l.measure = a.measure),
om AS (SELECT o.lang, o.source, o.measure, {moved('lm', 'o')} FROM o JOIN lm ON o.lang IS NOT DISTINCT FROM lm.lang AND o.measure = lm.measure),
f AS (SELECT lang, source, {', '.join(f'{e} AS {b}' for b, e in _fences().items())} FROM om GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict()} AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""


OP3_SQL = _op3_sql()
