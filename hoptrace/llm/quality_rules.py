"""Quality rules with adaptive thresholds. DataFrame functions alone.

Measures of every whole text are summed into mergeable quantile sketches per language and source: counts on a grid of
integer steps that keeps a value's first ``GRID_BITS`` binary digits, without a top. So sketches add up in any order
to the same result, and a quantile is off by a 32nd of its value at most.

Every threshold is a quantile of the text's own group; no measure has a cutoff of its own. A group's distribution is
drawn towards its language's by ``PRIOR`` texts' weight, and a language's so towards that of all, which steadies small
groups: F = (own count + PRIOR * F of the wider group) / (own total + PRIOR). A text is rejected if

* one of its measures is beyond its group's 0.99 quantile, or
* two or more are beyond their 0.95 quantiles. Such a quantile that is no higher than the group's median, as for
  measures that are zero as a rule, marks no tail and is not used.

The mean word length counts as beyond on its low side as well (0.01 and 0.05). Thresholds are joined to the texts'
measures; the texts themselves are never shuffled.

Defined results: null and empty texts have no words and fail the base rules. Null languages and sources are groups of
their own. A text that equals a threshold is kept, so one that is alone in the corpus is. Rows that repeat a doc_id are
judged each. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, staged, words_of

WINDOW_WORDS, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Weight of the wider group in texts; quantiles for one measure alone and for two or more; digits of the grid.
PRIOR, EXTREME, MILD, GRID_BITS = 20, 0.99, 0.95, 6
#: Measure: (numerator, factor, denominator, whether low values are beyond as well).
MEASURES = {
    "symbols": ("n_symbols", 1000, "word_chars", False),
    "word_length": ("word_chars", 10, "n_words", True),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", False),
    "repeats": ("n_repeat_words", 1000, "n_words", False),
}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base measures. The repeated windows are looked for where a window occurs twice at all."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    counted = rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )

    def doubled(h: str, step: int) -> Column:
        """Hashes of runs twice as long, from those of runs of ``step`` words."""
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, 1, n), F.slice(F.col(h), step + 1, n), lambda a, b: F.xxhash64(a, b))

    kept = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    counted = counted.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines")))
    runs = counted.select(*kept, doubled("h1", 1).alias("h2")).select(*kept, doubled("h2", 2).alias("h4")).select(*kept, doubled("h4", 4).alias("h8"))
    placed = F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("h8")) < F.size("h8")
    runs = runs.select(*kept, F.when(some, placed).alias("placed"))
    twice = F.filter("placed", lambda x, i: (x["h"] == F.get("placed", i - 1)["h"]) | (x["h"] == F.get("placed", i + 1)["h"]))
    runs = runs.select(*kept, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"))
    n = F.size("at") - 1
    covered = F.aggregate(F.zip_with(F.slice("at", 1, n), F.slice(F.col("at"), 2, n), lambda a, b: F.least(b - a, F.lit(WINDOW_WORDS))), F.lit(WINDOW_WORDS).cast("long"), lambda s, x: s + x)
    runs = runs.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), covered).otherwise(F.lit(0)).cast("long")).drop("at")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return runs.withColumn("base_failed", failed)


def grid_step(value: Column) -> Column:
    """The least number with the same first ``GRID_BITS`` binary digits and the same length."""
    cut = F.greatest(F.length(F.bin(value)) - GRID_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def step_of(measure: str) -> Column:
    """The grid step of a text's measure; null without a denominator."""
    top, factor, below, _ = MEASURES[measure]
    return grid_step(F.expr(f"CASE WHEN {below} > 0 THEN ({top} * {factor}) DIV {below} END"))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, step, n): the grid sketch of each group, from texts that pass the base rules."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), step_of(m).alias("step")) for m in MEASURES])).alias("c")
    found = rows.filter(~F.col("base_failed")).select("lang", "source", cells).select("lang", "source", "c.measure", "c.step")
    return found.filter(F.col("step").isNotNull()).groupBy("lang", "source", "measure", "step").agg(F.count("*").alias("n"))


def _same(keys: list[str]) -> Column:
    """Whether the sides ``a`` and ``b`` of a join agree in ``keys``, nulls included."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out


def _drawn(sketch: DataFrame, wider: DataFrame, keys: list[str], of: list[str], prior: float) -> DataFrame:
    """(keys, measure, step, f): each group's distribution, drawn towards that of its wider group (``of``, measure, step, f)."""
    own = sketch.groupBy(*keys, "measure", "step").agg(F.sum("n").alias("n"))
    group = [*keys, "measure"]
    groups = own.select(*group).distinct()
    grid = groups.alias("a").join(wider.alias("b"), _same([*of, "measure"])).select(*[F.col(f"a.{k}") for k in group], "b.step", F.col("b.f").alias("wide"))
    both = grid.alias("a").join(own.alias("b"), _same([*group, "step"]), "left").select(*[F.col(f"a.{c}") for c in (*group, "step", "wide")], F.coalesce("b.n", F.lit(0)).alias("n"))
    own_group = Window.partitionBy(*group)
    upto = F.sum("n").over(own_group.orderBy("step")).cast("double")
    total = F.sum("n").over(own_group).cast("double")
    return both.withColumn("f", (upto + F.lit(float(prior)) * F.col("wide")) / (total + F.lit(float(prior)))).select(*group, "step", "f")


def distributions(sketch: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(lang, source, measure, step, f): f is the share of texts up to a step. At most some 700 steps a measure."""
    every = sketch.groupBy("measure", "step").agg(F.sum("n").alias("n"))
    measure = Window.partitionBy("measure")
    overall = every.select("measure", "step", (F.sum("n").over(measure.orderBy("step")).cast("double") / F.sum("n").over(measure).cast("double")).alias("f"))
    by_lang = staged(_drawn(sketch, overall, ["lang"], [], prior), "languages")
    return _drawn(sketch, by_lang, ["lang", "source"], ["lang"], prior)


def thresholds(sketch: DataFrame, prior: float = PRIOR, extreme: float = EXTREME, mild: float = MILD) -> DataFrame:
    """A row per (lang, source) with a struct per measure: median, extreme, mild, low_extreme, low_mild (grid steps)."""
    levels = {"median": 0.5, "extreme": extreme, "mild": mild, "low_extreme": 1 - extreme, "low_mild": 1 - mild}
    at = [F.min(F.when(F.col("f") >= q, F.col("step"))).alias(name) for name, q in levels.items()]
    found = distributions(sketch, prior).groupBy("lang", "source", "measure").agg(*at)
    return found.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.struct(*levels))).alias(f"at_{m}") for m in MEASURES])


def rejected() -> Column:
    """The method's verdict, from the measures and their group's thresholds."""
    one, two = F.lit(False), F.lit(0)
    for m, (_, _, _, both) in MEASURES.items():
        step, at = step_of(m), F.col(f"at_{m}")
        extreme, mild = step > at["extreme"], (step > at["mild"]) & (at["mild"] > at["median"])
        if both:
            extreme, mild = extreme | (step < at["low_extreme"]), mild | ((step < at["low_mild"]) & (at["low_mild"] < at["median"]))
        one = one | F.coalesce(extreme, F.lit(False))
        two = two + F.coalesce(mild, F.lit(False)).cast("int")
    return one | (two >= 2)


def apply_rules(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of ``docs`` (doc_id, text, lang, source)."""
    rows = staged(measures(docs), "measures")
    found = staged(thresholds(staged(sketches(rows), "sketches"), **kw), "thresholds").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rows.join(found, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected()).alias("kept"))


def op8_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
