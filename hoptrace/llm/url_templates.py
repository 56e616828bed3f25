"""URL filter: a path-template tree per host, judged by smoothed labelled purity.

1. A url's host and path are cut out; the path is split into segments, however many.
2. Segments that look variable (digits, long hexadecimal or mixed runs, dates) become wildcards at once; any file
   ending is kept. From the top down, a tree node with more than ``max_children`` different children turns its rare
   ones into wildcards as well.
3. From the leaves up, siblings at one level whose templates are equal everywhere else are compared by their labelled
   shares: one that differs from all its other siblings together (two-proportion test at ``z``) stays apart, the others
   merge into one wildcard and their counts are summed. So branches merge at every level, also over inner folders.
4. A template's purity is (good + strength * base) / (labelled + strength), base being that of all labels; templates
   under ``least_purity`` are rejected.

Only levels that change anything are worked on: the next one, down or up, with a wide node or with siblings is found over
all levels at once, so a deep tree costs no more steps than it has such levels.

All counts are grouped sums, so a host with a third of all urls is summed before it is shuffled, and the levels work on
distinct templates. Urls meet their template's verdict in a shuffle, but for the most frequent templates, which go to
all tasks.

Defined results: a url that is null or has no ``://`` has empty host and path, and is allowed unless a rule fits. Rows
that repeat a page_id or a url are judged alike. Without labels no template is rejected. An empty table gives no row.
Columns other than ``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, join_hot, staged

#: Rules of the registered query: (verdict, host suffix, path prefix). Fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

MAX_CHILDREN, Z, STRENGTH, LEAST_PURITY = 50, 2.6, 8.0, 0.4
WILD = "*"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]], what: str = "rule") -> Column:
    """The longest rule that fits (by its text, then the order given); ``what``: its text or its verdict."""
    out = F.lit(None).cast("string")
    for verdict, suffix, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        out = F.when(fits, F.lit(suffix + prefix if what == "rule" else verdict)).otherwise(out)
    return out


def segments_of(path: Column) -> Column:
    """Segments with those of variable look as wildcards; a short ending such as .html stays."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(s: Column) -> Column:
        ending = F.regexp_extract(s, r"^.*?(\.[A-Za-z]{1,5})?$", 1)
        body = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
        variable = body.rlike(r"^[0-9._:-]+$") | body.rlike(r"^[0-9a-fA-F-]{16,}$") | body.rlike(r"^(?=.*[0-9].*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{12,}$") | body.rlike(r"[0-9]{4,}")
        return F.when(variable, F.concat(F.lit(WILD), ending)).otherwise(s)

    return F.transform(parts, general)


def _before(level: int | Column) -> Column:
    return F.slice("segments", F.lit(1), F.lit(level) if isinstance(level, int) else level)


def _behind(level: int | Column) -> Column:
    return F.slice("segments", (F.lit(level) if isinstance(level, int) else level) + 2, F.size("segments"))


def _with_wildcard(level: int) -> Column:
    return F.concat(_before(level), F.array(F.lit(WILD)), _behind(level))


def _at_all_levels(templates: DataFrame, *around) -> DataFrame:
    """(host, level, child, around) for each segment of each template; ``around``: a digest of the segments in the given parts.

    Segments are not empty and hold no slash, so joined they are as good as the list.
    """
    level = F.col("level")
    out = templates.filter(F.size("segments") > 0).select("host", "segments", F.explode(F.sequence(F.lit(0), F.size("segments") - 1)).alias("level"))
    parts = F.array_join(F.concat(*[part(level) for part in around]), "/")
    return out.select("host", "level", F.get("segments", level).alias("child"), F.sha2(parts, 256).alias("around"))


def _replaced(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    out = staged(after.select("host", "first", "segments", "n", "k", "g"), name)
    discard(before)
    return out


def _narrowed(templates: DataFrame, max_children: int) -> DataFrame:
    """``templates`` (staged) with rare children of wide nodes as wildcards, from the top down."""
    done = -1
    while True:
        children = _at_all_levels(templates, _before).filter(F.col("level") > done).distinct().groupBy("host", "level", "around").agg(F.count("*").alias("children"))
        done = children.filter(F.col("children") > max_children).agg(F.min("level")).first()[0]
        if done is None:
            return templates
        keyed = templates.withColumns({"before": _before(done), "child": F.get("segments", F.lit(done))})
        nodes = keyed.filter(F.col("child").isNotNull()).groupBy("host", "before", "child").agg(F.sum("n").alias("of_child"))
        wide = nodes.groupBy("host", "before").agg(F.count("*").alias("children"), F.sum("of_child").alias("total")).filter(F.col("children") > max_children)
        rare = nodes.join(wide, ["host", "before"]).filter(F.col("of_child") * max_children < F.col("total")).select("host", "before", "child", F.lit(True).alias("rare"))
        cut = F.when(F.col("rare"), _with_wildcard(done)).otherwise(F.col("segments"))
        templates = _replaced(templates, keyed.join(rare, ["host", "before", "child"], "left").withColumn("segments", cut), f"level-{done}")


def _merged(templates: DataFrame, z: float) -> DataFrame:
    """``templates`` (staged) with siblings that are alike as wildcards, from the leaves up.

    A node has no more than ``max_children`` frequent children and as many others, so siblings are few in a window.
    """
    keys, done = ["host", "before", "behind"], None
    siblings = Window.partitionBy(*keys)
    while True:
        levels = _at_all_levels(templates, _before, _behind)
        levels = levels if done is None else levels.filter(F.col("level") < done)
        several = levels.groupBy("host", "level", "around").agg(F.min("child").alias("least"), F.max("child").alias("most"))
        done = several.filter(F.col("least") != F.col("most")).agg(F.max("level")).first()[0]
        if done is None:
            return templates
        keyed = templates.withColumns({"before": _before(done), "behind": _behind(done), "child": F.get("segments", F.lit(done))})
        members = keyed.filter(F.col("child").isNotNull()).groupBy(*keys, "child").agg(F.sum("k").alias("of_k"), F.sum("g").alias("of_g"))
        members = members.withColumns({"all_k": F.sum("of_k").over(siblings), "all_g": F.sum("of_g").over(siblings)})
        rest_k, rest_g, p = F.col("all_k") - F.col("of_k"), F.col("all_g") - F.col("of_g"), F.try_divide("all_g", "all_k")
        spread = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), "of_k") + F.try_divide(F.lit(1), rest_k)))
        apart = F.coalesce(F.try_divide(F.abs(F.try_divide("of_g", "of_k") - F.try_divide(rest_g, rest_k)), spread) > z, F.lit(False))
        judged = members.withColumn("apart", apart).withColumn("alike", F.count(F.when(~F.col("apart"), 1)).over(siblings))
        merging = judged.filter(~F.col("apart") & (F.col("alike") > 1)).select(*keys, "child", F.lit(True).alias("merges"))
        cut = F.when(F.col("merges"), _with_wildcard(done)).otherwise(F.col("segments"))
        templates = _replaced(templates, keyed.join(merging, [*keys, "child"], "left").withColumn("segments", cut), f"merged-{done}")


def template_verdicts(urls: DataFrame, max_children: int = MAX_CHILDREN, z: float = Z, strength: float = STRENGTH, least_purity: float = LEAST_PURITY) -> DataFrame:
    """From (host, key, label or null) rows: (host, key, urls, template, purity, verdict), one per host and key (segments with looks alone generalised)."""
    sums = urls.groupBy("host", "key").agg(F.count("*").alias("n"), F.count("label").alias("k"), F.coalesce(F.sum("label"), F.lit(0)).alias("g"))
    sums = staged(sums.select("host", F.col("key").alias("first"), F.col("key").alias("segments"), "n", "k", "g"), "templates")
    base = sums.agg(F.sum("g"), F.sum("k")).first()
    mean = float(base[0] / base[1]) if base[1] else 1.0
    tree = _merged(_narrowed(sums, max_children), z)
    purity = (F.sum("g") + strength * mean) / (F.sum("k") + strength)
    judged = staged(tree.groupBy("host", "segments").agg(purity.alias("purity")), "judged")
    template = F.concat(F.lit("/"), F.array_join("segments", "/"))
    out = tree.join(judged, ["host", "segments"])
    return out.select("host", F.col("first").alias("key"), F.col("n").alias("urls"), template.alias("template"), "purity", F.when(F.col("purity") < least_purity, "block").otherwise("allow").alias("verdict"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, **kw) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of ``pages``.

    ``labels``: (page_id, label) with label 1 good, 0 bad.
    """
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.filter(F.col("label").isNotNull()).groupBy("page_id").agg(F.max("label").cast("int").alias("label"))
    rows = staged(cut.join(known, "page_id", "left").withColumn("key", segments_of(F.col("path"))), "urls")
    place = F.struct("host", "key").alias("place")
    verdicts = staged(template_verdicts(rows, **kw).select(place, "urls", "template", "purity", F.col("verdict").alias("found")), "verdicts")
    joined = join_hot(rows.select("page_id", "host", "path", place), verdicts, "place", "urls", "left")
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(rule_for(host, path, rules, "verdict"), F.when(host == "", F.lit("allow")).otherwise(F.coalesce("found", F.lit("allow"))))
    return joined.select("page_id", "host", "path", rule_for(host, path, rules).alias("rule"), verdict.alias("verdict"), "template", "purity")


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry the number of the document they show as the last number of their path; that document's label is theirs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    shown = pages.select("page_id", F.expr("try_cast(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([0-9]+)[^0-9]*$', 1) AS BIGINT)").alias("doc_id"))
    return judge_urls(pages, shown.join(labels, "doc_id").select("page_id", "label"))
