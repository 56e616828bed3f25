"""Secret scan with corpus-wide ownership frequency. DataFrame functions alone.

Every whole text is searched for assignments, access keys and hexadecimal runs (the base spans), and for candidates:
long mixed tokens that look like credentials. The hashes of all found values are counted over the corpus by distinct
repositories and owners. A value that many owners have, or that stands in many repositories even of few owners, is a
copied example; one that a single owner has in few repositories and that looks live (digits and letters mixed, many
different characters) is that owner's credential. The method adds the owned candidates' spans to the base ones, which
stay, and marks copied values.

``documents`` has no owner column: its ``source`` is the owner, and an owner's texts of one ``lang`` a repository.
Offsets are code points, ends exclusive. Values leave the text's row only as hashes.

Defined results: null and empty texts have no span. Null owners and repositories are owners and repositories of their
own. Rows that repeat a doc_id are scanned each. An empty table gives no row. Other columns pass through :func:`masked`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_by_size, join_hot, staged

# The base patterns, with the letters of names in either case.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
KINDS = ("assign", "access", "hex", "owned")


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters and more
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Owners, and repositories, from which on a value is a copied example; different characters that a live-looking value has at least.
COPIED_OWNERS, COPIED_REPOSITORIES, LIVE_CHARACTERS = 3, 4, 10
#: Code points that are covered together.
BLOCK = 1024
#: Matches wherever one of the patterns does: an assigned value of ``LEAST_VALUE`` characters, or a run as long as the shortest of the others.
ANY_SPAN = rf"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{{LEAST_VALUE}}}|[A-Za-z0-9+/_=-]{{16}}"""

_PLACE = "array<struct<start:bigint,kind:int,end:bigint>>"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,hash:string,live:boolean>>"


def looks_live(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is made once: what a lambda takes from outside is made again for each element."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op, zero: int = 0) -> Column:
    """Running fold of an array of longs (a bound one) by an associative ``op``: doubled shifts, so n log n steps in all."""
    powers = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p < F.size(values))
    shifted = lambda acc, p: F.concat(F.array_repeat(F.lit(zero).cast("bigint"), p), F.slice(acc, 1, F.size(acc) - p))
    return F.aggregate(powers, values, lambda acc, p: F.zip_with(acc, shifted(acc, p), op))


def spans(text: Column, pattern: str, kind: str, group: int, least: int) -> Column:
    """All leftmost matches that do not overlap, with places. Matches and what lies between them come in step."""
    whole, value, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    steps = F.zip_with(F.arrays_zip(whole.alias("w"), value.alias("v")), F.slice(gaps, 1, F.size(whole)), lambda m, g: F.struct(F.length(g).cast("bigint").alias("g"), F.length(m["w"]).cast("bigint").alias("n"), m["v"].alias("v")))

    def placed(x: Column) -> Column:
        ends = bound(F.transform(x, lambda m: m["g"] + m["n"]), lambda lengths: running(lengths, lambda a, b: a + b))
        return F.zip_with(x, ends, lambda m, end: F.struct((end - m["n"]).alias("start"), end.alias("end"), m["v"].alias("v")))

    found = F.filter(bound(steps, placed), lambda s: F.length(s["v"]) >= least)
    hashed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), F.sha2(s["v"], 256).alias("hash"), looks_live(s["v"]).alias("live")))
    return F.when(text.rlike(pattern), hashed).otherwise(F.array()).cast(_SPAN)


def clear_of(candidates: Column, base: Column) -> Column:
    """Those of ``candidates`` that touch no span of ``base``: none that starts before their end reaches over their start.

    One sort of both and a running maximum of the base ends, so that many of each are no pairs.
    """
    zero = F.lit(0).cast("bigint")
    ends = F.transform(candidates, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("base"), zero.alias("reach"), c.alias("span")))
    starts = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("reach"), b.alias("span")))

    def kept(x: Column) -> Column:
        reach = bound(F.transform(x, lambda e: e["reach"]), lambda r: running(r, lambda a, b: F.greatest(a, b)))
        marked = F.zip_with(x, reach, lambda e, r: F.struct(((e["base"] == 0) & (r <= e["span"]["start"])).alias("free"), e["span"].alias("span")))
        return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: m["span"])

    return F.when(F.size(candidates) > 0, bound(F.sort_array(F.concat(ends, starts)), kept)).otherwise(F.array()).cast(_SPAN)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, owner, repository, ``base`` and ``candidates`` of every row, written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("owner"), F.col("lang").alias("repository"), text.alias("text"))
    rows = rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "owner", "repository",
        spans(F.col("text"), ASSIGN, "assign", 2, LEAST_VALUE).alias("a"), spans(F.col("text"), ACCESS, "access", 0, 18).alias("k"),
        spans(F.col("text"), HEX, "hex", 0, 16).alias("h"), spans(F.col("text"), CANDIDATE, "owned", 0, 20).alias("c"),
    )
    rows = rows.withColumn("base", F.sort_array(F.concat("a", "k", "h")))
    free = bound(F.filter("c", lambda c: c["live"]), lambda c: clear_of(c, F.col("base")))
    counts = [F.size(x).cast("long").alias(n) for x, n in (("a", "n_assign"), ("k", "n_access"), ("h", "n_hex"))]
    return staged(rows.select("doc_id", "text_hash", "owner", "repository", *counts, "base", free.alias("candidates")), "spans")


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, live, owners, repositories, documents) of every found value. Each step counts groups of the one before."""
    found = scanned.select("owner", "repository", F.explode(F.concat("base", "candidates")).alias("s")).select("owner", "repository", "s.hash", "s.live")
    by_repository = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("found"), F.max("live").alias("live"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("found").alias("found"), F.max("live").alias("live"))
    return by_owner.groupBy("hash").agg(F.max("live").alias("live"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("found").alias("found"))


def verdicts(scanned: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """(hash, found, verdict) of every value that is ``copied`` or ``owned``, written."""
    verdict = F.when((F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories), "copied").when((F.col("owners") == 1) & F.col("live"), "owned")
    return staged(ownership(scanned).select("hash", "found", verdict.alias("verdict")).filter(F.col("verdict").isNotNull()), "ownership")


def judged(scanned: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``scanned`` with ``owned`` and ``copied``, the spans of its values of either kind, and ``spans``, all spans in order.

    Each span meets its value's verdict as a row, in a shuffle by hash, but for the few most frequent values, whose
    verdicts go to all tasks; then the spans of a row come together. Rows without values take no part.
    """
    counts = counts or verdicts(scanned)
    keys = [F.coalesce("doc_id", F.lit(0)).alias("k0"), F.col("doc_id").isNull().alias("k1"), F.col("text_hash").alias("k2")]
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    values = scanned.select(*keys, F.explode(F.concat("base", "candidates")).alias("s")).select("k0", "k1", "k2", F.col("s.hash").alias("hash"), place(F.col("s")).alias("place")).distinct()
    marked = join_hot(values, counts, "hash", "found")
    of = lambda v: F.collect_set(F.when(F.col("verdict") == v, F.col("place")))  # noqa: E731  a row's own spans
    by_row = marked.groupBy("k0", "k1", "k2").agg(of("owned").alias("owned"), of("copied").alias("copied"))
    rows = scanned.withColumns({"k0": keys[0], "k1": keys[1], "k2": keys[2]}).join(by_row, ["k0", "k1", "k2"], "left").drop("k0", "k1", "k2")
    none = F.array().cast(_PLACE)
    rows = rows.withColumns({"owned": F.coalesce("owned", none), "copied": F.coalesce("copied", none)})
    added = F.filter("owned", lambda s: s["kind"] == KINDS.index("owned"))
    return rows.withColumn("spans", F.sort_array(F.concat(F.transform("base", place), added)))


def listed(array: str | Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def covered(text: Column, spans: Column, cover: str) -> Column:
    """``text`` with the characters of ``spans`` (in order of their starts, perhaps overlapping) covered.

    The spans become a mask as long as the text, and both are cut into blocks that are laid over each other, so that
    the work grows with the text and not with the text for each span; blocks without a span stay as they are.
    """

    def mask(x: Column) -> Column:
        reach = bound(F.transform(x, lambda s: s["end"]), lambda ends: running(ends, lambda a, b: F.greatest(a, b)))

        def drawn(r: Column) -> Column:
            before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(r, 1, F.size(r) - 1))
            gap = lambda s, b: F.repeat(F.lit("."), F.greatest(s["start"] - b, F.lit(0)).cast("int"))
            inside = lambda s, b: F.repeat(F.lit("#"), F.greatest(s["end"] - F.greatest(s["start"], b), F.lit(0)).cast("int"))
            pieces = F.zip_with(x, before, lambda s, b: F.concat(gap(s, b), inside(s, b)))
            return F.concat(F.array_join(pieces, ""), F.repeat(F.lit("."), (F.length(text) - F.element_at(r, -1)).cast("int")))

        return bound(reach, drawn)

    blocks = lambda t: F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    laid = lambda t, m: F.array_join(F.zip_with(F.split(t, ""), F.split(m, ""), lambda c, k: F.when(k == "#", F.lit(cover)).otherwise(c)), "")
    both = F.zip_with(blocks(text), blocks(bound(spans, mask)), lambda t, m: F.when(F.contains(m, F.lit("#")), laid(t, m)).otherwise(t))
    return F.array_join(both, "")


def masked(docs: DataFrame, cover: str = "*") -> DataFrame:
    """``docs`` with every character of a found span covered, so that places and lengths stay. Its columns are unchanged.

    Spans of copied examples that the base rules alone have found are covered too: a base span stays a finding. Rows
    without anything like a value have no span and stay where they are; of the others the spans are joined by doc_id
    and text hash, copied to all tasks if they are few in number. Null texts stay null, and rows that repeat each other
    are covered alike.
    """
    scanned = scan(docs)
    counts = verdicts(scanned)
    rows = judged(scanned, counts).filter(F.size("spans") > 0).select(F.coalesce("doc_id", F.lit(0)).alias("k0"), F.col("doc_id").isNull().alias("k1"), F.col("text_hash").alias("k2"), "spans").dropDuplicates(["k0", "k1", "k2"])
    rows = staged(rows.withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), "found")
    discard(scanned, counts)
    own = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("_text"), F.col("doc_id").cast("long").alias("_id"))
    may = F.coalesce(F.col("_text").rlike(ANY_SPAN), F.lit(False))
    same = (F.coalesce("_id", F.lit(0)) == F.col("k0")) & (F.col("_id").isNull() == F.col("k1")) & (F.xxhash64("_text") == F.col("k2"))
    keyed = join_by_size(own.filter(may), rows, same, "left", weight=1 + F.size("spans"))
    text = F.when(F.col("spans").isNotNull(), covered(F.col("_text"), F.col("spans"), cover)).otherwise(F.col("_text")).alias("text")
    columns = lambda value: [value if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    return keyed.select(*columns(text)).unionByName(own.filter(~may).select(*columns(F.col("_text").alias("text"))))


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    examples = F.filter("copied", lambda s: s["kind"] != KINDS.index("owned"))  # candidates that are copied add no span
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
        F.size("owned").cast("long").alias("n_owned"), F.size(examples).cast("long").alias("n_copied"),
    )
