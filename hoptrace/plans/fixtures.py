"""Relations of reads, alignments and elements, derived from the given tables by arithmetic.

The same SQL serves Spark and DuckDB, but for the one function named in :func:`sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "part", "documents", "benchmark")

GENOME_ALN = """
WITH k AS (SELECT *, CAST(l_quantity AS INT) + 20 AS len,
    CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand,
    CASE WHEN l_orderkey % 2 = 0 THEN 'start' ELSE 'end' END AS fs,
    (l_partkey + 1) * 5000 + (l_orderkey % 3) * 40 AS s0 FROM lineitem),
r AS (SELECT concat('Chr', CAST(l_partkey % 5 + 1 AS STRING)) AS chrom, strand,
    concat('read_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_',
           CAST(l_suppkey AS STRING), '/', CAST(l_linenumber % 2 + 1 AS STRING),
           CASE l_returnflag WHEN 'A' THEN concat(':', fs, ':5') WHEN 'R' THEN concat(':', fs, ':3') ELSE '' END) AS name,
    CASE WHEN l_returnflag = 'N' THEN CASE WHEN strand = '+' THEN s0 - 50 - l_orderkey % 200 - len ELSE s0 + 50 + l_orderkey % 200 END
         WHEN (strand = '+') = (fs = 'start') THEN s0 ELSE s0 + 2 - len + 1 END AS gstart, len,
    CAST(round(l_discount * 100) AS INT) % 2 AS nm,
    CASE WHEN CAST(round(l_tax * 100) AS INT) % 4 = 0 THEN concat(CAST(len - 5 AS STRING), 'M5S') ELSE concat(CAST(len AS STRING), 'M') END AS cigar,
    concat('TE', CAST(l_suppkey % 7 AS STRING)) AS te_name FROM k)
SELECT chrom, name, strand, gstart, gstart + len - 1 AS gend, nm, cigar, te_name FROM r
"""

TE_ALN = """
WITH k AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 0 WHEN l_orderkey % 3 = 1 THEN 36 ELSE 3 END AS qstart,
    CASE WHEN l_orderkey % 5 < 2 THEN 99 WHEN l_orderkey % 5 = 2 THEN 63 ELSE 95 END AS qend,
    CAST(147 + (l_partkey % 5) * 70 AS INT) AS te_len,
    CAST(round(l_discount * 100) AS INT) % 3 AS mismatch FROM lineitem),
t AS (SELECT *, CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber = 3 THEN 2
                     WHEN l_linenumber <= 5 THEN te_len - 1 - (qend - qstart) ELSE CAST(3 + l_partkey % 40 AS INT) END AS tstart FROM k)
SELECT concat('read_', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber % 2 + 1 AS STRING)) AS read_name, 100 AS qlen, qstart, qend,
    concat('TE', CAST(l_partkey % 5 AS STRING)) AS te_name, te_len, tstart, tstart + (qend - qstart) AS tend,
    (qend - qstart + 1) - mismatch AS match, mismatch, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand,
    concat(CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS ord,
    substring(translate(concat(md5(concat(CAST(l_orderkey AS STRING), 'a')), md5(concat(CAST(l_orderkey AS STRING), 'b')),
       md5(concat(CAST(l_orderkey AS STRING), 'c')), md5(concat(CAST(l_orderkey AS STRING), 'd'))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 100) AS seq FROM t
"""

REF_TE = """
SELECT concat('Chr', CAST(p_partkey % 5 + 1 AS STRING)) AS chrom, (p_partkey + 1) * 5000 AS te_start,
    (p_partkey + 1) * 5000 + 40 + p_size AS te_end, concat('TE', CAST(p_partkey % 7 AS STRING)) AS te_name,
    CASE WHEN p_size % 3 = 0 THEN '-' ELSE '+' END AS strand, p_size % 2 = 0 AS intact, p_partkey AS ord FROM part
"""

FULLREADS = """
SELECT regexp_replace(name, ':(start|end):[53]$', '') AS read_name, chrom, gstart - nm * 30 AS gstart, gend + nm * 30 AS gend
FROM genome_aln WHERE name LIKE '%:5' OR name LIKE '%:3'
"""

GENOME = """
SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', ''{g}), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac') AS seq FROM documents
"""

#: All reads of a library: both mates of each order.
READS = """
SELECT concat('read_', CAST(o_orderkey AS STRING), '/', m.mate) AS name, CAST(o_custkey AS STRING) AS seq FROM orders CROSS JOIN (SELECT '1' AS mate UNION ALL SELECT '2' AS mate) m
"""

#: Element matches, one row a read name and junction; several rows of a name differ.
REPEAT_ROWS = """
SELECT concat(read_name, CASE WHEN mismatch = 0 THEN ':start:5' WHEN mismatch = 1 THEN ':end:3' ELSE ':middle' END) AS name, te_name, strand, ord FROM te_aln
"""

DERIVED = {"genome_aln": GENOME_ALN, "te_aln": TE_ALN, "ref_te": REF_TE, "fullreads": FULLREADS, "genome": GENOME, "reads": READS, "repeat_rows": REPEAT_ROWS}


def sql(name: str, engine: str) -> str:
    """DuckDB's ``regexp_replace`` replaces all matches only if told to."""
    return DERIVED[name].replace("{g}", ", 'g'" if engine == "duckdb" else "")


class Relations:
    """The derived relations over the tables below one folder, each made on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in DERIVED:
            raise AttributeError(name)
        needed = {t: getattr(self, t) for t in (*TABLES, *DERIVED) if t != name and f"FROM {t}" in DERIVED[name]}
        text = DERIVED[name].replace("{g}", "")
        for t in needed:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
        return self.spark.sql(text, **needed)
