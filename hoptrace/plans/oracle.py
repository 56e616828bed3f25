"""DuckDB SQL for every registered query, put together from named steps."""

from __future__ import annotations

import re

from ..operators.seeds import ADDED, SCATTER
from .fixtures import DERIVED, sql


def _read_seeds(k: int) -> str:
    """Seeds of both strands, every third place; k-mers that repeat up to three bases are left out."""
    same = " OR ".join(f"kmer[{p + 1}:] = kmer[:{k - p}]" for p in (1, 2, 3))
    return f"""SELECT * FROM (SELECT id, strand, q, upper(s[q + 1:q + {k}]) AS kmer FROM (SELECT *, unnest(range(0, len(s) - {k} + 1, 3)) AS q FROM
        (SELECT id, '+' AS strand, s FROM stretches UNION ALL SELECT id, '-' AS strand, reverse(translate(s, 'ACGTNacgtn', 'TGCANtgcan')) AS s FROM stretches))) WHERE NOT ({same})"""


def _library_seeds(k: int) -> str:
    return f"SELECT ref_name, r, upper(seq[r + 1:r + {k}]) AS kmer FROM (SELECT concat('d', doc_id) AS ref_name, seq, unnest(range(0, len(seq) - {k} + 1)) AS r FROM genome)"


def _votes(own: str, index: str, weight: int) -> str:
    return f"SELECT id, strand, ref_name, r - q AS diagonal, {weight} * count(*) AS seeds FROM {own} JOIN {index} USING (kmer) GROUP BY id, strand, ref_name, r - q HAVING count(*) >= 2"


def _kmer_values(k: int) -> str:
    """Scattered value of each k-mer of the letters, the lesser of both strands'; null for those that repeat up to three bases."""
    mixed = lambda v: f"(({v}) * {SCATTER} + {ADDED}) & {4**k - 1}"
    ahead = " + ".join(f"d{i} * {4 ** (k - 1 - i)}::BIGINT" for i in range(k))
    behind = " + ".join(f"(3 - d{i}) * {4**i}::BIGINT" for i in range(k))
    same = " OR ".join("(" + " AND ".join(f"d{i} = d{i + p}" for i in range(k - p)) + ")" for p in (1, 2, 3))
    along = ", ".join(f"lead(d0, {i}) OVER (PARTITION BY doc_id ORDER BY place) AS d{i}" for i in range(1, k))
    return f"""SELECT doc_id, place, last, CASE WHEN NOT ({same}) THEN least(one, two) END AS value, two < one AS reverse FROM (
        SELECT *, {mixed(ahead)} AS one, {mixed(behind)} AS two FROM (SELECT *, {along} FROM
        (SELECT doc_id, len(seq) - {k} AS last, unnest(range(0, len(seq))) AS place, ascii(unnest(string_split(translate(seq, 'acgt', '0123'), ''))) - 48 AS d0 FROM genome WHERE len(seq) >= {k})) WHERE place <= last)"""


def _chosen(values: str, w: int) -> str:
    """k-mers that are the least of a window of ``w``; a text with fewer is one window."""
    along = "PARTITION BY doc_id ORDER BY place ROWS BETWEEN"
    return f"""SELECT doc_id, place, value AS seed, reverse FROM (SELECT *, max(least_) OVER ({along} {w - 1} PRECEDING AND CURRENT ROW) AS top FROM (
        SELECT *, CASE WHEN place <= greatest(last - {w - 1}, 0) THEN min(value) OVER ({along} CURRENT ROW AND {w - 1} FOLLOWING) END AS least_ FROM {values})) WHERE value = top"""


STEPS = {
    "values_of_kmers": _kmer_values(13),
    "chosen_kmers": _chosen("values_of_kmers", 6),
    "stretches": """
        SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN x ELSE reverse(translate(x, 'ACGTNacgtn', 'TGCANtgcan')) END AS s FROM (SELECT doc_id, substring(seq, 1 + doc_id % 40, 100) AS x FROM genome)""",
    "short_own": _read_seeds(13),
    "short_index": _library_seeds(13),
    "long_own": _read_seeds(26),
    "long_index": _library_seeds(26),
    "frequent": "SELECT kmer FROM short_index GROUP BY kmer HAVING count(*) > 20",
    "rare_own": "SELECT * FROM short_own WHERE kmer NOT IN (SELECT kmer FROM frequent)",
    "rare_votes": _votes("rare_own", "short_index", 1),
    "repeated": """
        SELECT id FROM (SELECT id, max(n) AS n FROM (SELECT id, strand, count(*) AS n FROM short_own WHERE kmer IN (SELECT kmer FROM frequent) GROUP BY id, strand) GROUP BY id)
        LEFT JOIN (SELECT id, max(seeds) AS seeds FROM rare_votes GROUP BY id) USING (id) WHERE n > coalesce(seeds, 0)""",
    "again_own": "SELECT * FROM long_own WHERE id IN (SELECT id FROM repeated)",
    "long_votes": _votes("again_own", "long_index", 2),
    "all_votes": "SELECT id, strand, ref_name, diagonal, max(seeds) AS seeds FROM (SELECT * FROM rare_votes UNION ALL SELECT * FROM long_votes) GROUP BY id, strand, ref_name, diagonal",
    "clustered": """
        SELECT *, CAST(sum(nw) OVER (PARTITION BY chrom ORDER BY gstart, gend, nw DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_id
        FROM (SELECT *, CASE WHEN hi IS NULL OR gstart > hi + 1000 THEN 1 ELSE 0 END AS nw FROM
              (SELECT *, max(gend) OVER (PARTITION BY chrom ORDER BY gstart, gend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM genome_aln))""",
    "tagged": """
        SELECT *, regexp_extract(name, ':(start|end):([53])$', 1) AS kind, regexp_extract(name, ':(start|end):([53])$', 2) AS te_end FROM clustered""",
    "junc": """
        SELECT * EXCLUDE (te_name), CASE WHEN nm = 0 THEN te_name ELSE 'NA' END AS te_name, CASE WHEN (strand = '+') = (kind = 'start') THEN 'right' ELSE 'left' END AS side,
               CASE WHEN (strand = '+') = (kind = 'start') THEN gstart ELSE gend END AS position FROM tagged WHERE kind <> ''""",
    "orient": """
        SELECT *, CASE WHEN (te_end = '5' AND side = 'right') OR (te_end = '3' AND side = 'left') THEN '-' ELSE '+' END AS orientation FROM junc""",
    "supp": "SELECT * FROM tagged WHERE kind = ''",
    "sides": """
        SELECT chrom, cluster_id, coalesce(list_sort(list(DISTINCT position) FILTER (side = 'left')), []) AS lefts,
               coalesce(list_sort(list(DISTINCT position) FILTER (side = 'right')), []) AS rights FROM junc GROUP BY chrom, cluster_id""",
    "fold(chrom, cluster_id, lefts, rem, k, l, r)": """
        SELECT chrom, cluster_id, lefts, rights, 0, NULL::BIGINT, NULL::BIGINT FROM sides
        UNION ALL
        SELECT chrom, cluster_id, lefts, CASE WHEN abs(best - cur) <= 100 THEN list_filter(rem, lambda x: x <> best) ELSE rem END, k + 1, cur, CASE WHEN abs(best - cur) <= 100 THEN best END
        FROM (SELECT *, lefts[k + 1] AS cur, (list_sort(list_transform(rem, lambda x: {'d': abs(x - lefts[k + 1]), 'r': x})))[1].r AS best FROM fold WHERE k < len(lefts))""",
    "pairs": """
        SELECT chrom, cluster_id, l AS left_pos, r AS right_pos, row_number() OVER (ORDER BY chrom, cluster_id, l, r) AS pid FROM
        (SELECT chrom, cluster_id, l, r FROM fold WHERE k > 0 UNION ALL SELECT chrom, cluster_id, NULL, unnest(rem) FROM fold WHERE k = len(lefts))""",
    "ruled": """
        SELECT *, CASE WHEN known THEN right_pos ELSE coalesce(least(left_pos, right_pos), left_pos, right_pos) END AS start, CASE WHEN known THEN left_pos ELSE coalesce(least(left_pos, right_pos), left_pos, right_pos) END AS "end"
        FROM (SELECT *, coalesce(left_pos - right_pos + 1 > 0 AND left_pos - right_pos + 1 <= 20, false) AS known FROM pairs)""",
    "paired": """
        SELECT p.pid, o.* FROM orient o JOIN pairs p ON o.chrom = p.chrom AND o.cluster_id = p.cluster_id AND ((o.side = 'left' AND o.position = p.left_pos) OR (o.side = 'right' AND o.position = p.right_pos))""",
    "family": """
        SELECT pid, te_name FROM (SELECT pid, te_name, row_number() OVER (PARTITION BY pid ORDER BY count(*) DESC, te_name) AS k FROM paired WHERE te_name <> 'NA' GROUP BY pid, te_name) WHERE k = 1""",
    "called": """
        SELECT u.chrom, u.cluster_id, u.start, u."end", coalesce(f.te_name, 'NA') AS te_name, v.strand, CASE WHEN u.known THEN repeat('.', CAST(u."end" - u.start + 1 AS BIGINT)) ELSE 'UNK' END AS tsd, v.left_junction, v.right_junction, u.pid
        FROM ruled u JOIN (SELECT pid, count(*) FILTER (side = 'left') AS left_junction, count(*) FILTER (side = 'right') AS right_junction,
             CASE WHEN count(*) FILTER (orientation = '+') >= count(*) FILTER (orientation = '-') THEN '+' ELSE '-' END AS strand FROM paired GROUP BY pid) v USING (pid) LEFT JOIN family f USING (pid)""",
    "supported": """
        SELECT c.*, (SELECT count(*) FROM supp s WHERE s.chrom = c.chrom AND s.cluster_id = c.cluster_id AND s.strand = '+' AND s.gend <= c.start) AS left_support,
               (SELECT count(*) FROM supp s WHERE s.chrom = c.chrom AND s.cluster_id = c.cluster_id AND s.strand = '-' AND s.gstart >= c."end") AS right_support FROM called c""",
    "lone": """
        SELECT chrom, cluster_id, max(gend) FILTER (strand = '+') AS start, min(gstart) FILTER (strand = '-') AS "end", count(*) FILTER (strand = '+') AS left_support, count(*) FILTER (strand = '-') AS right_support
        FROM supp GROUP BY chrom, cluster_id HAVING count(*) FILTER (strand = '+') >= 2 AND count(*) FILTER (strand = '-') >= 2 AND max(gend) FILTER (strand = '+') <= min(gstart) FILTER (strand = '-')""",
    "probed": """
        SELECT p.pid, p.side, CASE WHEN p.side = 'left' THEN c."end" ELSE c.start END AS bp, regexp_replace(p.name, ':(start|end):[53]$', '') AS read_name, p.chrom FROM paired p JOIN called c USING (pid)""",
    "false_pid": """
        SELECT pid FROM (SELECT pid, side, CASE WHEN EXISTS (SELECT 1 FROM fullreads f WHERE f.read_name = p.read_name AND f.chrom = p.chrom AND f.gstart <= p.bp - 10 AND f.gend >= p.bp + 10) THEN 1 ELSE 0 END AS hit FROM probed p)
        GROUP BY pid HAVING count(*) FILTER (side = 'left') > 0 AND count(*) FILTER (side = 'right') > 0
           AND sum(hit) FILTER (side = 'left') >= 0.3 * count(*) FILTER (side = 'left') AND sum(hit) FILTER (side = 'right') >= 0.3 * count(*) FILTER (side = 'right')""",
    "surviving": "SELECT * FROM supported WHERE pid NOT IN (SELECT pid FROM false_pid) AND (left_junction >= 1 OR right_junction >= 1)",
    "found": """
        SELECT chrom, cluster_id, start, "end", te_name, strand, tsd, left_junction, right_junction, left_support, right_support, 'Non-reference, not found in reference' AS note FROM surviving
        UNION ALL
        SELECT chrom, cluster_id, start, "end", 'NA', '+', 'supporting_reads', 0, 0, left_support, right_support, 'Non-reference, supporting reads only' FROM lone l
        WHERE NOT EXISTS (SELECT 1 FROM surviving s WHERE s.chrom = l.chrom AND s.cluster_id = l.cluster_id)""",
    "matched": """
        SELECT j.*, t.te_name AS ref_te_name, t.te_start AS ref_te_start, t.te_end AS ref_te_end, t.strand AS ref_strand, t.ord AS ref_ord FROM junc j JOIN ref_te t
        ON j.chrom = t.chrom AND t.intact AND (abs(t.te_start - j.position) <= 5 OR abs(t.te_end - j.position) <= 5)
        QUALIFY row_number() OVER (PARTITION BY j.chrom, j.name, j.gstart, j.gend, j.position ORDER BY t.ord) = 1""",
    "spanned": """
        SELECT *, gstart + 5 AS s_low, gend - 5 AS s_high FROM genome_aln WHERE regexp_matches(cigar, '^[0-9]+M$') AND nm = 0""",
    "trimmed": """
        SELECT * FROM (SELECT *, CASE WHEN five OR three THEN CASE WHEN length(flank) >= 10 THEN concat(read_name, CASE WHEN five = (strand = '+') THEN ':end:' ELSE ':start:' END, CASE WHEN five THEN '5' ELSE '3' END) END
                   WHEN middle THEN concat(read_name, ':middle') END AS name,
                   CASE WHEN five OR three THEN flank ELSE seq END AS out_seq, CASE WHEN five THEN '5' WHEN three THEN '3' ELSE 'middle' END AS junction_type,
                   CASE WHEN five OR three THEN CASE WHEN strand = '+' THEN piece ELSE reverse(translate(piece, 'ACGTNacgtn', 'TGCANtgcan')) END END AS te_portion
            FROM (SELECT *, CASE WHEN five = (strand = '+') THEN substring(seq, 1, qstart) ELSE substring(seq, qend + 2) END AS flank FROM
              (SELECT *, tstart <= 2 AND sound AS five, tend >= te_len - 3 AND sound AS three, qstart <= 2 AND qend >= qlen - 4 AS middle, substring(seq, qstart + 1, qend - qstart + 1) AS piece FROM
                (SELECT *, (qstart <= 2 OR qend >= qlen - 3) AND match + mismatch >= 10 AND mismatch <= 1 AS sound FROM te_aln)))) WHERE name IS NOT NULL""",
    "matched_mates": r"""
        SELECT DISTINCT regexp_extract(n, '^(.*)/([12])$', 1) AS base, regexp_extract(n, '^(.*)/([12])$', 2) AS mate FROM (SELECT regexp_replace(name, '(:(start|end):[53]$)|(:middle$)', '') AS n FROM repeat_rows) WHERE regexp_matches(n, '/[12]$')""",
}

CALL = 'chrom, cluster_id, start, "end", te_name, strand, tsd, left_junction, right_junction'
COUNTED = CALL + ", left_support, right_support, note"
SCORE = "(CASE WHEN qstart <= 2 THEN 1 ELSE 0 END + CASE WHEN qend >= qlen - 3 THEN 1 ELSE 0 END + CASE WHEN tstart <= 2 THEN 1 ELSE 0 END + CASE WHEN tend >= te_len - 3 THEN 1 ELSE 0 END)"
LADDER = """CASE WHEN s = 0 THEN 'homozygous' WHEN f >= 5 AND s < 5 THEN 'homozygous/excision_no_footprint' WHEN s < f * 0.2::DOUBLE AND s <= 10 THEN 'homozygous/excision_no_footprint'
  WHEN f <= 2 AND s > 10 THEN 'somatic_insertion' WHEN abs(f - s) <= 5 THEN 'heterozygous' WHEN abs(f - s) - (f + s) / 2 <= 10 THEN 'heterozygous' WHEN f > 10 AND s > 10 THEN 'heterozygous'
  WHEN s - f > (s + f) / 2 AND f <= 10 THEN 'somatic_insertion' ELSE 'other' END"""


def _sum(op: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+){op}', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT)"


SELECTS = {
    "scan_alignments": """SELECT chrom, name, strand, gstart, gstart + CAST(regexp_extract(cigar, '([0-9]+)M', 1) AS BIGINT) - 1 AS gend, CAST(nm AS BIGINT) AS nm, cigar FROM genome_aln WHERE NOT (nm = 1 AND cigar LIKE '%S')""",
    "reverse_complement": "SELECT read_name, ord, reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan')) AS revcomp FROM te_aln",
    "boundary_score": f"SELECT read_name, ord, CAST({SCORE} AS BIGINT) AS score FROM te_aln",
    "cigar_sums": f"""SELECT name, chrom, gstart, n_m, n_i, n_d, n_m - (nm - n_i - n_d) AS match, nm - n_i - n_d AS mismatch FROM
        (SELECT name, chrom, gstart, nm, {_sum('M')} AS n_m, {_sum('I')} AS n_i, {_sum('D')} AS n_d FROM (SELECT name, chrom, gstart, CAST(nm + 5 AS BIGINT) AS nm, concat('4M2I', CAST(nm + 1 AS VARCHAR), 'D', cigar) AS cigar FROM genome_aln))""",
    "strip_tag": """SELECT name, gstart, regexp_replace(name, '(:(start|end):[53]$)|(:middle$)', '') AS stripped, regexp_replace(name, ':(start|end):[53]$', '') AS without_junction
        FROM (SELECT name, gstart FROM genome_aln UNION ALL SELECT name, CAST(0 AS BIGINT) FROM repeat_rows)""",
    "split_mate": """SELECT name, gstart, CASE WHEN regexp_extract(name, '^(.*)/([12])$', 2) = '' THEN name ELSE regexp_extract(name, '^(.*)/([12])$', 1) END AS base, regexp_extract(name, '^(.*)/([12])$', 2) AS mate FROM genome_aln""",
    "junction_info": """SELECT name, strand, gstart, CASE WHEN kind <> '' THEN CASE WHEN (strand = '+') = (kind = 'start') THEN 'right' ELSE 'left' END END AS side,
        CASE WHEN kind <> '' THEN CASE WHEN (strand = '+') = (kind = 'start') THEN gstart ELSE gend END END AS position, nullif(te_end, '') AS te_end FROM tagged""",
    "te_orientation": "SELECT name, gstart, side, te_end, orientation FROM orient",
    "tsd_rule": 'SELECT chrom, cluster_id, left_pos, right_pos, start, "end", known FROM ruled',
    "fetch_tsd": """SELECT concat('c', CAST(doc_id AS VARCHAR)) AS chrom, s AS start, e AS "end", CASE WHEN s < 1 OR coalesce(substring(seq, s, e - s + 1), '') = '' THEN repeat('.', CAST(e - s + 1 AS BIGINT)) ELSE upper(substring(seq, s, e - s + 1)) END AS tsd
        FROM (SELECT *, doc_id % 60 AS s, doc_id % 60 + doc_id % 20 AS e FROM genome)""",
    "classify_status": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, f AS flankers, s AS spanners, {LADDER} AS status FROM
        (SELECT *, (CAST(l_linenumber AS BIGINT) * 3 + CAST(l_quantity AS BIGINT)) / 2 AS f, l_suppkey % 60 AS s FROM lineitem)""",
    "best_te_alignment": f"""SELECT read_name, ord, CAST({SCORE} AS BIGINT) AS boundary, CAST(match AS BIGINT) AS match, te_name FROM te_aln QUALIFY row_number() OVER (PARTITION BY read_name ORDER BY {SCORE} DESC, match DESC, ord) = 1""",
    "qlen_carry": """SELECT te_name, ord, read_name, CAST(coalesce(last_value(CASE WHEN mismatch = 1 THEN NULL ELSE nullif(te_len + tstart, 0) END IGNORE NULLS) OVER (PARTITION BY te_name ORDER BY ord, read_name ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS carried FROM te_aln""",
    "trim_classify": "SELECT name, ord, out_seq AS seq, te_name, strand, junction_type, te_portion FROM trimmed",
    "flank_counts": "SELECT te_name, junction_type, strand, count(*) AS n_reads FROM trimmed GROUP BY te_name, junction_type, strand",
    "read_repeat_dedup": "SELECT name, te_name, strand FROM repeat_rows QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord DESC, te_name DESC, strand DESC) = 1",
    "te_family_lookup": "SELECT name, gstart, te_name FROM junc",
    "recover_support_mates": """SELECT name, seq FROM reads WHERE name IN (SELECT concat(base, '/', CASE WHEN mate = '1' THEN '2' ELSE '1' END) FROM matched_mates m
        WHERE NOT EXISTS (SELECT 1 FROM matched_mates o WHERE o.base = m.base AND o.mate <> m.mate))""",
    "collect_fullreads": "SELECT name, seq FROM reads WHERE name IN (SELECT regexp_replace(name, ':(start|end):[53]$', '') FROM repeat_rows WHERE regexp_matches(name, ':(start|end):[53]$'))",
    "cluster_reads": "SELECT chrom, name, gstart, gend, cluster_id FROM clustered",
    "session_clusters": "SELECT chrom, min(gstart) AS first, max(gend) AS last, count(*) AS n_reads, count(*) FILTER (strand = '+') AS n_forward FROM clustered GROUP BY chrom, cluster_id",
    "breakpoint_counts": "SELECT chrom, cluster_id, side, position, count(*) AS n_reads FROM junc GROUP BY ALL",
    "pair_breakpoints": "SELECT chrom, cluster_id, left_pos, right_pos FROM pairs",
    "te_family_mode": """SELECT c.chrom, c.cluster_id, coalesce(f.te_name, 'NA') AS te_name FROM (SELECT DISTINCT chrom, cluster_id FROM junc) c LEFT JOIN
        (SELECT chrom, cluster_id, te_name FROM junc WHERE te_name <> 'NA' GROUP BY chrom, cluster_id, te_name QUALIFY row_number() OVER (PARTITION BY chrom, cluster_id ORDER BY count(*) DESC, te_name) = 1) f USING (chrom, cluster_id)""",
    "strand_vote": "SELECT chrom, cluster_id, position, CASE WHEN count(*) FILTER (orientation = '+') >= count(*) FILTER (orientation = '-') THEN '+' ELSE '-' END AS strand FROM orient GROUP BY chrom, cluster_id, position",
    "call_insertions": f"SELECT {CALL} FROM called",
    "count_support": 'SELECT chrom, cluster_id, start, "end", left_junction, right_junction, left_support, right_support FROM supported',
    "support_only_calls": """SELECT chrom, cluster_id, start, "end", 'NA' AS te_name, '+' AS strand, 'supporting_reads' AS tsd, left_support, right_support FROM lone""",
    "required_junction_filter": f"SELECT {CALL} FROM called WHERE left_junction >= 4 OR right_junction >= 4",
    "false_junction": 'SELECT chrom, cluster_id, start, "end", te_name, strand FROM called WHERE pid IN (SELECT pid FROM false_pid)',
    "find_insertions": f"SELECT {COUNTED} FROM found",
    "parse_repeatmasker": """SELECT chrom, te_start, te_end, te_name, 'DNA/x' AS family, strand, intact AND te_end % 3 <> 0 AS intact, ord FROM ref_te""",
    "reference_match": "SELECT chrom, cluster_id, name, gstart, position, ref_te_name, ref_te_start, ref_te_end, ref_ord FROM matched",
    "shared_insertions": """SELECT chrom, cluster_id, ref_te_start AS start, ref_te_end AS "end", arg_min(ref_te_name, ref_ord) AS te_name, arg_min(ref_strand, ref_ord) AS strand, 'shared' AS tsd,
        count(*) FILTER (side = 'left') AS left_junction, count(*) FILTER (side = 'right') AS right_junction, 'Shared, found in reference' AS note FROM matched GROUP BY chrom, cluster_id, ref_te_start, ref_te_end""",
    "filter_reference_overlaps": f"""SELECT {COUNTED} FROM found f WHERE NOT EXISTS (SELECT 1 FROM ref_te t WHERE t.chrom = f.chrom AND t.te_name = f.te_name AND f.start - 5 <= t.te_end AND f."end" + 5 >= t.te_start)""",
    "window_overlap": """SELECT chrom, name, gstart AS start, gend AS "end" FROM genome_aln a WHERE EXISTS (SELECT 1 FROM ref_te t WHERE t.chrom = a.chrom AND a.gstart - 10 <= t.te_end AND a.gend + 10 >= t.te_start)""",
    "count_spanners": """SELECT p.chrom, p.pos, count(s.s_low) AS spanners FROM (SELECT DISTINCT chrom, te_start AS pos FROM ref_te) p LEFT JOIN spanned s ON s.chrom = p.chrom AND s.s_low <= p.pos AND s.s_high >= p.pos GROUP BY p.chrom, p.pos""",
    "genotype": f"""SELECT {CALL}, f AS avg_flankers, s AS spanners, {LADDER} AS status FROM (SELECT *, (left_junction + right_junction) / 2 AS f,
        (SELECT count(*) FROM spanned s WHERE s.chrom = v.chrom AND s.s_low <= v."end" AND s.s_high >= v."end") AS s FROM found v WHERE left_junction >= 1 AND right_junction >= 1)""",
    "gff_roundtrip": 'SELECT chrom, start, "end", te_name, strand, tsd, left_junction, right_junction, left_support, right_support, note FROM found',
    "evaluate_calls": """SELECT (SELECT count(*) FROM ref_te) AS n_truth, (SELECT count(*) FROM found) AS n_calls,
        (SELECT count(*) FROM ref_te t WHERE EXISTS (SELECT 1 FROM found f WHERE f.chrom = t.chrom AND t.te_start - 10 <= f."end" AND t.te_start + 1 + 10 >= f.start)) AS recovered,
        (SELECT count(*) FROM found f WHERE EXISTS (SELECT 1 FROM ref_te t WHERE f.chrom = t.chrom AND f.start - 10 <= t.te_start + 1 AND f."end" + 10 >= t.te_start)) AS true_calls""",
    "seed_join": "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> ''",
    "minimizers": "SELECT doc_id, place, seed, reverse FROM chosen_kmers",
    "seed_candidates": """SELECT id, strand, ref_name, CAST(diagonal AS BIGINT) AS diagonal, CAST(seeds AS BIGINT) AS seeds FROM all_votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY seeds DESC, ref_name, diagonal, strand) = 1""",
}


def _with(select: str) -> str:
    """The steps that ``select`` needs, each after those it needs itself."""
    texts = {n: sql(n, "duckdb") for n in DERIVED} | {n.split("(")[0]: t for n, t in STEPS.items()}
    heads = {n.split("(")[0]: n for n in STEPS}
    order: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for word in re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", text):
            if word in texts and word != own and word not in order:
                visit(texts[word], word)
                order.append(word)

    visit(select)
    if not order:
        return select
    made = lambda n: f"{heads.get(n, n)} AS {'' if n == 'fold' else 'MATERIALIZED '}({texts[n].strip()})"
    return f"WITH {'RECURSIVE ' if 'fold' in order else ''}{', '.join(map(made, order))} {select}"


ORACLE = {name: _with(select) for name, select in SELECTS.items()}
