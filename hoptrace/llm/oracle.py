"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from .mixing import BUCKETS, SEED, SHARE
from .quality_rules import EXTREME, GRID_BITS, MEASURES, MILD, PRIOR
from .secret_scan import ACCESS, ASSIGN, CANDIDATE, COPIED_OWNERS, COPIED_REPOSITORIES, HEX, LEAST_VALUE, LIVE_CHARACTERS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# --- op1 --------------------------------------------------------------------------------------------------------------
def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    p = _quoted(pattern)
    return f"""
    SELECT doc_id, owner, repository, {kind} AS kind, upto - len(w) AS start, upto AS "end", v FROM (
      SELECT *, sum(len(g) + len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
        SELECT doc_id, owner, repository, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(vs) AS v, unnest(gs[1:len(ws)]) AS g FROM (
          SELECT doc_id, owner, repository, regexp_extract_all(t, {p}, 0) AS ws, regexp_extract_all(t, {p}, {group}) AS vs, string_split_regex(t, {p}) AS gs FROM docs WHERE regexp_matches(t, {p}))))
    WHERE len(v) >= {least}"""


_LISTED = """string_agg(concat(['assign', 'access', 'hex', 'owned'][kind + 1], ':', CAST(start AS BIGINT), ':', CAST("end" AS BIGINT)), ',' ORDER BY start, kind)"""

OP1 = f"""
WITH docs AS (SELECT doc_id, source AS owner, lang AS repository, coalesce(text, '') AS t FROM documents),
base AS ({_spans(0, ASSIGN, 2, LEAST_VALUE)} UNION ALL {_spans(1, ACCESS, 0, 18)} UNION ALL {_spans(2, HEX, 0, 16)}),
live AS (SELECT * FROM ({_spans(3, CANDIDATE, 0, 20)}) WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {LIVE_CHARACTERS}),
cand AS (SELECT * FROM live c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start < c."end" AND c.start < b."end")),
both_ AS (SELECT * FROM base UNION ALL SELECT * FROM cand),
verdicts AS (SELECT v, CASE WHEN owners >= {COPIED_OWNERS} OR repositories >= {COPIED_REPOSITORIES} THEN 'copied' WHEN owners = 1 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {LIVE_CHARACTERS} THEN 'owned' END AS verdict
  FROM (SELECT v, count(DISTINCT coalesce(owner, '\0null')) AS owners, count(DISTINCT (coalesce(owner, '\0null'), coalesce(repository, '\0null'))) AS repositories FROM both_ GROUP BY v)),
all_ AS (SELECT b.*, verdict FROM both_ b JOIN verdicts USING (v) WHERE kind < 3 OR verdict = 'owned'),
counted AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  {_LISTED} FILTER (kind < 3) AS base, {_LISTED} AS spans, count(*) FILTER (verdict = 'owned') AS n_owned, count(*) FILTER (verdict = 'copied') AS n_copied FROM all_ GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied FROM docs d LEFT JOIN counted c ON d.doc_id = c.doc_id
"""

# --- op7 --------------------------------------------------------------------------------------------------------------
OP7 = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST(concat('0x', substr(md5(concat_ws(':', '{SEED}', CAST(doc_id AS VARCHAR))), 1, 15)) AS BIGINT) AS h FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM sums),
filled AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
aimed AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(level, cap / weight) FROM filled WHERE cap > weight * level), cap)) AS target FROM filled),
rests AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) - CAST(floor(round(target) / source_size) AS BIGINT) * source_size ELSE 0 END AS rest FROM aimed),
placed AS (SELECT s.doc_id, s.size, r.source_size, r.target, r.whole, r.rest, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY (s.h >> 20) % {BUCKETS}, s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM placed
"""


# --- op8 --------------------------------------------------------------------------------------------------------------
def _step(measure: str) -> str:
    top, factor, below, _ = MEASURES[measure]
    value = f"(({top} * {factor}) // {below})"
    cut = f"greatest(length(bin({value})) - {GRID_BITS}, 0)"
    return f"CASE WHEN {below} > 0 THEN (({value} >> {cut}) << {cut}) END"


def _steps() -> str:
    return " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {_step(m)} AS step FROM judged WHERE NOT base_failed AND {below} > 0" for m, (_, _, below, _) in MEASURES.items())


def _drawn(keys: list[str], wider: str, of: list[str]) -> str:
    own, on = ", ".join(keys), " AND ".join(f"o.{k} IS NOT DISTINCT FROM w.{k}" for k in [*of, "measure"])
    names, same = ", ".join(f"g.{k}" for k in keys), " AND ".join(f"g.{k} IS NOT DISTINCT FROM c.{k}" for k in [*keys, "measure", "step"])
    return f"""SELECT {own}, measure, step, (CAST(sum(n) OVER (PARTITION BY {own}, measure ORDER BY step) AS DOUBLE) + {PRIOR}::DOUBLE * wide) / (CAST(sum(n) OVER (PARTITION BY {own}, measure) AS DOUBLE) + {PRIOR}::DOUBLE) AS f FROM (
      SELECT {names}, g.measure, g.step, g.wide, coalesce(c.n, 0) AS n FROM (SELECT {", ".join("o." + k for k in keys)}, o.measure, w.step, w.f AS wide FROM (SELECT DISTINCT {own}, measure FROM steps) o JOIN {wider} w ON {on}) g
      LEFT JOIN (SELECT {own}, measure, step, count(*) AS n FROM steps GROUP BY {own}, measure, step) c ON {same})"""


def _verdict() -> str:
    one, two = [], []
    for m, (_, _, _, both) in MEASURES.items():
        step = _step(m)
        high = f"{step} > extreme_{m}" + (f" OR {step} < low_extreme_{m}" if both else "")
        more = f"({step} > mild_{m} AND mild_{m} > median_{m})" + (f" OR ({step} < low_mild_{m} AND low_mild_{m} < median_{m})" if both else "")
        one.append(f"coalesce({high}, false)")
        two.append(f"CAST(coalesce({more}, false) AS INT)")
    return f"({' OR '.join(one)}) OR ({' + '.join(two)}) >= 2"


_LEVELS = {"median": "0.5", "extreme": f"{EXTREME!r}", "mild": f"{MILD!r}", "low_extreme": f"{1 - EXTREME!r}", "low_mild": f"{1 - MILD!r}"}
_PIVOT = ", ".join(f"min(step) FILTER (measure = '{m}' AND f >= CAST('{q}' AS DOUBLE)) AS {name}_{m}" for m in MEASURES for name, q in _LEVELS.items())

OP8 = f"""
WITH split AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1) CROSS JOIN (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
measured AS (SELECT s.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM split s LEFT JOIN repeated r USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
steps AS ({_steps()}),
overall AS (SELECT measure, step, CAST(sum(n) OVER (PARTITION BY measure ORDER BY step) AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY measure) AS DOUBLE) AS f FROM (SELECT measure, step, count(*) AS n FROM steps GROUP BY measure, step)),
languages AS ({_drawn(["lang"], "overall", [])}),
found AS ({_drawn(["lang", "source"], "languages", ["lang"])}),
thresholds AS (SELECT lang, source, {_PIVOT} FROM found GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_verdict()}) AS kept
FROM judged j LEFT JOIN thresholds f ON j.lang IS NOT DISTINCT FROM f.lang AND j.source IS NOT DISTINCT FROM f.source
"""

# --- op9 --------------------------------------------------------------------------------------------------------------
_DIGIT = "(strpos('0123456789abcdef', substr(h, {k}, 1)) - 1)"


def _base32() -> str:
    parts = []
    for g in range(8):
        value = "0"
        for i in range(5):
            value = f"({value}) * 16 + {_DIGIT.format(k=5 * g + i + 1)}"
        parts += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({value}) >> {15 - 5 * j}) & 31 AS BIGINT) + 1, 1)" for j in range(4)]
    return f"concat({', '.join(parts)})"


OP9 = f"""
SELECT page_id, payload_bytes, {_base32()} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_page THEN first_page END AS refers_to, true AS verified
FROM (SELECT page_id, CAST(octet_length(encode(p)) AS BIGINT) AS payload_bytes, sha1(p) AS h, min(page_id) OVER (PARTITION BY p) AS first_page FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))
"""

# --- op12 -------------------------------------------------------------------------------------------------------------
#: Levels that the SQL folds: sources of up to 16 ** 5 documents, up to 16 ** 3 sources.
SOURCE_LEVELS, ROOT_LEVELS = 5, 3
#: The polynomial of CRC-32, reversed. A fixed value.
CRC_POLYNOMIAL = 0xEDB88320


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters: one step a bit, each byte added at its first."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = f"xor(xor(c, b) >> 1, (xor(c, b) & 1) * {CRC_POLYNOMIAL})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: {step}), 4294967295::BIGINT)"


def _levels(name: str, first: str, n: int) -> str:
    """Tables {name}_r0.. (nodes with the texts left and right of them in their run) and {name}_n0.. above ``first`` (key, pos, node)."""
    out, run = [f"{name}_n0 AS (SELECT key, pos, node FROM {first})"], "PARTITION BY key, pos // 16 ORDER BY pos ROWS BETWEEN"
    for i in range(n):
        out.append(f"""{name}_r{i} AS (SELECT key, pos, node, count(*) OVER (PARTITION BY key) AS total,
  coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS ahead, coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind FROM {name}_n{i})""")
        out.append(f"{name}_n{i + 1} AS (SELECT key, pos // 16 AS pos, CASE WHEN max(total) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE max(node) END AS node FROM {name}_r{i} GROUP BY key, pos // 16)")
    return ",\n".join(out)


def _paths(name: str, first: str, key: str, at: str, n: int, out: str) -> str:
    """Each row of ``first`` with its proof and its hand carried up ``n`` levels."""
    parts, before = [], first
    for i in range(n):
        parts.append(f"""{out}{i} AS (SELECT p.* REPLACE (proof || r.ahead || r.behind AS proof, CASE WHEN r.total > 1 THEN sha256(r.ahead || hand || r.behind) ELSE hand END AS hand)
  FROM {before} p JOIN {name}_r{i} r ON r.key = p.{key} AND r.pos = p.{at} // {16**i})""")
        before = f"{out}{i}"
    return ",\n".join(parts)


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({value} AS VARCHAR))), ':', {value}) END"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + "))"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = f"""
WITH hashed AS (SELECT doc_id, coalesce('1' || source, '0') AS key, {_leaf("text")} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(_LOWER)} END AS other FROM documents),
leaves AS (SELECT doc_id, key, leaf AS node, coalesce(other, leaf) AS hand, '' AS proof, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS LAST, leaf, coalesce(other, leaf)) - 1 AS pos FROM hashed),
{_levels("own", "leaves", SOURCE_LEVELS)},
subroots AS (SELECT '' AS key, key AS source, node, row_number() OVER (ORDER BY key) - 1 AS pos FROM own_n{SOURCE_LEVELS}),
{_levels("all", "subroots", ROOT_LEVELS)},
{_paths("own", "leaves", "key", "pos", SOURCE_LEVELS, "up")},
placed AS (SELECT u.*, s.pos AS place, '' AS none, s.node AS subroot FROM up{SOURCE_LEVELS - 1} u JOIN subroots s ON s.source = u.key),
{_paths("all", "placed", "none", "place", ROOT_LEVELS, "top")}
SELECT doc_id, t.node AS leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, hand AS folded_root, hand = r.node AS verified FROM top{ROOT_LEVELS - 1} t CROSS JOIN all_n{ROOT_LEVELS} r
"""

# --- op13 -------------------------------------------------------------------------------------------------------------
_BEFORE = " + ".join(f"CASE WHEN strpos(filter_order, '{f}') < step THEN {1 << i} ELSE 0 END" for i, f in enumerate("ABCDE"))

OP13 = f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
masks AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM docs),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
weights AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT *, 1 << CAST(ascii(letter) - 65 AS INT) AS bit, {_BEFORE} AS earlier FROM (SELECT filter_order, CAST(s AS INT) AS step, substr(filter_order, CAST(s AS INT), 1) AS letter FROM orders, range(1, 6) r(s))),
counted AS (SELECT part, filter_order, step, letter, sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM weights, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted
"""

ORACLE = {"op1_secret_ownership": OP1, "op7_water_filling": OP7, "op8_adaptive_rules": OP8, "op9_warc_archive": OP9, "op12_merkle_manifest": OP12, "op13_filter_audit": OP13}
