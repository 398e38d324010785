"""Queries that clean and mix: mixing, quality rules, line dedup and URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table
from .line_dedup import MIN_CHARS, MIN_DOCS, dedup_lines
from .mixing import BLOCK_WORDS, BUCKET_DIGITS, PRIME, REPEATS, SHARD_SLOTS, WEIGHTS, round_constants, taken_words
from .quality import BOILERPLATE, BOILERPLATE_WORDS, LOST_SHARE, MENU_SHARE, NOISE_SHARE, SHOUT_SHARE, judge_lines
from .queries import query
from .url_filter import RULES, judge_urls, rule_table

WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
BLANKS_SQL = "(chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

LINE_DEDUP_SQL = f"""
    WITH ls AS (
        SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
    ), keyed AS (
        SELECT *, translate(trim(line, {BLANKS_SQL}), '{UPPER}', '{LOWER}') AS key FROM ls
    ), repeated AS (
        SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= {MIN_CHARS}
        GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keep <> doc_id) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep IS NULL OR keep = doc_id), '')) AS kept_sha256
    FROM keyed LEFT JOIN repeated USING (key) GROUP BY doc_id
"""

_phrases = " OR ".join("contains(lower(line), '{}')".format(p.replace("'", "''")) for p in BOILERPLATE)
QUALITY_SQL = f"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL.format("coalesce(text, '')")} AS ws,
            string_split(coalesce(text, ''), chr(10)) AS ls
        FROM documents
    ), starts AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times
        FROM (SELECT doc_id, i, ws[i:i + 4] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d))
    ), spans AS (
        SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS span FROM starts WHERE times > 1
    ), covered AS (SELECT doc_id, sum(span)::BIGINT AS n_repeat_words FROM spans GROUP BY doc_id
    ), each AS (
        SELECT doc_id, line, len({WORDS_SQL.format("line")}) AS n, {WORDS_SQL.format("line")} AS ws,
            length(line) - length(regexp_replace(line, '[#*$%&|<>{{}}\\[\\]=~^_\\\\]|[!?]{{2,}}', '', 'g')) AS noise,
            length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
            len(regexp_extract_all(line, '[!?]{{2,}}')) AS shouted
        FROM (SELECT doc_id, unnest(ls) AS line FROM d)
    ), lost AS (
        SELECT doc_id, sum(n) FILTER (WHERE n > 0 AND (
            len(list_filter(ws, lambda w: w IN ('|', '»', '«', '›', '•', '·', '>', '<', '/', '::', '-', '–'))) >= n * {MENU_SHARE}
            OR noise >= chars * {NOISE_SHARE} OR shouted >= n * {SHOUT_SHARE} OR (({_phrases}) AND n <= {BOILERPLATE_WORDS}))) AS lost
        FROM each GROUP BY doc_id
    ), counted AS (
        SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
            len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            (len(list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
                - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= n_words * {LOST_SHARE} AS kept
    FROM counted
"""




def _rounds_sql(label: str) -> str:
    return ", ".join(f"({r}, {k}::BIGINT, {a}::BIGINT, {b}::BIGINT)" for r, (k, a, b) in enumerate(round_constants(label)))


def _mod(a: str, n: str) -> str:
    return f"((({a}) % ({n}) + ({n})) % ({n}))"


def _walk_sql(name: str, start: str, n: str, label: str) -> str:
    """Swap-or-not rounds as a recursion over the rounds."""
    partner = _mod("k - x", n)
    bit = f"((greatest(x, {partner}) % {PRIME}) * a + b) % {PRIME} * 2 > {PRIME}"
    return f"""
    {name} AS (
        SELECT s, j, {n} AS {n}, 0 AS r, {start} AS x FROM slots
        UNION ALL
        SELECT s, j, {n}, {name}.r + 1, CASE WHEN {bit} THEN {partner} ELSE x END
        FROM {name} JOIN (VALUES {_rounds_sql(label)}) AS c(r, k, a, b) ON c.r = {name}.r
    )"""


def mixing_sql(documents: str = "documents") -> str:
    weight = f"list_extract({list(WEIGHTS)}, ((row_number() OVER (ORDER BY s) - 1) % {len(WEIGHTS) } + 1)::INTEGER)"
    return f"""
    WITH RECURSIVE sized AS (
        SELECT doc_id AS d, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
            len({WORDS_SQL.format("coalesce(text, '')")})::BIGINT AS size
        FROM {documents}
    ), sources AS (
        SELECT s, source_size, {weight} AS w, {REPEATS} * source_size AS cap
        FROM (SELECT s, sum(size)::BIGINT AS source_size FROM sized GROUP BY s)
    ), levels AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lvl
        FROM sources WINDOW b AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), targets AS (
        SELECT s, source_size, least(cap::DOUBLE, max(lvl) OVER () * w) AS target, ceil(source_size / {BLOCK_WORDS}.0)::BIGINT AS blocks FROM levels
    ), granted AS (
        SELECT *, coalesce(sum(quota) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, (sum(quota) OVER ())::BIGINT AS slots
        FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target * blocks / source_size + 0.5)::BIGINT ELSE 0 END AS quota FROM targets)
    ), slots AS (
        SELECT s, unnest(range(quota)) AS j, start, slots, blocks FROM granted
    ), {_walk_sql("dealt", "start + j", "slots", "deal")}, {_walk_sql("walked", "j % blocks", "blocks", "blocks")},
    times AS (
        SELECT s, walked.x AS idx, count(*) AS times, min(dealt.x // {SHARD_SLOTS}) AS shard
        FROM dealt JOIN walked USING (s, j, r) WHERE r = {len(round_constants("deal"))} GROUP BY s, idx
    ), placed AS (
        SELECT *, coalesce(sum(size) OVER (PARTITION BY s ORDER BY md5(coalesce(d::VARCHAR, ''))[:{BUCKET_DIGITS}], d, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM sized
    ), pieces AS (
        SELECT *, unnest(range(off // {BLOCK_WORDS}, (off + size - 1) // {BLOCK_WORDS} + 1)) AS idx FROM placed WHERE size > 0
    ), counted AS (
        SELECT s, d, off, sum(coalesce(times, 0) * (least(off + size, (idx + 1) * {BLOCK_WORDS}) - greatest(off, idx * {BLOCK_WORDS})))::BIGINT AS taken, min(shard) AS first_shard
        FROM pieces LEFT JOIN times USING (s, idx) GROUP BY s, d, off
    )
    SELECT d AS doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_shard
    FROM placed JOIN targets USING (s) LEFT JOIN counted USING (s, d, off)
    """


_rest = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
URL_SQL = f"""
    WITH parts AS (
        SELECT page_id, translate(regexp_extract({_rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract({_rest}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages
    ), rules(said, rule_host, rule_path) AS (VALUES {", ".join(str(r) for r in RULES)}),
    best AS (
        SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(said, length(rule_host || rule_path)) AS said
        FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
    )
    SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts LEFT JOIN best USING (page_id)
"""


@query("op1_mix_sources", mixing_sql())
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("op5_url_filter", URL_SQL)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, RULES))


@query("op2_quality_rules", QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_line_dedup", LINE_DEDUP_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
