"""The registered queries of the corpus operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm import conversations, exact, html, licenses, linedup, lm, mixing, neardup, packing, quality, shards, simhash, tries
from pulseloom.llm.common import documents
from pulseloom.llm.packing import tokenizer_path

OP8 = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to their sources' targets, in whole passes."""
    return mixing.mix(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens of byte_bpe_50k.json."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and recurrent network's score of every whole document."""
    return lm.scores(documents(spark, sf_dir))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(documents(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line with a word of every document, whether it stays and which line stands for it."""
    return linedup.lines(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and host-level verdict of every document."""
    return quality.score(documents(spark, sf_dir)).select(*OP8)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: weighted Jaccard similarity of five-word shingles of 0.8 or more."""
    return neardup.classes(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts: half of the documents are the snapshot, the others come in as a batch."""
    return exact.dedup(documents(spark, sf_dir))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of all documents that state a licence, with its family."""
    return licenses.scan(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; equal texts share one."""
    return shards.assign(documents(spark, sf_dir), shards=40)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults, the cost, the audit and the repaired text of every damaged conversation."""
    broken = conversations.damaged(documents(spark, sf_dir, "conversations"))
    return conversations.report(broken, F.col("present"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: links of at most three differing bits."""
    return simhash.classes(documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source of a language its divergence from the others and its foremost terms."""
    return tries.audit(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_exact_dedup, op3_mix_sources, op4_best_fit_packing, op5_lm_scoring, op6_html_extraction, op7_line_dedup, op8_quality_rules, op9_license_scans, op10_sharding, op11_conversation_repair, op12_simhash_near_dedup, op13_source_divergence)}


_OP2 = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

_OP8 = r"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
 words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
 windows AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS key FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM words)),
 starts AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM windows) WHERE n > 1),
 repeats AS (SELECT doc_id, CAST(sum(least(8, coalesce(after - i, 8))) AS BIGINT) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM starts) GROUP BY doc_id),
 f AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
 coalesce(n, 0) AS n_repeat_words FROM words LEFT JOIN repeats USING (doc_id)),
 b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
 a AS (SELECT *, base_failed OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.3 * n_lines OR word_chars < 2.0 * n_words OR word_chars > 15.0 * n_words AS any_failed FROM b),
 hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE any_failed) AS k FROM a GROUP BY source),
 total AS (SELECT sum(k)::DOUBLE / sum(n) AS m, sum(n)::DOUBLE AS n, count(*) AS h FROM hosts),
 scatter AS (SELECT any_value(total.m) AS m, any_value(total.h) AS h, sum(hosts.n * power(k::DOUBLE / hosts.n - total.m, 2)) / any_value(total.n) - any_value(total.m * (1 - total.m) * total.h / total.n) AS v FROM hosts, total),
 prior AS (SELECT m, CASE WHEN h > 1 AND m > 0 AND m < 1 AND v > 0 THEN least(10000, greatest(1, m * (1 - m) / v - 1)) ELSE 10000 END AS w FROM scatter),
 verdicts AS (SELECT source, (k + m * w) / (n + w) > 0.5 AS rejected FROM hosts, prior)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM a JOIN verdicts v ON a.source IS NOT DISTINCT FROM v.source"""


def _edited(s: str, cost: str, letter: str, line: str = "''") -> str:
    """A way to a grammar state (six digits of cost, audit, chr(1), lines) after one more edit."""
    return f"(lpad(CAST(CAST(left({s}, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({s}, 7, instr({s}, chr(1)) - 7) || '{letter}' || substr({s}, instr({s}, chr(1))) || {line})"


def _op11() -> str:
    """The least way to each grammar state after each turn, by recursion over the turns."""
    user, assistant = "('user:' || chr(10))", "('assistant:' || chr(10))"
    i2 = f"least(s2, {', '.join(_edited(s, '3', 'I', user) for s in ('s0', 's1', 's3'))})"
    drop = lambda s: _edited(s, "4", "D")  # noqa: E731
    keep = lambda s: _edited(s, "cut", "K", "(role || ':' || text || chr(10))")  # noqa: E731
    name = lambda s, role: _edited(s, "cut + 3", "R", f"('{role}:' || text || chr(10))")  # noqa: E731
    given = lambda s, role: f"CASE WHEN NOT gone THEN {name(s, role)} END"  # noqa: E731
    own = lambda s, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {keep(s)} END"  # noqa: E731
    to2 = ", ".join([drop("i2"), *(own(s, "u") for s in ("s0", "s1", "i3")), *(given(s, "user") for s in ("s0", "s1", "i3"))])
    return rf"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
 k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
 f AS (SELECT k.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS fault FROM k, crc),
 d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
 unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
 n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last FROM d),
 r AS (SELECT *, left(role, 1) AS initial, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM n),
 t AS (SELECT conv_id, pos, turn, role, text, initial, before, blank, duplicate, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND last NOT IN ('.', '!', '?') AS truncated,
 CASE WHEN last IN ('.', '!', '?') THEN 0 ELSE 3 END AS cut FROM r),
 w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, '000000' || chr(1) AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM conversations
 UNION ALL SELECT conv_id, pos, {drop('s0')}, least({drop('s1')}, {own('s0', 's')}), least({to2}), least({drop('i3')}, {own('i2', 'a')}, {given('i2', 'assistant')}) FROM (
 SELECT *, least(s3, {_edited('i2', '3', 'I', assistant)}) AS i3 FROM (SELECT w.s0, w.s1, w.s3, {i2.replace('s0', 'w.s0').replace('s1', 'w.s1').replace('s2', 'w.s2').replace('s3', 'w.s3')} AS i2,
 t.conv_id, t.pos, t.role, t.text, t.initial, t.gone, t.cut FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1))),
 last AS (SELECT conv_id, max_by(struct_pack(s0, s1, s2, s3), pos) AS s FROM w GROUP BY conv_id),
 done AS (SELECT conv_id, least(s0, s3, {_edited('i2', '3', 'I', assistant)}) AS best FROM (SELECT conv_id, s0, s3, {i2} AS i2 FROM (SELECT conv_id, s.s0, s.s1, s.s2, s.s3 FROM last))),
 sums AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
 count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id)
 SELECT done.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(left(best, 6) AS BIGINT) AS cost, substr(best, 7, instr(best, chr(1)) - 7) AS audit, sha256(regexp_replace(substr(best, instr(best, chr(1)) + 1), '
$', '')) AS repaired_sha256
 FROM done LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM done.conv_id"""


_OP13 = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 t AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 30),
 c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
 g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
 sums AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) + 5 * any_value(v) AS d FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
 p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 5) // s.d AS BIGINT) AS p FROM sums s JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
 whole AS (SELECT lang, sum(n) + 5 * any_value(v) AS d FROM c JOIN v USING (lang) GROUP BY lang),
 q AS (SELECT lang, term, CAST(1 + 1000000000 * (sum(n) + 5) // any_value(whole.d) AS BIGINT) AS q FROM c JOIN whole USING (lang) GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 everything AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source UNION ALL SELECT lang, source, 'term', item, value FROM terms)
 SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM everything QUALIFY part = 'pair' OR rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are held against brute force in the tests."""
    return {"op2_exact_dedup": _OP2, "op8_quality_rules": _OP8, "op11_conversation_repair": _op11(), "op13_source_divergence": _OP13}
