"""Registered queries of the subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moveproof.llm import (
    chat, decontaminate, divergence, hmm, jaccard, line_rules, negatives, packing, site_quality, substring,
    suffixes, toxicity, url_rules,
)
from moveproof.session import literal_rows, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


@query("op1_substring_dedup")
def op1(spark: SparkSession, root: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, root, "documents"))


# --- fixed values: the rules that the url query is asked with ---
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]

URL_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN judged USING (host, path)"""


@query("op2_url_filters", URL_SQL)
def op2(spark: SparkSession, root: str) -> DataFrame:
    rules = literal_rows(spark, "host string, path string, verdict string", URL_RULES)
    return url_rules.filter_urls(table(spark, root, "pages"), rules)


QUALITY_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, p, array_to_string(list_slice(w, p, p + 4), ' ') AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM docs WHERE len(w) >= 5)),
twice AS (SELECT r, p FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
repeated AS (
  SELECT r, sum(least(5, coalesce(n - p, 5))) AS n_repeat_words
  FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS n FROM twice) GROUP BY r),
raw_lines AS (SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
full_lines AS (
  SELECT r, doc_id, source, text, line, regexp_extract_all(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY r),
lines AS (SELECT r, doc_id, source, text, array_to_string(w, ' ') AS line, len(w) AS n FROM full_lines),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM docs GROUP BY source),
limits AS (
  SELECT l.source, l.line, arg_min(l.text, l.doc_id) AS first
  FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, l.line
  HAVING count(DISTINCT l.text) > 20 AND count(DISTINCT l.text) > least(0.01 * any_value(texts), 200)),
removed AS (
  SELECT r, sum(n) AS n_common_words FROM lines l JOIN limits m
    ON l.source IS NOT DISTINCT FROM m.source AND l.line = m.line
  WHERE l.text <> m.first GROUP BY r),
base AS (
  SELECT doc_id, len(w) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_common_words, 0)::BIGINT AS n_common_words
  FROM docs LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
  AND n_words - n_common_words >= 10 AND n_words - n_common_words >= 0.3 * n_words AS kept
FROM base"""


@query("op8_quality_rules", QUALITY_SQL)
def op8(spark: SparkSession, root: str) -> DataFrame:
    return line_rules.quality_rules(table(spark, root, "documents")).drop("key")


@query("op5_ngram_jaccard_join")
def op5(spark: SparkSession, root: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, root, "documents")).drop("key", "is_first")


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, root: str) -> DataFrame:
    return suffixes.dedup_bytes(table(spark, root, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file; the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_packing")
def op9(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"), tokenizer_path())


def remainder(by: int, name: str = "doc_id"):
    """crc32 of an id as text, modulo `by`: the fold of a document."""
    return F.crc32(F.col(name).cast("string")) % by


@query("op7_lm_scoring")
def op7(spark: SparkSession, root: str) -> DataFrame:
    return hmm.hmm_scores(table(spark, root, "documents"), remainder(5) == 1)


@query("op4_toxicity")
def op4(spark: SparkSession, root: str) -> DataFrame:
    docs, labels = table(spark, root, "documents"), table(spark, root, "labels")
    return toxicity.toxicity(docs, labels, remainder(3) == 1)


@query("op10_benchmark_decontamination")
def op10(spark: SparkSession, root: str) -> DataFrame:
    docs, benchmark = table(spark, root, "documents"), table(spark, root, "benchmark")
    return decontaminate.contaminated(docs, benchmark).drop("key")


@query("op3_quality_classifier")
def op3(spark: SparkSession, root: str) -> DataFrame:
    docs, labels = table(spark, root, "documents"), table(spark, root, "labels")
    return site_quality.classify(docs, labels, remainder(3) == 1)


NEGATIVES_SQL = r"""
WITH vectors AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings").withColumn("label", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0)


# --- fixed values: a conversation whose texts are control strings, added to the table ---
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\-{control[1:]}')"
    return out


CHAT_SQL = rf"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    ceil(strlen(coalesce(text, '')) / 4)::BIGINT + {chat.TURN_TOKENS} AS tokens,
    length({_escaped_sql("coalesce(role, '')")}) + length({_escaped_sql("coalesce(text, '')")})
      + {len(chat.START + chat.SEPARATOR + chat.END)} AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
    count(*) OVER (PARTITION BY conv_id) AS total
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL VALUES {', '.join(map(str, CONTROL_TURNS))})),
systems AS (SELECT conv_id, tokens, chars FROM turns WHERE n = 1 AND role = 'system' AND total > 1),
own AS (
  SELECT t.conv_id, t.chars, t.tokens, coalesce(s.tokens, 0) AS sys, coalesce(s.chars, 0) AS sys_chars,
    sum(t.tokens) OVER w AS upto, sum(t.tokens) OVER w - t.tokens AS start,
    row_number() OVER w AS n
  FROM turns t LEFT JOIN systems s USING (conv_id) WHERE s.conv_id IS NULL OR t.n > 1
  WINDOW w AS (PARTITION BY t.conv_id ORDER BY t.n)),
placed AS (
  SELECT *, start AS begin FROM own WHERE n = 1
  UNION ALL
  SELECT o.*, CASE WHEN o.start // {chat.CELL * chat.BUDGET} <> p.start // {chat.CELL * chat.BUDGET}
    OR o.upto - p.begin > {chat.BUDGET} - o.sys - CASE WHEN p.begin = 0 THEN 0 ELSE {chat.HISTORY} END
    THEN o.start ELSE p.begin END
  FROM placed p JOIN own o ON o.conv_id = p.conv_id AND o.n = p.n + 1),
windows AS (
  SELECT conv_id, begin, any_value(sys_chars) + sum(chars) AS chars,
    least({chat.HISTORY}, {chat.BUDGET} - any_value(sys) - (max(upto) - begin)) AS back
  FROM placed GROUP BY conv_id, begin),
repeats AS (
  SELECT w.conv_id, sum(o.chars) AS chars FROM windows w JOIN own o
    ON o.conv_id = w.conv_id AND o.start < w.begin AND w.begin - o.start <= w.back GROUP BY w.conv_id),
formatted AS (SELECT conv_id, sum(chars) AS chars FROM windows GROUP BY conv_id)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (any_value(f.chars) + coalesce(any_value(r.chars), 0))::BIGINT AS formatted_chars
FROM turns t JOIN formatted f USING (conv_id) LEFT JOIN repeats r USING (conv_id) GROUP BY t.conv_id"""


@query("op12_chat_formatting", CHAT_SQL)
def op12(spark: SparkSession, root: str) -> DataFrame:
    added = literal_rows(spark, "conv_id long, turn long, role string, text string", CONTROL_TURNS)
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digests(chat.format_windows(rows))


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
counts AS (
  SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
    1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (coalesce(s.n, 0) + l.v) AS p,
    1 + 1000000000::HUGEINT * (k.total + 1) // (l.n + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0)::BIGINT AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN shares a ON a.lang = g.lang AND a.source = g.source
  LEFT JOIN shares b ON b.lang = o.lang AND b.source = o.source AND b.term = a.term
  GROUP BY g.lang, g.source, o.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
QUALIFY rank <= 200"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11(spark: SparkSession, root: str) -> DataFrame:
    return divergence.divergence(table(spark, root, "documents"))
