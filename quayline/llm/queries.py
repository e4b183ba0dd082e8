"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .conversation_repair import damage, repair_conversations
from .decontaminate import contaminated
from .html_extract import extract_main_text
from .language_id import identify_languages
from .line_dedup import drop_shared_lines
from .minhash_forest import near_duplicates
from .order_minhash import fingerprints_with_edit
from .packing import pack_sequences
from .phrases import collocations
from .quality_rank import rank_quality
from .secret_scan import scan_secrets
from .token_count import count_tokens
from .url_filter import RULES, filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4, percent=80)


@register
def op2_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir), assign="match")


@register
def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


@register
def op4_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register
def op5_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), length=4096)


@register
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edit(documents(spark, sf_dir))


@register
def op7_count_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@register
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_shared_lines(documents(spark, sf_dir, "doc_id", "text"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE["op8_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key
  HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.last_doc AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@register
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@register
def op10_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@register
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    return repair_conversations(rows, F.col("present")).withColumn(
        "repaired_sha256", F.sha2(F.encode(F.array_join(lines, "\n"), "UTF-8"), 256)).drop("repaired")


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@register
def op12_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("template", "share")


_SHAPED = "regexp_replace(regexp_replace(path, '[0-9]+', '0', 'g'), '^/+|/+$', '', 'g')"
_RULE_SQL = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}"
    for i, (_, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2])))
ORACLE["op12_url_templates"] = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), {_LETTERS}) AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (
  SELECT *, CASE {_RULE_SQL.format(*[repr(h + p) for _, h, p in RULES])} END AS rule,
         CASE {_RULE_SQL.format(*[repr(a) for a, _, _ in RULES])} END AS action, {_SHAPED} AS shaped FROM parsed),
paths AS (
  SELECT host, shaped, count(*) AS pages, count(action) AS labels, count(*) FILTER (WHERE action = 'block') AS blocked,
         CASE WHEN shaped = '' THEN [] ELSE string_split(shaped, '/') END AS parts FROM judged GROUP BY host, shaped),
nodes AS (
  SELECT host, shaped, pages, depth, parts[depth] AS shape, array_to_string(parts[1:depth], '/') AS branch
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS depth FROM paths)),
counts AS (SELECT host, depth, branch, sum(pages) AS pages FROM nodes GROUP BY ALL),
wide_nodes AS (SELECT depth, branch, count(*) AS hosts FROM counts GROUP BY ALL),
constant AS (
  SELECT host, depth, branch FROM counts JOIN wide_nodes USING (depth, branch) WHERE pages >= 8 OR hosts >= 3),
named AS (
  SELECT n.host, n.shaped, list(CASE WHEN c.host IS NULL THEN '*' ELSE n.shape END ORDER BY n.depth) AS parts
  FROM nodes n LEFT JOIN constant c ON c.host = n.host AND c.depth = n.depth AND c.branch = n.branch
  GROUP BY n.host, n.shaped),
templates AS (
  SELECT p.host, p.shaped, '/' || coalesce(array_to_string(n.parts, '/'), '') AS template,
         coalesce(array_to_string(n.parts[1:len(n.parts) - 1], '/'), '') || ' ' || coalesce(len(n.parts), 0) AS parent,
         pages, labels, blocked
  FROM paths p LEFT JOIN named n ON n.host = p.host AND n.shaped = p.shaped),
own AS (
  SELECT host, parent, template, sum(labels) AS labels, sum(blocked) AS blocked FROM templates GROUP BY ALL),
pool AS (SELECT host, parent, sum(blocked) / nullif(sum(labels), 0) AS p FROM own GROUP BY ALL),
marked AS (
  SELECT own.*, CASE WHEN labels = 0 THEN true
                     ELSE abs(blocked / labels - p) <= CAST(2 AS DOUBLE) * sqrt(p * (1 - p) / labels) END AS alike
  FROM own JOIN pool USING (host, parent)),
merged AS (SELECT host, parent, sum(labels) AS ml, sum(blocked) AS mb FROM marked WHERE alike GROUP BY ALL),
merged_counts AS (
  SELECT host, template, CASE WHEN alike THEN ml ELSE labels END AS labels, CASE WHEN alike THEN mb ELSE blocked END AS blocked
  FROM marked LEFT JOIN merged USING (host, parent)),
prior AS (SELECT CASE WHEN sum(labels) > 0 THEN sum(blocked) / sum(labels) ELSE CAST(1 AS DOUBLE) / 2 END AS p FROM templates),
wide AS (
  SELECT template, (sum(blocked) + CAST(4 AS DOUBLE) * any_value(p)) / (sum(labels) + CAST(4 AS DOUBLE)) AS towards
  FROM templates CROSS JOIN prior GROUP BY template),
verdicts AS (
  SELECT t.host, t.shaped, (c.blocked + CAST(4 AS DOUBLE) * w.towards) / (c.labels + CAST(4 AS DOUBLE)) AS share
  FROM templates t JOIN merged_counts c ON c.host = t.host AND c.template = t.template JOIN wide w ON w.template = t.template)
SELECT page_id, j.host, path, rule,
       CASE WHEN action IS NOT NULL THEN action WHEN share > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM judged j JOIN verdicts v ON v.host = j.host AND v.shaped = j.shaped"""


@register
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(documents(spark, sf_dir, "doc_id", "lang", "text"), min_count=30, top=2000)
    return found.drop("doc_id")


def _grams(n: int) -> str:
    words = " || ' ' || ".join(["w", *[f"lead(w, {i}) OVER g" for i in range(1, n)]])
    return f"SELECT lang, {n} AS words, {words} AS phrase FROM words WINDOW g AS (PARTITION BY row, piece ORDER BY pos)"


ORACLE["op13_phrase_collocations"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
split AS (
  SELECT row, lang, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS t FROM docs),
lists AS (SELECT row, lang, piece, regexp_split_to_array(t, '[\\x20\\x09]+') AS ws FROM split),
words AS (
  SELECT * FROM (SELECT row, lang, piece, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM lists) WHERE w <> ''),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, words, phrase, count(*) AS f FROM ({" UNION ALL ".join(_grams(n) for n in range(1, 5))})
  WHERE phrase IS NOT NULL GROUP BY lang, words, phrase),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words >= 2 AND f >= 30),
cuts AS (
  SELECT lang, words, phrase, f, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:words], ' ') AS q
  FROM (SELECT *, unnest(generate_series(1, words - 1)) AS k FROM cand)),
scored AS (
  SELECT c.lang, c.words, c.phrase, c.f AS a, k, x.f AS l, y.f AS r,
         CAST((2000000::HUGEINT * c.f) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, f, array_to_string(w[i:i + n - 1], ' ') AS part
  FROM (SELECT *, unnest(generate_series(1, words - n + 1)) AS i
        FROM (SELECT *, unnest(generate_series(2, words - 1)) AS n FROM cand WHERE words > 2))),
longer AS (SELECT lang, part, max(f) AS f FROM parts GROUP BY lang, part),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN longer g ON g.lang = w.lang AND g.part = w.phrase
  WHERE g.f IS NULL OR 100::HUGEINT * g.f < 80::HUGEINT * w.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000"""

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
