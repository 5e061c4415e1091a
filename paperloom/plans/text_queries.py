"""Queries on line lists and text statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import lists, text_stats
from paperloom.plans.registry import query
from paperloom.session import table

SPLIT = r"string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')"
LINES = f"""
raw AS (SELECT doc_id, {SPLIT} AS parts FROM documents WHERE text IS NOT NULL),
lined AS (
  SELECT doc_id, k - 1 AS pos, parts[k] AS line
  FROM raw, unnest(range(1, CASE WHEN parts[len(parts)] = '' THEN len(parts) ELSE len(parts) + 1 END)) AS t(k)
)"""
STRIP = r"regexp_replace(line, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.explode_lines(table(spark, sf_dir, "documents"))


@query("list_pipeline", f"""
WITH {LINES}, cleaned AS (SELECT doc_id, pos, {STRIP} AS line FROM lined),
one AS (SELECT doc_id, min(pos) AS p, line FROM cleaned WHERE line <> '' GROUP BY doc_id, line),
ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, p) - 1 AS pos, line FROM one)
SELECT * FROM ranked WHERE pos < 10""")
def list_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trim, drop_empty, dedup, sort, head of every document's lines."""
    ops = [{"op": "trim"}, {"op": "drop_empty"}, {"op": "dedup"}, {"op": "sort"}, {"op": "head", "n": 10}]
    return lists.of_documents(table(spark, sf_dir, "documents"), ops)


@query("list_dedup_count", f"""
WITH {LINES}, one AS (SELECT doc_id, min(pos) AS pos, count(*) AS n, arg_min(line, pos) AS line FROM lined GROUP BY doc_id, lower(line))
SELECT doc_id, pos, n || chr(9) || line AS line FROM one""")
def list_dedup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.dedup(_lines(spark, sf_dir), keep="count", case_insensitive=True)


@query("list_dedup_last", f"WITH {LINES} SELECT doc_id, max(pos) AS pos, line FROM lined GROUP BY doc_id, line")
def list_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.dedup(_lines(spark, sf_dir), keep="last")


@query("list_filter_case_wrap", f"""
WITH {LINES} SELECT doc_id, pos, '<' || upper(replace(line, 'ß', 'ss')) || '>' AS line FROM lined WHERE contains(lower(line), 'the') AND NOT regexp_matches(line, '[0-9]{{4,}}')""")
def list_filter_case_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [
        {"op": "filter", "pattern": "THE", "case_insensitive": True},
        {"op": "filter", "pattern": "[0-9]{4,}", "regex": True, "exclude": True},
        {"op": "case", "mode": "upper"},
        {"op": "wrap", "prefix": "<", "suffix": ">"},
    ]
    return lists.pipeline(_lines(spark, sf_dir), ops)[0]


@query("list_reverse_tail", f"""
WITH {LINES}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) - 1 AS pos, line, count(*) OVER (PARTITION BY doc_id) AS n FROM lined)
SELECT doc_id, pos, line FROM r WHERE pos >= n - 3""")
def list_reverse_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.pipeline(_lines(spark, sf_dir), [{"op": "reverse"}, {"op": "tail", "n": 3}])[0]


@query("list_natural_sort", f"""
WITH {LINES}, keyed AS (
  SELECT *, list_transform(regexp_extract_all(lower(line), '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN '0' || lpad(ltrim(r, '0'), 40, '0') ELSE '1' || r END) AS key FROM lined)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY key DESC, pos) - 1 AS pos, line FROM keyed""")
def list_natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.sort(_lines(spark, sf_dir), descending=True, natural=True)


@query("list_envelope", f"""
WITH {LINES}, kept AS (SELECT doc_id, {STRIP} AS line FROM lined)
SELECT doc_id, count(*) AS original_count, count(DISTINCT line) FILTER (line <> '') AS count, count(*) - count(DISTINCT line) FILTER (line <> '') AS dropped FROM kept GROUP BY doc_id""")
def list_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _lines(spark, sf_dir)
    return lists.envelope(before, lists.pipeline(before, [{"op": "trim"}, {"op": "drop_empty"}, {"op": "dedup"}])[0])


@query("text_char_classes", r"""
SELECT doc_id, len(regexp_extract_all(text, '[㐀-䶿一-鿿豈-﫿]')) AS cjk, len(regexp_extract_all(text, '\p{L}')) - len(regexp_extract_all(text, '[㐀-䶿一-鿿豈-﫿]')) AS en_letter,
  len(regexp_extract_all(text, '\p{Nd}')) AS digit, len(regexp_extract_all(text, '[\p{P}\p{S}]')) AS punct, len(regexp_extract_all(text, '\s')) AS whitespace,
  length(text) - len(regexp_extract_all(text, '[\p{L}\p{Nd}\p{P}\p{S}\s]')) AS other
FROM documents""")
def text_char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stats.classes(table(spark, sf_dir, "documents"))


COUNTS = r"""
SELECT doc_id, source, length(text) AS char_total, length(text) - len(regexp_extract_all(text, '\s')) AS char_no_ws,
  len(regexp_extract_all(text, '[㐀-䶿一-鿿豈-﫿]')) AS cjk_chars, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*')) AS en_words,
  len(regexp_extract_all(text, '\d+(?:\.\d+)?')) AS numbers, len(regexp_extract_all(text, '[㐀-䶿一-鿿豈-﫿]')) + len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*')) AS word_total,
  len(list_filter(string_split_regex(text, '\n\s*\n+'), lambda p: regexp_matches(p, '\S'))) AS paragraphs,
  len(list_filter(string_split_regex(text, '[。！？!?\.]+\s*|[\r\n]{2,}'), lambda p: regexp_matches(p, '\S'))) AS sentences,
  len(list_filter(string_split_regex(text, '\r\n|[\n\r]'), lambda p: regexp_matches(p, '\S'))) AS lines
FROM documents"""


@query("text_counts", f"SELECT doc_id, char_total, char_no_ws, cjk_chars, en_words, numbers, word_total, paragraphs, sentences, lines, CAST(round_even(CAST(cjk_chars AS DECIMAL(20,6)) / 300 + CAST(en_words AS DECIMAL(20,6)) / 200, 1) AS DOUBLE) AS reading_min FROM ({COUNTS})")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stats.counts(table(spark, sf_dir, "documents"), "doc_id")


@query("text_rollup", f"""
SELECT source, count(*) AS file_count, sum(char_total)::BIGINT AS char_total, sum(char_no_ws)::BIGINT AS char_no_ws, sum(cjk_chars)::BIGINT AS cjk_chars, sum(en_words)::BIGINT AS en_words, sum(numbers)::BIGINT AS numbers,
  sum(word_total)::BIGINT AS word_total, sum(paragraphs)::BIGINT AS paragraphs, sum(sentences)::BIGINT AS sentences, sum(lines)::BIGINT AS lines, round_even(sum(word_total) / count(*), 1) AS avg_words_per_file
FROM ({COUNTS}) GROUP BY source""")
def text_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stats.rollup(text_stats.counts(table(spark, sf_dir, "documents"), "doc_id", "source"), "source")


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("term_frequency", rf"""
WITH w AS (SELECT lang, regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*') AS ws FROM documents),
t AS (SELECT lang, k - 1 AS place, lower(ws[k]) AS term FROM w, unnest(range(1, len(ws) + 1)) AS u(k)),
c AS (SELECT lang, term, count(*) AS count, min(place) AS f FROM t WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY ALL)
SELECT lang, term, count, CAST(row_number() OVER (PARTITION BY lang ORDER BY count DESC, f, term) AS INTEGER) AS rank FROM c QUALIFY rank <= 20""")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stats.top_terms(text_stats.word_terms(table(spark, sf_dir, "documents"), "lang"), 20, "lang")


_SIGNS = "translate(text, 'aeiou', '天地人山水')"


def _with_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose vowels are written as CJK characters."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.translate("text", "aeiou", "天地人山水").alias("text"))


@query("cjk_term_frequency", f"""
WITH w AS (SELECT lang, regexp_extract_all({_SIGNS}, '[天地人山水]') AS ws FROM documents),
t AS (SELECT lang, k - 1 AS place, ws[k] AS term FROM w, unnest(range(1, len(ws) + 1)) AS u(k)),
c AS (SELECT lang, term, count(*) AS count, min(place) AS f FROM t GROUP BY ALL)
SELECT lang, term, count, CAST(row_number() OVER (PARTITION BY lang ORDER BY count DESC, f, term) AS INTEGER) AS rank FROM c QUALIFY rank <= 4""")
def cjk_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stats.top_terms(text_stats.cjk_terms(_with_signs(spark, sf_dir), "lang"), 4, "lang")


@query("cjk_bigram_frequency", f"""
WITH s AS (SELECT doc_id, lang, string_split({_SIGNS}, '') AS s FROM documents),
p AS (SELECT doc_id, lang, k, s[k] || s[k + 1] AS term FROM s, unnest(range(1, len(s))) AS u(k) WHERE s[k] IN ('天', '地', '人', '山', '水') AND s[k + 1] IN ('天', '地', '人', '山', '水')),
t AS (SELECT lang, term, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place FROM p),
c AS (SELECT lang, term, count(*) AS count, min(place) AS f FROM t GROUP BY ALL)
SELECT lang, term, count, CAST(row_number() OVER (PARTITION BY lang ORDER BY count DESC, f, term) AS INTEGER) AS rank FROM c QUALIFY rank <= 20""")
def cjk_bigram_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stats.top_terms(text_stats.cjk_bigrams(_with_signs(spark, sf_dir), "lang"), 20, "lang")


@query("language_guess", r"""
WITH h AS (SELECT doc_id, text[1:2000] AS t FROM documents),
c AS (SELECT doc_id, len(regexp_extract_all(t, '[一-鿿]')) AS cjk, len(regexp_extract_all(t, '\p{L}')) AS letters FROM h)
SELECT doc_id, CASE WHEN letters = 0 THEN 'auto' WHEN cjk > 0.3 * letters THEN 'zh' ELSE 'en' END AS guess FROM c""")
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.guess_language(F.col("text")).alias("guess"))


@query("script_language", r"""
WITH h AS (SELECT doc_id, left(text, 5000) AS t FROM documents),
c AS (SELECT doc_id, t, length(t) AS n, len(regexp_extract_all(t, '[㐀-鿿가-힯぀-ヿ]')) * 10 > length(t) AS han, len(regexp_extract_all(t, '[぀-ヿ]')) AS ja,
  len(regexp_extract_all(t, '[ㄅ-ㄯ的是不為這個]')) AS hant, len(regexp_extract_all(t, '[这为么会个时间]')) AS hans FROM h)
SELECT doc_id, CASE WHEN coalesce(t, '') = '' THEN 'unknown' WHEN han AND ja * 20 > n THEN 'ja' WHEN han AND hant >= hans THEN 'zh-Hant' WHEN han THEN 'zh-Hans' ELSE 'en' END AS language FROM c""")
def script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.script_language(F.col("text")).alias("language"))


@query("noise_filter", r"""
WITH c AS (SELECT doc_id, greatest(length(text), 1) AS n, len(regexp_extract_all(text, '[\x{c0}-\x{24f}]')) AS extra, len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{e000}-\x{f8ff}]')) AS control,
  len(regexp_extract_all(text, '[A-Za-z]')) AS letters, len(regexp_extract_all(text, '[AEIOUaeiou]')) AS vowels, len(regexp_extract_all(text, '[一-鿿]')) AS cjk FROM documents)
SELECT doc_id, (extra >= 5 AND extra > 0.1 * n) OR control > 0.2 * n OR (letters >= 8 AND vowels < 0.12 * letters AND cjk = 0) AS noisy FROM c""")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.noisy(F.col("text")).alias("noisy"))


@query("no_translate_lines", rf"""
WITH {LINES}, s AS (SELECT doc_id, {STRIP} AS s FROM lined)
SELECT doc_id, count(*) AS lines, count(*) FILTER (s = '' OR regexp_matches(s, '^[.\-_=*~·…\s]+$') OR regexp_matches(s, '^(```|~~~)') OR regexp_matches(s, '^[#>*+\-|]+$') OR regexp_matches(s, '^</?[A-Za-z][^>]*>$')
  OR regexp_matches(s, '^https?://\S+$') OR regexp_matches(s, '^\|?[\s:\-|]+\|?$')) AS kept FROM s GROUP BY doc_id""")
def no_translate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.keep_as_is(F.col("line"))).alias("kept"))


@query("spreadsheet_safe_lines", rf"""
WITH {LINES} SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^[=+\-@\x09\x0d]') THEN '''' || line ELSE line END AS line FROM lined""")
def spreadsheet_safe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("line", T.spreadsheet_safe(F.col("line")))


@query("title_case_names", "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name), '[a-z]+|[^a-z]+'), lambda w: upper(w[1:1]) || w[2:]), '') AS title FROM part")
def title_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.title_case(F.col("p_name")).alias("title"))


@query("first_sentences", r"""
WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(replace(regexp_replace(text, '([.!?。！？])[ \n\t]+', '\1' || chr(1), 'g'), chr(10), chr(1)), '\x01+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM conversations)
SELECT conv_id, turn, CAST(len(s) AS INTEGER) AS sentences, s[1] AS first_sentence FROM s""")
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations").withColumn("s", T.sentences(F.col("text")))
    return found.select("conv_id", "turn", F.size("s").alias("sentences"), F.get("s", F.lit(0)).alias("first_sentence"))
