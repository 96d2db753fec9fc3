"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, collocations, exact_dedup, ngram_join, packing, pii, quality_rules, ranked_search, suffix_dedup, tiered_packing, token_counts, url_filters, warc

#: The rules of the URL query: (host, path, verdict).
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file, and nothing more: operators take paths."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=100)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern(), rule="largest")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"), min_payload=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filters.rule_table(spark, URL_RULES)
    return url_filters.url_filter(table(spark, sf_dir, "pages"), rules)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), all_digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = tiered_packing.tiered_packing(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_size", "step")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_ngram_join": op4_ngram_join,
    "op5_url_filters": op5_url_filters,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii": op9_pii,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_tiered_packing": op12_tiered_packing,
    "op13_ranked_search": op13_ranked_search,
}

_SPACES = r"[\x20\x09-\x0D]"

ORACLE_SQL = {
    "op1_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS win FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM b WHERE n >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS turn FROM w) WHERE turn > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM again),
islands AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked),
spans AS (SELECT doc_id, island, min(i) AS a, max(i) + 100 AS z FROM islands GROUP BY doc_id, island),
edges AS (SELECT doc_id, island, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS gone FROM spans),
sums AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS runs, max(z) AS last FROM spans GROUP BY doc_id),
kept AS (SELECT b.doc_id, string_agg(substr(h, CAST(2 * gone + 1 AS BIGINT), CAST(2 * (a - gone) AS BIGINT)), '' ORDER BY a) AS head FROM b JOIN edges e ON e.doc_id = b.doc_id GROUP BY b.doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM b LEFT JOIN sums ON sums.doc_id = b.doc_id LEFT JOIN kept ON kept.doc_id = b.doc_id
""",
    "op3_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, n, h, list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * g AS BIGINT), 5) AS INTEGER) >> s) & 31) AS BIGINT), 1)), lambda x, y: x || y)), lambda x, y: x || y) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
""",
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * k >= 75 * (m.n + o.n - k)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
l AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM l LEFT JOIN n ON n.doc_id = node JOIN (SELECT doc_id AS id FROM documents) ON id = node
""".replace("SELECT doc_id, coalesce(n, 0)", "SELECT id AS doc_id, coalesce(n, 0)"),
    "op5_url_filters": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules AS (
  SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS r(rule_host, rule_path, rule_verdict)),
hits AS (
  SELECT h.page_id, h.host, h.path, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY h.page_id ORDER BY length(rule_host || rule_path) DESC) AS n
  FROM hosts h LEFT JOIN rules ON (h.host = rule_host OR ends_with(h.host, '.' || rule_host)) AND starts_with(h.path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM hits WHERE n = 1
""",
    "op7_exact_dedup": rf"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '{_SPACES}', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
""",
    "op8_quality_rules": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: [words[i], words[i + 1], words[i + 2]])) AS win,
    unnest(range(1, len(words) - 1)) AS i FROM w),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(list_distinct(list_filter(list_transform(words, lambda x: lower(x)), lambda x: list_contains(string_split('"""
    + " ".join(quality_rules.STOP_WORDS)
    + r"""', ' '), x)))) AS n_stop_words
  FROM w JOIN l USING (doc_id) LEFT JOIN repeated USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 1000000 AND 100 * n_symbols <= 10 * n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words
    AND 100 * n_dup_lines <= 50 * n_lines AND n_stop_words >= 2 AS kept
FROM b
""",
    "op11_phrase_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS t FROM p),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(t) - size + 2), lambda i: array_to_string(t[i:i + size - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS size)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT lang, size, phrase, a FROM f WHERE size >= 2 AND a >= 30),
k AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS t, unnest(range(1, size)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.size, k.a, k, x.a AS l, y.a AS r, (2000000 * CAST(k.a AS HUGEINT)) // (CAST(x.a AS HUGEINT) + y.a) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(t[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(t[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (
  SELECT DISTINCT b.lang, b.phrase FROM b JOIN (SELECT lang, a, string_split(phrase, ' ') AS t, size FROM c WHERE size > 2) o
    ON b.lang = o.lang AND 100 * o.a >= 80 * b.a AND b.size < o.size AND b.phrase IN (
      array_to_string(o.t[1:b.size], ' '), array_to_string(o.t[2:b.size + 1], ' '), CASE WHEN b.size + 2 <= o.size THEN array_to_string(o.t[3:b.size + 2], ' ') END)),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b ANTI JOIN h USING (lang, phrase) JOIN n USING (lang) QUALIFY rank <= 2000
""",
    "op13_ranked_search": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY row, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, row)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50
""",
}
