"""SQL for an independent engine that gives the rows of the registered queries."""

from __future__ import annotations

from .functions.text import CONTRACTIONS, LIGHT_WORDS, NEVER_ANCHORS, UNITS
from .operators.sentences import _GUARD

W = r"[\p{L}\p{N}_]"


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def norm(x: str) -> str:
    """Of an expression; the hyphen rule is applied twice, as matches can't overlap."""
    y = f"replace(replace(lower(coalesce({x}, '')), '—', ' '), '–', '-')"
    for _ in range(2):
        y = f"regexp_replace({y}, '({W})-({W})', '\\1\\2', 'g')"
    for pattern, new in ((r"[^\p{L}\p{N}_''\s]", " "), (r"\s''\s", " "), (r"^''\s", ""), (r"\s''$", ""), (r"\s+", " ")):
        y = f"regexp_replace({y}, '{pattern}', '{new}', 'g')"
    return f"trim({y})"


def tokens(x: str) -> str:
    return f"regexp_extract_all({norm(x)}, '{W}[\\p{{L}}\\p{{N}}_'']*')"


def sentence_list(x: str) -> str:
    y = f"replace(translate(coalesce({x}, ''), '\"''', ''), '...', ' <ELLIPSIS> ')"
    y = f"regexp_replace({y}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    for _ in range(2):
        y = f"regexp_replace({y}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({_GUARD})\\.' || chr(1), '\\1\\2. ', 'g')"
    y = f"list_transform(string_split({y}, chr(1)), lambda s: trim(regexp_replace(replace(s, '<ELLIPSIS>', '...'), '\\s+', ' ', 'g')))"
    return f"list_transform(list_filter({y}, lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END)"


def token_rows(source: str = "docs") -> str:
    return f"toks AS (SELECT doc_id, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos, unnest(t) AS token FROM (SELECT doc_id, {tokens('text')} AS t FROM {source}))"


def spent(words: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform({words}, lambda w: 60 * length(w) + 40)), 0) AS BIGINT)"


def ratio(a: str, b: str) -> str:
    row = (
        f"list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda z: 0), list_transform(string_split({a}, ''), lambda c: [ord(c)])), lambda r, x: "
        f"list_reduce(list_transform(range(0, length({b}) + 1), lambda j: [CAST(j AS INTEGER)]), lambda o, j: list_append(o, CASE WHEN ord({b}[j[1]]) = x[1] THEN r[j[1]] + 1 ELSE greatest(r[j[1] + 1], o[-1]) END)))"
    )
    return f"200.0::DOUBLE * ({row})[-1] / (length({a}) + length({b}))"


DOCS = "docs AS (SELECT doc_id, text FROM documents)"
ITEMS = "docs AS (SELECT item_id AS doc_id, text FROM benchmark)"
SENTENCES = f"sents AS (SELECT doc_id, CAST(unnest(range(1, len(s) + 1)) AS INTEGER) AS idx, unnest(s) AS sentence FROM (SELECT doc_id, {sentence_list('text')} AS s FROM docs))"
SPANS = f"""{SENTENCES},
timed AS (SELECT doc_id, idx, sentence AS text, CAST(coalesce(list_sum(list_transform({tokens('sentence')}, lambda t: 60 * length(t) + 40)), 0) AS BIGINT) AS took FROM sents),
ends AS (SELECT *, CAST(sum(took) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS stop, (doc_id + idx) % 7 = 0 AS failed, (doc_id + idx) % 5 = 0 AS warned FROM timed),
spans AS (
  SELECT doc_id, idx, text, CASE WHEN NOT failed THEN greatest(0, stop - took - 100) END AS start_ms, CASE WHEN NOT failed THEN stop + 100 END AS end_ms,
    CASE WHEN failed THEN 'failed' WHEN warned THEN 'warning' ELSE 'ok' END AS status,
    CAST(CASE WHEN failed THEN 0.0 WHEN warned THEN 0.8 ELSE 0.95 END AS DOUBLE) AS score,
    CASE WHEN failed THEN 'no viable span found' WHEN warned THEN 'acceptable but low score' ELSE 'good match' END AS note
  FROM ends)"""
OTHER = "other AS (SELECT doc_id, idx, text, CASE WHEN (doc_id + idx) % 4 <> 0 THEN start_ms + idx % 9 * 100 END AS start_ms, CASE WHEN (doc_id + idx) % 4 <> 0 THEN end_ms + idx % 9 * 100 END AS end_ms FROM spans)"
BLOCKS = """repeats AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS audio_idx, CAST((end_ms - start_ms) / 1000.0 AS DOUBLE) AS seconds,
    CAST(CASE WHEN (end_ms - start_ms) / 1000.0 < 4.5 THEN 3 ELSE 5 END AS INTEGER) AS num_repeats, CAST(round((end_ms - start_ms) / CAST(0.92 AS DOUBLE)) AS BIGINT) AS clip_ms
  FROM spans WHERE start_ms IS NOT NULL),
blocks AS (
  SELECT *, block_end - lasts AS block_start FROM (
    SELECT *, CAST(sum(lasts) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS block_end FROM (
      SELECT *, num_repeats * clip_ms + (num_repeats - 1) * 10000 + 10000 AS lasts FROM repeats)))"""
COUNTS = """counts AS (
  SELECT doc_id, count(*) AS num_sentences, count(start_ms) AS aligned, count(*) - count(start_ms) AS unaligned, count(*) FILTER (status = 'warning') AS warnings,
    CAST(0 AS BIGINT) AS external, count(start_ms) AS fuzzy FROM spans GROUP BY doc_id)"""
ANCHORS = f"""{SENTENCES},
stoks AS (SELECT doc_id, idx, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos, unnest(t) AS token FROM (SELECT doc_id, idx, {tokens('sentence')} AS t FROM sents)),
idf AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + count(*) OVER (PARTITION BY doc_id, token) / CAST(count(*) OVER (PARTITION BY doc_id) AS DOUBLE)) AS v FROM stoks),
scored AS (
  SELECT doc_id, idx, pos, token, CASE WHEN regexp_matches(token, '^\\p{{Nd}}') THEN v + 1.0::DOUBLE ELSE v END AS score FROM idf
  WHERE lower(token) NOT IN ({_listed(NEVER_ANCHORS)}) AND (regexp_matches(token, '^\\p{{Nd}}') OR length(token) >= 5)),
anchors AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY score DESC, pos DESC, token DESC) <= 3)"""
ENDS = f"{DOCS}, {token_rows()}, line AS (SELECT doc_id, pos, token AS word, CAST(sum(60 * length(token) + 40) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS end_ms, 60 * length(token) + 40 AS took FROM toks)"
_UNIT = "CASE rtrim(lower(token), 's.') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in UNITS.items()) + " ELSE token END"
_LONG = "CASE replace(lower(token), '''', '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONTRACTIONS.items()) + " ELSE token END"
_MINUTES = "lpad(CAST(ms // 60000 AS VARCHAR), CAST(greatest(2, length(CAST(ms // 60000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0')"
_READS = " || ".join(
    f"CASE WHEN num_repeats > {i} THEN '\"{name}_read_start\":' || (block_start + {i} * (clip_ms + 10000)) || ',\"{name}_read_end\":' || (block_start + {i} * (clip_ms + 10000) + clip_ms) || ',' ELSE '' END"
    for i, name in enumerate(("first", "second", "third", "fourth", "fifth"))
)

ORACLE_SQL = {
    "strip_quotes": "SELECT doc_id, translate(text, '\"''', '') AS text FROM documents",
    "normalize_text": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "tokenize_docs": f"WITH {DOCS}, {token_rows()} SELECT doc_id, pos, token FROM toks",
    "sentence_split": f"WITH {DOCS}, {SENTENCES} SELECT doc_id, idx, sentence FROM sents",
    "token_freq": f"WITH {DOCS}, {token_rows()} SELECT doc_id, token, count(*) AS n FROM toks GROUP BY ALL",
    "token_idf": f"WITH {DOCS}, {token_rows()}, f AS (SELECT doc_id, token, count(*) AS n FROM toks GROUP BY ALL) SELECT doc_id, token, 1.0::DOUBLE / (1.0::DOUBLE + n / CAST(sum(n) OVER (PARTITION BY doc_id) AS DOUBLE)) AS idf FROM f",
    "distinct_vocab": f"WITH {DOCS}, {token_rows()} SELECT token, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM toks GROUP BY token",
    "anchors_top3": f"WITH {DOCS}, {ANCHORS} SELECT doc_id, idx, pos, token, score FROM anchors",
    "token_weight": f"WITH {DOCS}, {token_rows()} SELECT doc_id, pos, token, CAST(CASE WHEN token IN ({_listed(LIGHT_WORDS)}) THEN 0.5 WHEN regexp_matches(token, '^\\p{{Nd}}') THEN 1.25 ELSE 1.0 END AS DOUBLE) AS weight FROM toks",
    "unit_normalize": f"WITH {DOCS}, {token_rows()} SELECT DISTINCT token, {_UNIT} AS unit, {_LONG} AS long_form FROM toks",
    "number_equiv_digits": """WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\t\\n]+')) AS word FROM documents),
d AS (SELECT word, regexp_replace(word, '[^0-9]', '', 'g') AS digits FROM w WHERE regexp_matches(word, '[0-9]'))
SELECT x.digits, x.word AS a, y.word AS b FROM d x JOIN d y ON x.digits = y.digits AND x.word < y.word""",
    "indel_ratio_pairs": f"WITH {ITEMS}, {token_rows()}, p AS (SELECT token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM toks), d AS (SELECT DISTINCT a, b FROM p WHERE b IS NOT NULL) SELECT a, b, round({ratio('a', 'b')}, 6) AS ratio FROM d",
    "fuzzy_vocab_join": f"""WITH {ITEMS}, {token_rows()}, v AS (SELECT DISTINCT token FROM toks),
p AS (SELECT x.token AS a, y.token AS b FROM v x JOIN v y ON x.token < y.token AND 200.0 * least(length(x.token), length(y.token)) >= 92.0 * (length(x.token) + length(y.token))),
r AS (SELECT a, b, {ratio('a', 'b')} AS ratio FROM p) SELECT a, b, round(ratio, 6) AS ratio FROM r WHERE ratio >= 92.0""",
    "ngrams": f"WITH {ITEMS}, {token_rows()}, l AS (SELECT doc_id, pos, token, lead(token, 1) OVER o AS t1, lead(token, 2) OVER o AS t2 FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos, token || ' ' || t1 AS bigram, token || t1 AS two, token || t1 || t2 AS three FROM l",
    "compound_matches": f"""WITH {DOCS}, {token_rows()}, l AS (SELECT doc_id, pos, token, lead(token, 1) OVER o AS t1, lead(token, 2) OVER o AS t2 FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT doc_id, pos, 2 AS size, token || t1 AS run FROM l WHERE t1 IS NOT NULL UNION ALL SELECT doc_id, pos, 3, token || t1 || t2 FROM l WHERE t2 IS NOT NULL),
k AS (SELECT DISTINCT doc_id, token FROM toks WHERE length(token) > 8), r AS (SELECT DISTINCT doc_id, run FROM n),
d AS (SELECT doc_id, token, run FROM (SELECT doc_id, token, regexp_replace(token, '[^0-9]', '', 'g') AS x FROM k) JOIN (SELECT doc_id, run, regexp_replace(run, '[^0-9]', '', 'g') AS y FROM r) USING (doc_id) WHERE x = y AND x <> ''),
c AS (SELECT doc_id, token, run FROM k JOIN r USING (doc_id) WHERE 200.0 * least(length(token), length(run)) >= 92.0 * (length(token) + length(run)) AND levenshtein(token, run) <= 0.08 * (length(token) + length(run)) * CASE WHEN strlen(token) + strlen(run) = length(token) + length(run) THEN 1 ELSE 4 END + 0.001),
s AS (SELECT doc_id, token, run FROM c WHERE token = run OR {ratio('token', 'run')} >= 92.0),
p AS (SELECT * FROM d UNION SELECT * FROM s)
SELECT p.doc_id, token, pos, CAST(size AS INTEGER) AS size FROM p JOIN n ON n.doc_id = p.doc_id AND n.run = p.run""",
    "word_timeline": f"WITH {ENDS} SELECT doc_id, pos, word, end_ms - took AS start_ms, end_ms FROM line",
    "band_candidates": f"""WITH {ITEMS}, {token_rows()}, {SENTENCES},
f AS (SELECT doc_id, idx, t[1] AS word, len(t) AS n FROM (SELECT doc_id, idx, {tokens('sentence')} AS t FROM sents) WHERE len(t) > 0),
m AS (SELECT f.doc_id, idx, pos AS start, greatest(pos, pos + n - 1 - 10) AS low, least(total - 1, pos + n - 1 + 10) AS high
  FROM f JOIN toks ON f.doc_id = toks.doc_id AND f.word = toks.token JOIN (SELECT doc_id, count(*) AS total FROM toks GROUP BY doc_id) c ON c.doc_id = f.doc_id)
SELECT doc_id, idx, start, CAST(unnest(range(low, high + 1)) AS INTEGER) AS end FROM m WHERE low <= high""",
    "anchor_ranges": f"""WITH {DOCS}, {token_rows()}, {ANCHORS},
starts AS (SELECT doc_id, idx, n, sum(n) OVER (PARTITION BY doc_id ORDER BY idx) - n AS start FROM (SELECT doc_id, idx, len({tokens('sentence')}) AS n FROM sents))
SELECT a.doc_id, a.idx, min(t.pos) AS low, max(t.pos) AS high, count(DISTINCT a.token) AS n_found FROM (SELECT DISTINCT doc_id, idx, token FROM anchors) a
JOIN starts s ON a.doc_id = s.doc_id AND a.idx = s.idx JOIN toks t ON a.doc_id = t.doc_id AND a.token = t.token AND t.pos >= s.start AND t.pos < s.start + greatest(s.n, 500) GROUP BY a.doc_id, a.idx""",
    "align_external": f"""WITH {ITEMS}, {SENTENCES},
spoken AS (
  SELECT doc_id, list_filter(list_transform(t, lambda w, i: CASE WHEN i % 17 = 0 THEN NULL WHEN i % 11 = 0 THEN left(w, length(w) - 1) ELSE w END), lambda w: w IS NOT NULL) AS words
  FROM (SELECT doc_id, {tokens('text')} AS t FROM docs)),
asked AS (SELECT s.doc_id, idx, sentence, {tokens('sentence')} AS t, words FROM sents s JOIN spoken p ON s.doc_id = p.doc_id),
found AS (SELECT *, CASE WHEN len(t) > 0 THEN list_filter(range(1, len(words) - len(t) + 2), lambda i: words[i:i + len(t) - 1] = t)[1] END AS place FROM asked)
SELECT doc_id, idx, sentence AS text, CASE WHEN place IS NULL THEN 'failed' ELSE 'ok' END AS status, CAST(NULL AS DOUBLE) AS score, CASE WHEN place IS NULL THEN 'no times found' ELSE '' END AS note,
  CASE WHEN place IS NOT NULL THEN greatest(0, {spent('words[1:place - 1]')} - 100) END AS start_ms, CASE WHEN place IS NOT NULL THEN {spent('words[1:place + len(t) - 1]')} + 100 END AS end_ms
FROM found""",
    "hybrid_merge": f"""WITH {DOCS}, {SPANS}, {OTHER}
SELECT o.doc_id, o.idx, o.text, coalesce(o.start_ms, s.start_ms) AS start_ms, coalesce(o.end_ms, s.end_ms) AS end_ms,
  CASE WHEN o.start_ms IS NOT NULL THEN 'external' WHEN s.start_ms IS NOT NULL THEN 'fuzzy' END AS method FROM other o JOIN spans s ON o.doc_id = s.doc_id AND o.idx = s.idx""",
    "manual_override": f"""WITH {DOCS}, {SPANS} SELECT doc_id, idx, CASE WHEN idx % 3 = 0 THEN CAST(idx AS BIGINT) * 1000 + 2 ELSE start_ms END AS start_ms,
  CASE WHEN idx % 3 = 0 THEN CAST(idx AS BIGINT) * 1000 + 3500 ELSE end_ms END AS end_ms, idx % 3 = 0 AS adjusted FROM spans""",
    "aligned_renumber": f"WITH {DOCS}, {SPANS} SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS audio_idx, start_ms, end_ms FROM spans WHERE start_ms IS NOT NULL",
    "repeat_rule": f"WITH {DOCS}, {SPANS}, {BLOCKS} SELECT doc_id, idx, seconds, num_repeats FROM repeats",
    "repeat_histogram": f"WITH {DOCS}, {SPANS}, {BLOCKS} SELECT num_repeats, count(*) AS n_sentences, CAST(sum(num_repeats) AS BIGINT) AS n_reads FROM repeats GROUP BY num_repeats",
    "block_ends": f"WITH {DOCS}, {SPANS}, {BLOCKS} SELECT doc_id, idx, CAST(audio_idx AS INTEGER) AS audio_idx, clip_ms, num_repeats, block_start, block_end FROM blocks",
    "read_offsets": f"""WITH {DOCS}, {SPANS}, {BLOCKS}, r AS (SELECT doc_id, idx, block_start, clip_ms, CAST(unnest(range(1, num_repeats + 1)) AS INTEGER) AS rep FROM blocks)
SELECT doc_id, idx, rep, block_start + (rep - 1) * (clip_ms + 10000) AS read_start_ms, block_start + (rep - 1) * (clip_ms + 10000) + clip_ms AS read_end_ms FROM r""",
    "report_details": f"WITH {DOCS}, {SPANS} SELECT doc_id, idx, left(text, 120) AS text, status, score, note AS reason, 'fuzzy' AS method FROM spans WHERE status <> 'ok'",
    "report_counts": f"WITH {DOCS}, {SPANS}, {COUNTS} SELECT * FROM counts",
    "summary_line": f"WITH {DOCS}, {SPANS}, {COUNTS} SELECT doc_id, 'aligned ' || aligned || ' of ' || num_sentences || ' (' || printf('%.1f', round(aligned * 100.0::DOUBLE / num_sentences, 1)) || '%), failed ' || unaligned || ', warnings ' || warnings AS summary FROM counts",
    "success_rate": f"WITH {DOCS}, {SPANS}, {COUNTS} SELECT CAST(sum(aligned) AS BIGINT) AS aligned, CAST(sum(num_sentences) AS BIGINT) AS sentences, CAST(sum(aligned) AS BIGINT) * 100.0::DOUBLE / CAST(sum(num_sentences) AS BIGINT) AS rate FROM counts",
    "summary_text": f"""WITH {DOCS}, {SPANS}, {COUNTS}, d AS (SELECT doc_id, idx, left(text, 120) AS text, status, score FROM spans WHERE status <> 'ok'),
i AS (SELECT doc_id, string_agg(chr(10) || '  [' || idx || '] ' || status || ' (score: ' || printf('%.2f', score) || ', method: fuzzy) - ' || left(text, 60) || CASE WHEN length(text) > 60 THEN '...' ELSE '' END, '' ORDER BY idx) AS lines FROM d GROUP BY doc_id)
SELECT counts.doc_id, 'Alignment Summary:' || chr(10) || '  Total sentences: ' || num_sentences || chr(10) || '  Successfully aligned: ' || aligned || ' (' || printf('%.1f', round(aligned * 100.0::DOUBLE / num_sentences, 1)) || '%)' || chr(10)
  || '  Failed to align: ' || unaligned || chr(10) || '  Warnings: ' || warnings || chr(10) || chr(10) || 'Alignment Methods:' || chr(10) || '  External: ' || external || chr(10) || '  Fuzzy matching: ' || fuzzy
  || coalesce(chr(10) || chr(10) || 'Issues:' || lines, '') AS summary FROM counts LEFT JOIN i ON i.doc_id = counts.doc_id""",
    "issue_lines": f"""WITH {DOCS}, {SPANS}, d AS (SELECT doc_id, idx, left(text, 120) AS text, status, score FROM spans WHERE status <> 'ok')
SELECT doc_id, idx, printf('[%d] %s (score: %.2f, method: %s) - %s', idx, status, score, 'fuzzy', left(text, 60) || CASE WHEN length(text) > 60 THEN '...' ELSE '' END) AS line FROM d""",
    "avg_quality": f"WITH {DOCS}, {SPANS} SELECT doc_id, round(avg(CASE WHEN status = 'ok' THEN 1.0::DOUBLE ELSE score END), 9) AS avg_score, count(start_ms) AS processed FROM spans GROUP BY doc_id",
    "manifest_offsets": f"""WITH {DOCS}, {SPANS}, {BLOCKS}
SELECT s.doc_id, s.idx, CASE WHEN s.start_ms IS NULL THEN 'not_aligned' END AS status, CAST(CASE s.status WHEN 'ok' THEN 1.0 ELSE s.score END AS DOUBLE) AS score,
  CASE s.status WHEN 'failed' THEN 'alignment failed' WHEN 'warning' THEN 'low score but acceptable' ELSE 'ok' END AS note,
  b.block_start AS first_start, b.block_start + b.clip_ms AS first_end,
  b.block_start + 2 * (b.clip_ms + 10000) AS third_start, b.block_start + 2 * (b.clip_ms + 10000) + b.clip_ms AS third_end,
  CASE WHEN b.num_repeats = 5 THEN b.block_start + 4 * (b.clip_ms + 10000) END AS fifth_start, CASE WHEN b.num_repeats = 5 THEN b.block_start + 4 * (b.clip_ms + 10000) + b.clip_ms END AS fifth_end,
  b.num_repeats, round(b.seconds, 3) AS original_duration_seconds
FROM spans s LEFT JOIN blocks b ON s.doc_id = b.doc_id AND s.idx = b.idx""",
    "manifest_rows": f"""WITH {DOCS}, {SPANS}, {BLOCKS},
r AS (
  SELECT s.doc_id, s.idx, s.text, s.start_ms, s.end_ms, CAST(CASE s.status WHEN 'ok' THEN 1.0 ELSE s.score END AS DOUBLE) AS score,
    CASE s.status WHEN 'failed' THEN 'alignment failed' WHEN 'warning' THEN 'low score but acceptable' ELSE 'ok' END AS note,
    b.block_start, b.block_end, b.clip_ms, b.num_repeats, round(b.seconds, 3) AS seconds
  FROM spans s LEFT JOIN blocks b ON s.doc_id = b.doc_id AND s.idx = b.idx)
SELECT doc_id, idx, '{{"idx":' || idx || ',"text":' || CAST(to_json(text) AS VARCHAR)
  || CASE WHEN start_ms IS NULL THEN ',"status":"not_aligned"' ELSE ',"source_span_ms":{{"start":' || start_ms || ',"end":' || end_ms || ',"pad_ms":100}}' END
  || ',"quality":{{"score":' || score || ',"note":"' || note || '"}}'
  || CASE WHEN block_end IS NULL THEN '' ELSE ',"output_offsets_ms":{{' || {_READS} || '"block_end":' || block_end || '}},"num_repeats":' || num_repeats || ',"original_duration_seconds":' || seconds END || '}}' AS entry
FROM r""",
    "compare_methods": f"""WITH {DOCS}, {SPANS}, {OTHER},
c AS (SELECT s.doc_id, s.idx, greatest(abs(s.start_ms - o.start_ms), abs(s.end_ms - o.end_ms)) AS d, s.start_ms AS a, o.start_ms AS b FROM spans s JOIN other o ON s.doc_id = o.doc_id AND s.idx = o.idx),
k AS (SELECT doc_id, idx, CASE WHEN a IS NULL AND b IS NULL THEN 'both_failed' WHEN b IS NULL THEN 'fuzzy_only' WHEN a IS NULL THEN 'external_only' WHEN d > 500 THEN 'timestamp_diff' END AS kind,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN d END AS diff_ms FROM c)
SELECT * FROM k WHERE kind IS NOT NULL""",
    "review_queue": f"""WITH {DOCS}, {SPANS} SELECT doc_id, idx, CASE status WHEN 'failed' THEN 'failed' WHEN 'warning' THEN 'warning' ELSE 'good' END AS badge,
  CAST(CASE status WHEN 'ok' THEN 1.0 ELSE score END AS DOUBLE) AS score, CAST(CASE status WHEN 'warning' THEN 1 ELSE 2 END AS INTEGER) AS priority FROM spans""",
    "time_format": f"""WITH {ENDS}, m AS (SELECT DISTINCT end_ms AS ms FROM line)
SELECT ms, lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS hours, {_MINUTES} AS minutes FROM m""",
    "time_parse": f"""WITH {ENDS}, m AS (SELECT DISTINCT end_ms AS ms FROM line), f AS (SELECT ms, {_MINUTES} AS t FROM m)
SELECT ms, CAST(trunc((CAST(split_part(t, ':', 1) AS INTEGER) * 60 + CAST(split_part(t, ':', 2) AS DOUBLE)) * 1000) AS BIGINT) AS parsed, ms * 1000 AS seconds FROM f""",
    "file_names": r"""SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'dictation_final' ELSE regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') END AS name FROM pages""",
    "transcript_explode": f"SELECT conv_id, turn, role, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos, unnest(t) AS token FROM (SELECT conv_id, turn, role, {tokens('text')} AS t FROM conversations)",
    "words_envelope": f"""WITH c AS (SELECT conv_id, CAST(sum(len({tokens('text')})) AS BIGINT) AS n_words FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'spec' ELSE 'service' END AS format, CASE WHEN conv_id % 2 = 0 THEN 'c' ELSE 't' END || conv_id AS audio_id, n_words, true AS valid FROM c WHERE n_words > 0""",
    "silence_blocks": f"WITH {DOCS}, {SPANS}, {BLOCKS} SELECT doc_id, idx, CAST(num_repeats * (clip_ms * 44100 // 1000 * 2) + (num_repeats - 1) * 882000 + 882000 AS BIGINT) AS n_bytes FROM blocks",
}
