"""SQL of the trained sentence splitter, from its published formulas."""

from __future__ import annotations


def likelihood(a: str, b: str, k: str, n: str) -> str:
    def term(k: str, m: str, p: str) -> str:
        return f"CASE WHEN ({k}) = 0 THEN 0 ELSE ({k}) * ln({p}) END + CASE WHEN ({m}) = ({k}) THEN 0 ELSE (({m}) - ({k})) * ln(1 - ({p})) END"

    def rest(p: str) -> str:
        return f"CASE WHEN {n} > {a} THEN {term(f'{b} - {k}', f'{n} - {a}', p)} ELSE 0 END"

    every, own, other = f"{b}::DOUBLE / {n}", f"{k}::DOUBLE / {a}", f"({b} - {k})::DOUBLE / ({n} - {a})"
    return f"-2.0 * ({term(k, a, every)} + {rest(every)} - ({term(k, a, own)}) - ({rest(other)}))"


TABLES = r"""docs AS (SELECT doc_id, text FROM documents),
raw AS (SELECT doc_id, string_split(trim(regexp_replace(replace(translate(coalesce(text, ''), '"''', ''), '...', ' ... '), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS t FROM docs),
wds AS (SELECT doc_id, pos, word, regexp_replace(regexp_replace(word, '^[(\[{“‘«„¿¡]+', ''), '[)\]}”’»,;:]+$', '') AS core FROM (SELECT doc_id, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos, unnest(t) AS word FROM raw WHERE t[1] <> '')),
brs AS (SELECT doc_id, pos, word, regexp_replace(core, '[.!?]+$', '') AS bare, CASE WHEN core LIKE '%...' THEN '' ELSE regexp_extract(core, '([.!?])$', 1) END AS mark FROM wds),
typ AS (
  SELECT doc_id, pos, word, mark, CASE WHEN regexp_matches(bare, '^[+-]?[.,]*\p{Nd}[\p{Nd}.,]*$') THEN '##number##' ELSE lower(bare) END AS type,
    regexp_matches(bare, '^\p{Lu}') AS capital, regexp_matches(bare, '^\p{Ll}') AS small FROM brs),
mw AS (SELECT *, lead(type) OVER o AS nxt, lead(capital) OVER o AS nxt_capital FROM typ WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
cnt AS (SELECT type, count(*) AS c, count(*) FILTER (mark = '.') AS d FROM mw GROUP BY type),
tot AS (SELECT sum(c)::DOUBLE AS n, sum(d)::DOUBLE AS p FROM cnt),
sc AS (SELECT type, c, d, length(type) - length(replace(type, '.', '')) AS inn, p / n AS q FROM cnt, tot WHERE d > 0 AND regexp_matches(type, '\p{L}') AND type <> '##number##'),
abb AS (
  SELECT type, -2.0 * (d * ln(q) + CASE WHEN c = d THEN 0 ELSE (c - d) * ln(1 - q) END - d * ln(0.99::DOUBLE) - (c - d) * ln(0.01::DOUBLE))
    * exp(-(length(type) - inn)::DOUBLE) * (inn + 1) * pow((length(type) - inn)::DOUBLE, -(c - d)::DOUBLE) AS score FROM sc),
sho AS (SELECT type, score FROM abb WHERE score >= 0.3),
brk AS (
  SELECT mw.*, mark IN ('!', '?') OR (mark = '.' AND s.type IS NULL AND NOT regexp_matches(mw.type, '^\p{L}$') AND mw.type <> '##number##') AS broken
  FROM mw LEFT JOIN sho s ON s.type = mw.type),
ttl AS (SELECT count(*) AS n, count(*) FILTER (broken AND nxt IS NOT NULL) AS breaks FROM brk),
aft AS (SELECT nxt AS type, count(*) AS k, any_value(c) AS c FROM brk JOIN (SELECT type AS t, c FROM cnt) ON t = nxt WHERE broken AND regexp_matches(nxt, '\p{L}') AND nxt <> '##number##' GROUP BY nxt),
sta AS (SELECT type, score FROM (SELECT type, @starter AS score FROM aft, ttl WHERE k * n > c * breaks) WHERE score >= 30),
prs AS (SELECT type, nxt, count(*) AS k FROM brk WHERE mark = '.' AND nxt IS NOT NULL GROUP BY type, nxt HAVING count(*) > 1),
pcs AS (
  SELECT prs.type, nxt, least(k, x.c, y.c) AS k, k AS kk, x.c AS c1, y.c AS c2 FROM prs JOIN cnt x ON x.type = prs.type JOIN cnt y ON y.type = nxt
  WHERE regexp_matches(nxt, '\p{L}') AND nxt <> '##number##' AND (regexp_matches(prs.type, '\p{L}') OR prs.type = '##number##') AND nxt NOT IN (SELECT type FROM sta)),
col AS (SELECT type, nxt, score FROM (SELECT type, nxt, @pair AS score FROM pcs, ttl WHERE kk * n > c1 * c2) WHERE score >= 7.88),
cas AS (
  SELECT type, bool_or(lower) AS lower, bool_or(inside) AS inside
  FROM (SELECT type, true AS lower, false AS inside FROM mw WHERE small UNION ALL SELECT nxt, false, true FROM mw WHERE mark = '' AND nxt_capital AND NOT word LIKE '%...') GROUP BY type)"""
TABLES = TABLES.replace("@starter", likelihood("breaks", "c", "k", "n")).replace("@pair", likelihood("c1", "c2", "k", "n"))

ORACLE_SQL = {
    "learned_splitter": f"""WITH {TABLES}
SELECT 'abbreviation' AS kind, type, CAST(NULL AS VARCHAR) AS next, round(score, 4) AS score FROM sho
UNION ALL SELECT 'collocation', type, nxt, round(score, 4) FROM col UNION ALL SELECT 'starter', type, NULL, round(score, 4) FROM sta""",
    "trained_sentences": f"WITH {TABLES},"
    + r"""
fct AS (
  SELECT m.*, a.type IS NOT NULL AS sh, l.type IS NOT NULL AS pr, s.type IS NOT NULL AS st, m.nxt_capital AND coalesce(c.lower, false) AND NOT coalesce(c.inside, false) AS begins, regexp_matches(m.type, '^\p{L}$') AS ini
  FROM mw m LEFT JOIN sho a ON a.type = m.type LEFT JOIN col l ON l.type = m.type AND l.nxt = m.nxt LEFT JOIN sta s ON s.type = m.nxt LEFT JOIN cas c ON c.type = m.nxt),
fin AS (
  SELECT doc_id, pos, word, CASE WHEN mark <> '.' OR nxt IS NULL THEN mark <> '' WHEN pr THEN false WHEN NOT (sh OR ini OR type = '##number##') THEN true
    WHEN ini AND NOT sh THEN begins ELSE begins OR (nxt_capital AND st) END AS ends FROM fct),
idd AS (SELECT doc_id, pos, word, CAST(1 + coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS idx FROM fin),
grp AS (SELECT doc_id, idx, string_agg(word, ' ' ORDER BY pos) AS s FROM idd GROUP BY doc_id, idx)
SELECT doc_id, idx, CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END AS sentence FROM grp""",
}
