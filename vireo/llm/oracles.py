"""DuckDB SQL for the training-data queries that SQL can express: whole tables, plain definitions, no hashing."""

from __future__ import annotations

from vireo.llm import quality, substrings

_WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_sql(k: int, percent: int) -> str:
    """Shingle sets joined on their shingles; a class's least id spreads along links to larger ids."""
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct([{shingle} FOR i IN range(1, len(w) - {k - 2})])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS least FROM sets UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.least < l.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.least) AS component_id FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)"""


def _next(length: int, over: str = "PARTITION BY doc_id ORDER BY i") -> tuple[str, str]:
    """Steps that give each word the ``length`` words from it on as ``s``, by doubling; null where the text ends before."""
    steps, last, size = [], "places", 1
    sizes = [1]
    while size * 2 <= length:
        steps.append(f"d{size * 2} AS (SELECT *, s{size} || ' ' || lead(s{size}, {size}) OVER ({over}) AS s{size * 2} FROM {last})")
        size *= 2
        sizes.append(size)
        last = f"d{size}"
    parts, at = [], 0
    for s in reversed(sizes):
        if length - at >= s:
            parts.append(f"s{s}" if at == 0 else f"lead(s{s}, {at}) OVER ({over})")
            at += s
    steps.append(f"starts AS (SELECT doc_id, i, s1, {' || chr(32) || '.join(parts)} AS s FROM {last})")
    return ",\n".join(steps), "starts"


def substrings_sql(length: int) -> str:
    """Windows by start, those that a smaller document has, and the words under them."""
    steps, starts = _next(length)
    return f"""WITH words AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
places AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS s1 FROM words),
{steps},
judged AS (SELECT doc_id, i, s1, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS bad FROM {starts}),
under AS (SELECT doc_id, i, s1, max(CAST(bad AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS {length - 1} PRECEDING) = 1 AS gone FROM judged),
texts AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(s1, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM under GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(t.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM words w LEFT JOIN texts t ON t.doc_id = w.doc_id"""


def quality_sql(risk: float = quality.RISK, level: float = quality.LEVEL) -> str:
    """Measures by unnesting, the strictest certified bundle by summing binomial terms from 0."""
    width, rules = quality.WINDOW, quality.RULES
    steps, starts = _next(width)
    grid = ", ".join(f"({k + 1}, {', '.join(f'{g[k]!r}::DOUBLE' for _, g in rules.values())})" for k in range(quality.LEVELS))
    names = ", ".join(f"cut_{r}" for r in rules)
    over = " OR ".join(f"coalesce({m} > cut_{r}, false)" for r, (m, _) in rules.items())
    cut = lambda r: f"CASE WHEN o.stratum IS NOT NULL THEN o.cut_{r} ELSE p.cut_{r} END"
    failed = ", ".join(f"CASE WHEN {m} > {cut(r)} THEN '{r}' END" for r, (m, _) in rules.items())
    return f"""WITH words AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
places AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS s1 FROM words),
{steps},
judged AS (SELECT doc_id, i, s IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s) > 1 AS twice FROM {starts}),
under AS (SELECT doc_id, max(CAST(twice AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS {width - 1} PRECEDING) AS again FROM judged),
repeated AS (SELECT doc_id, sum(again) AS n FROM under GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM words w LEFT JOIN repeated r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
good AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
langs AS (SELECT lang, coalesce(lang, '*') AS stratum FROM good GROUP BY lang),
grid AS (SELECT * FROM (VALUES {grid}) AS g(level, {names})),
tests AS (SELECT stratum, level, sum(over) AS k, count(*) AS n FROM (SELECT lang, level, CAST({over} AS INT) AS over FROM good, grid) AS z JOIN langs ON z.lang IS NOT DISTINCT FROM langs.lang GROUP BY stratum, level),
certain AS (SELECT *, k < n * {risk!r}::DOUBLE AND list_sum([exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({risk!r}) + (n - i) * ln({1 - risk!r})) FOR i IN range(0, k::BIGINT + 1)])
  <= {level!r} / (SELECT count(DISTINCT stratum) FROM langs) AS sure FROM tests),
cuts AS (SELECT c.stratum, g.* FROM (SELECT stratum, max(level) FILTER (sure) AS best FROM certain GROUP BY stratum) AS c LEFT JOIN grid g ON g.level = c.best),
v AS (SELECT m.*, concat_ws(',', {failed}) AS failed_rules FROM b m LEFT JOIN cuts o ON o.stratum = m.lang AND o.stratum <> '*' LEFT JOIN cuts p ON p.stratum = '*')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v"""


ORACLES: dict[str, str] = {
    "op3_jaccard_join": jaccard_sql(3, 90),
    "op4_substring_dedup": substrings_sql(substrings.LENGTH),
    "op10_quality_rules": quality_sql(),
}
