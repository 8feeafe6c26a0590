"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from ledgerloom.llm import collocations, licences, line_rules, mixing, zone_maps
from ledgerloom.llm.common import WORD

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hex_digest: str) -> str:
    quads = [f"list_aggregate(list_transform([35,30,25,20,15,10,5,0], lambda b: substr('{_BASE32}', "
             f"(((('0x' || substr({hex_digest}, {1 + 10 * i}, 10))::BIGINT) >> b) & 31)::INTEGER + 1, 1)), 'string_agg', '')"
             for i in range(4)]
    return " || ".join(quads)


OP1 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_base32('h')} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified
FROM f
"""


def _op2() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in licences.known_sentences().items())

    def ids(text: str) -> str:
        return (f"list_filter(list_transform(str_split(regexp_replace({text}, '([.!?])[ \\t]+', E'\\\\1\\n', 'g'), "
                f"E'\\n'), lambda s: trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), lambda s: s <> '')")

    steps, previous = [], "r0"
    for i, (run, _) in enumerate(licences.RULES):
        wanted = " ".join(f"<{x}>" for x in run)
        steps.append(f"r{i + 1} AS (SELECT * EXCLUDE (run), contains(run, ' {wanted} ') AS hit{i}, CASE WHEN contains(run, ' {wanted} ') "
                     f"THEN replace(run, '{wanted}', '|') ELSE run END AS run FROM {previous})")
        previous = f"r{i + 1}"
    names = ", ".join(f"CASE WHEN hit{i} THEN '{name}' END" for i, (_, name) in enumerate(licences.RULES))
    distinct = f"list_filter([{names}], lambda x: x IS NOT NULL)"
    return f"""
WITH known AS (SELECT map(list(s), list(i)) AS m FROM (VALUES {known}) v(s, i)),
d AS (SELECT doc_id, {ids("coalesce(text, '')")} AS sentences,
             {ids("replace(regexp_replace(regexp_replace(coalesce(text, ''), '" + licences.GAP + "', chr(1), 'g'), '[ \\t\\r\\n]+', ' ', 'g'), chr(1), chr(10))")} AS unwrapped FROM documents),
i AS (SELECT doc_id, len(sentences) AS n_sentences,
             list_filter(list_transform(sentences, lambda s: m[s]), lambda x: x IS NOT NULL) AS by_line,
             list_filter(list_transform(unwrapped, lambda s: m[s]), lambda x: x IS NOT NULL) AS joined FROM d, known),
c AS (SELECT doc_id, n_sentences, CASE WHEN len(joined) > len(by_line) THEN joined ELSE by_line END AS ids FROM i),
r0 AS (SELECT *, ' ' || list_aggregate(list_transform(ids, lambda x: '<' || x || '>'), 'string_agg', ' ') || ' ' AS run
       FROM c),
{', '.join(steps)}
SELECT doc_id, n_sentences::BIGINT AS n_sentences, len(ids)::BIGINT AS n_known,
       coalesce(list_aggregate(list_filter({distinct}, lambda x, k: list_position({distinct}, x) = k), 'string_agg', ','), '')
           AS licences,
       coalesce(len(list_filter(str_split(run, ' '), lambda x: x LIKE '<%')), 0)::BIGINT AS unmatched
FROM {previous}
"""


OP4 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, [{', '.join(f'{float(x)}' for x in mixing.WEIGHTS)}][(i % {len(mixing.WEIGHTS)}) + 1] AS w,
             (source_size * {mixing.MAX_COPIES})::DOUBLE AS cap FROM o),
l AS (SELECT *, cap / w AS lim, (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS all_w FROM w),
r AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS share FROM l
      WINDOW b AS (ORDER BY lim, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN lim <= share THEN cap
             ELSE w * first_value(share) OVER (ORDER BY lim <= share, lim, i) END AS target FROM r),
m AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, {float(mixing.MAX_COPIES)}) ELSE 0 END AS e,
             (('0x' || substr(sha256('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, e - floor(e) AS f, CASE WHEN e > floor(e) THEN
             (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM m),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS ending,
             round(sum(f * size) OVER (PARTITION BY source), 6) AS want FROM q)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((floor(e) + CASE WHEN q IS NOT NULL AND want > ending - size
       AND (ending <= want OR ending - want < want - (ending - size)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
k AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM k) GROUP BY r),
l AS (SELECT r, host, t, line, len(regexp_extract_all(line, '{WORD}')) AS n,
             trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS key
      FROM (SELECT r, host, t, unnest(str_split(t, E'\\n')) AS line FROM d)),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE n > 0 GROUP BY r),
common AS (SELECT host, key FROM l WHERE n > 0 AND key <> '' GROUP BY host, key
           HAVING count(DISTINCT t) > {line_rules.LINE_DOCUMENTS}),
gone AS (SELECT r, sum(n) AS n_removed FROM l JOIN common USING (host, key) WHERE n > 0 GROUP BY r),
b AS (SELECT doc_id, len(ws) AS n_words, strlen(regexp_replace(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'), '.', 'x', 'gs'))
             AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
             coalesce(n_repeat, 0) AS n_repeat_words, coalesce(n_removed, 0) AS n_removed
      FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
v AS (SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
      FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       n_removed::BIGINT AS n_removed_words, NOT base_failed AND n_removed <= {line_rules.DEPLETED_SHARE} * n_words
       AND n_words - n_removed >= {line_rules.MIN_WORDS} AS kept
FROM v
"""

OP8 = f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reach JOIN sym ON a = other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12 = f"""
WITH d AS (SELECT coalesce(lang, '{collocations.NO_LANGUAGE}') AS lang,
                  translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS ws FROM d),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
      FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
            FROM p, range(1, {collocations.LONGEST + 1}) v(size) WHERE len(ws) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {collocations.LEAST_COUNT}),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT c.*, unnest(range(1, size)) AS k FROM c),
s AS (SELECT x.lang, x.phrase, a, k, l.f AS l, r.f AS r, ({collocations.SCORE_SCALE}::HUGEINT * a) // (l.f + r.f) AS score
      FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:k], ' ')
      JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, a
           FROM (SELECT lang, w, a, n, unnest(range(1, size - n + 2)) AS i FROM (SELECT c.*, unnest(range(2, size)) AS n FROM c))),
around AS (SELECT lang, phrase, max(a) AS around FROM inside GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
           FROM best b LEFT JOIN around USING (lang, phrase)
           WHERE around IS NULL OR 100 * around < {collocations.INSIDE_PERCENT} * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang)
WHERE rank <= {collocations.REPORTED}
"""


def _op13() -> str:
    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, list_sum(list_transform(list_zip(v, m),
            lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i})
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""

    def moved(i: int) -> str:
        return f"""s{i} AS (SELECT c, pos, sum(v[pos]) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, {zone_maps.DIM + 1}) p(pos)
            GROUP BY c, pos),
        c{i + 1} AS MATERIALIZED (SELECT c, coalesce(t.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c,
            list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS m FROM s{i} GROUP BY c) t USING (c))"""

    rounds = ", ".join(f"{assigned(i)}, {moved(i)}" for i in range(zone_maps.ROUNDS))
    last = zone_maps.ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: floor({zone_maps.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {zone_maps.DIM} AND len(list_filter(embedding, lambda x: isfinite(x))) = {zone_maps.DIM}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m
    FROM (SELECT v, sha256('{zone_maps.SEED}:' || vec_id) AS h FROM v ORDER BY h LIMIT {zone_maps.CENTROIDS})),
{rounds}, {assigned(last)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{last} JOIN v USING (r) JOIN c{last} USING (c)
"""


SQL = {"op1_warc_archive": OP1, "op2_licence_rules": _op2(), "op4_source_mix": OP4, "op6_line_rules": OP6,
       "op8_near_duplicates": OP8, "op12_collocations": OP12, "op13_centroid_clusters": _op13()}
