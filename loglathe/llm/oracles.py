"""DuckDB SQL that gives the rows of those operators that SQL can express.

``op4_sql`` and ``op7_sql`` take the name of the table to read, so the pipeline's SQL can chain
them.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op4_ctes(table: str) -> str:
    """CTEs up to ``verdicts``: every row of ``table`` with its measures and ``kept``."""
    measures = ("symbols", "lines", "repeats", "length")
    union = " UNION ALL ".join(f"SELECT g_lang, g_source, '{m}' AS m, {m} AS v FROM measured" for m in measures)
    picks = ", ".join(f"max(CASE WHEN m = '{m}' THEN {c} END) AS {m}_{c}" for m in measures for c in ("lo", "hi"))
    slack = {"symbols": 20, "lines": 130, "repeats": 70, "length": 120}

    def level(name: str, by: str) -> str:
        keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
        part = f"PARTITION BY {by}, m" if by else "PARTITION BY m"
        return f"""
{name}_run AS (SELECT {keys}m, (CASE WHEN b < 64 THEN b ELSE ((b % 32 + 33) << (b // 32 - 1)) - 1 END) AS top,
    sum(c) OVER ({part}) AS n, sum(c) OVER ({part} ORDER BY b) AS below
  FROM (SELECT {keys}m, b, sum(c) AS c FROM sketch GROUP BY {keys}m, b)),
{name}_q AS (SELECT {keys}m, max(n) AS n, min(CASE WHEN 100 * below >= 25 * n THEN top END) AS lo,
    min(CASE WHEN 100 * below >= 75 * n THEN top END) AS hi FROM {name}_run GROUP BY {keys}m),
{name} AS (SELECT {keys}max(n) AS n_docs, {picks} FROM {name}_q {group})"""

    def best(c: str) -> str:
        return f"(CASE WHEN o.n_docs >= 50 THEN o.{c} WHEN l.n_docs >= 50 THEN l.{c} ELSE e.{c} END)"

    def fence(m: str, sign: str) -> str:
        side = best(f"{m}_hi" if sign == "+" else f"{m}_lo")
        return f"{side} {sign} 3 * greatest({best(f'{m}_hi')} - {best(f'{m}_lo')}, {slack[m]})"

    return rf"""
given AS (SELECT row_number() OVER () AS rid, * FROM {table}),
split AS (SELECT rid, {WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM given),
grams AS (SELECT rid, i, ws[i:i+4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM split WHERE len(ws) >= 6)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY rid),
counted AS (SELECT s.rid, len(ws) AS n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines FROM split s LEFT JOIN covered USING (rid)),
measured AS (SELECT g.*, g.lang AS g_lang, g.source AS g_source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS lines,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats,
    CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS length FROM given g JOIN counted USING (rid)),
sketch AS (SELECT g_lang, g_source, m, CASE WHEN v < 64 THEN v ELSE 32 * (length(bin(v)) - 5) + (v >> (length(bin(v)) - 6)) - 32 END AS b, count(*) AS c
  FROM ({union}) GROUP BY ALL),
{level("own", "g_lang, g_source")},
{level("by_lang", "g_lang")},
{level("every", "")},
fences AS (SELECT o.g_lang AS t_lang, o.g_source AS t_source, {fence("symbols", "+")} AS max_symbols, {fence("lines", "+")} AS max_lines,
    {fence("repeats", "+")} AS max_repeats, {fence("length", "+")} AS max_length, {fence("length", "-")} AS min_length
  FROM own o JOIN by_lang l ON o.g_lang IS NOT DISTINCT FROM l.g_lang, every e),
verdicts AS (SELECT m.*, (NOT base_failed AND symbols <= max_symbols AND lines <= max_lines AND repeats <= max_repeats
    AND length BETWEEN min_length AND max_length) AS kept
  FROM measured m JOIN fences f ON m.g_lang IS NOT DISTINCT FROM f.t_lang AND m.g_source IS NOT DISTINCT FROM f.t_source)"""


def op4_sql(table: str = "documents") -> str:
    return f"WITH {op4_ctes(table)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdicts"


def op7_ctes(table: str) -> str:
    """CTEs up to ``mixed``: every row of ``table`` with size, target and words taken."""
    drawn = "md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), ''))"
    return f"""
mix_sizes AS (SELECT *, CAST(len({WORDS}) AS BIGINT) AS size,
    CAST('0x' || substr({drawn}, 1, 8) AS BIGINT) % 4096 AS slice, CAST('0x' || substr({drawn}, 9, 8) AS BIGINT) % 1000000 AS "offset" FROM {table}),
mix_slices AS (SELECT source, slice, CAST(sum(size) AS BIGINT) AS words FROM mix_sizes GROUP BY source, slice),
mix_sources AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM mix_slices GROUP BY source),
mix_weights AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap,
    CAST(sum(source_size) OVER () AS HUGEINT) AS total FROM mix_sources),
mix_ratio AS (SELECT *, CAST(sum(w) OVER () AS HUGEINT) AS all_w,
    total - coalesce(sum(cap) OVER o, 0) AS left_words, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS left_w FROM mix_weights
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mix_clamped AS (SELECT *, cap * left_w <= w * left_words AS clamped FROM mix_ratio),
mix_rest AS (SELECT *, total - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0) AS rest, sum(CASE WHEN NOT clamped THEN w END) OVER () AS rest_w FROM mix_clamped),
mix_target AS (SELECT source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(rest_w AS DOUBLE) END AS target FROM mix_rest),
mix_whole AS (SELECT *, target - whole * source_size AS more FROM
  (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM mix_target)),
mix_run AS (SELECT s.source, slice, words, more, CAST(sum(words) OVER (PARTITION BY s.source ORDER BY slice) AS BIGINT) - words AS before
  FROM mix_slices s JOIN mix_whole t ON s.source IS NOT DISTINCT FROM t.source),
mix_cut AS (SELECT source, slice AS cut, CASE WHEN words > 0 THEN least(1.0::DOUBLE, (more - before) / words) ELSE 0.0::DOUBLE END AS part FROM mix_run
  WHERE before <= more QUALIFY row_number() OVER (PARTITION BY source ORDER BY slice DESC) = 1),
mixed AS (SELECT d.*, t.source_size, t.target, t.whole, c.cut, c.part, t.whole * size + CASE WHEN slice < cut THEN size
    WHEN slice = cut THEN least(size, CAST(floor(size * part + "offset" / 1000000) AS BIGINT)) ELSE 0 END AS taken
  FROM mix_sizes d JOIN mix_whole t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN mix_cut c ON d.source IS NOT DISTINCT FROM c.source)"""


def op7_sql(table: str = "documents") -> str:
    return f"WITH {op7_ctes(table)} SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM mixed"


OP10_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM turns),
prefixes AS (SELECT conv_id, pos, turn, string_agg(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)), chr(3)) OVER (PARTITION BY conv_id ORDER BY pos) AS so_far,
    count(*) OVER (PARTITION BY conv_id) AS n FROM numbered),
fulls AS (SELECT min(conv_id) AS conv_id, pos AS n_turns, so_far, count(*) AS n_copies FROM prefixes WHERE pos = n GROUP BY pos, so_far),
maximal AS (SELECT * FROM fulls f WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos = f.n_turns AND p.n > p.pos AND p.so_far = f.so_far)),
rendered AS (SELECT conv_id, string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY pos) AS chat FROM numbered GROUP BY conv_id)
SELECT m.conv_id, CAST(n_turns AS BIGINT) AS n_turns, n_copies, CAST(length(chat) AS BIGINT) AS n_chars, sha256(chat) AS chat_sha256 FROM maximal m JOIN rendered r USING (conv_id)
"""


OP12_SQL = r"""
WITH pieces AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
grams AS (SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase, count(*) AS f FROM placed, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM grams WHERE k >= 2 AND f >= 10),
inside AS (SELECT lang, array_to_string(ws[j:j+1], ' ') AS phrase, max(a) AS best FROM cand, (SELECT unnest([1, 2]) AS j) WHERE k = 3 GROUP BY ALL),
stay AS (SELECT c.* FROM cand c LEFT JOIN inside i ON c.k = 2 AND c.lang = i.lang AND c.phrase = i.phrase WHERE i.best IS NULL OR 100 * i.best < 50 * c.a),
cuts AS (SELECT s.lang, s.phrase, s.a, cut, x.f AS l, y.f AS r, CAST(1000000 * CAST(s.a AS HUGEINT) * s.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM stay) s
  JOIN grams x ON x.lang = s.lang AND x.phrase = array_to_string(s.ws[1:cut], ' ') JOIN grams y ON y.lang = s.lang AND y.phrase = array_to_string(s.ws[cut+1:], ' ')),
least_cut AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least_cut) JOIN total USING (lang) WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH lines AS (SELECT rid, doc_id, text, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM
  (SELECT rid, doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM
    (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
held AS (SELECT key, max(coalesce(doc_id, 9223372036854775807)) AS last_id FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT (coalesce(doc_id, 9223372036854775807), text)) >= 5),
judged AS (SELECT l.*, h.key IS NOT NULL AND coalesce(doc_id, 9223372036854775807) < last_id AS gone FROM lines l LEFT JOIN held h USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY rid
"""
