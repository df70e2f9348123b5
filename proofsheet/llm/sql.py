"""DuckDB SQL for those corpus queries that SQL can express."""

WORDS = "CASE WHEN {0} IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all({0}, '[^ \\x09-\\x0D]+') END"

OP1 = f"""WITH w AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
 s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
 x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM s),
 r AS (SELECT doc_id, i FROM x WHERE k IN (SELECT k FROM x GROUP BY k HAVING count(*) > 1)),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
 g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
 SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
 sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p))), ' '), '') END) AS kept_sha256
 FROM w LEFT JOIN g USING (doc_id)"""

OP2 = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 s AS (SELECT doc_id, i, md5(substring(h, 2 * i - 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) / 2 AS BIGINT) - 48)) AS i FROM b WHERE length(h) >= 100)),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM s) WHERE least < doc_id),
 g AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
 e AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, run),
 c AS (SELECT doc_id, run, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 1) AS before FROM e),
 k AS (SELECT c.doc_id, string_agg(substring(h, 2 * before - 1, 2 * (a - before)), '' ORDER BY run) AS kept, max(z) AS last, sum(z - a) AS n, count(*) AS spans FROM c JOIN b USING (doc_id) GROUP BY c.doc_id)
 SELECT b.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE kept || substring(h, 2 * last - 1) END)) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)"""

OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
 l AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
 r AS (SELECT u AS node, u AS seen FROM l UNION SELECT node, v FROM r JOIN l ON seen = u),
 c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
 SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id"""

#: the character classes, each as what one of its signs matches
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", "[ \\x09-\\x0D]", "[#*$%&|<>]", "[.,;:''\"()?-]")
_COUNTS = ", ".join(f"length(t) - length(regexp_replace(t, '{c}', '', 'g')) AS k{i}" for i, c in enumerate(CLASSES))
_PART = "CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END"
_SHARES = ", ".join(f"k{i} / greatest(n_chars, 1) AS p{i}, a{i} / greatest(an, 1) AS q{i}" for i in range(len(CLASSES)))
_REST = ", ".join(f"greatest(1 - ({' + '.join(f'{x}{i}' for i in range(len(CLASSES)))}), 0) AS {x}r" for x in "pq")
_CHARS = " + ".join(_PART.format(p=f"p{i}", q=f"q{i}") for i in [*range(len(CLASSES)), "r"])

OP4 = f"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS.format("text")} AS w, {WORDS.format("lower(text)")} AS lw FROM documents),
 f AS (SELECT doc_id, lang, w, lw, CAST(length(t) AS BIGINT) AS n_chars, len(w) AS n_words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines, {_COUNTS} FROM t),
 x AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM f WHERE len(w) >= 3),
 y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM x),
 z AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM y WHERE n > 1) GROUP BY doc_id),
 said AS (SELECT doc_id, lang, unnest(lw) AS word FROM f),
 common AS (SELECT * FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS rank FROM said GROUP BY lang, word) WHERE rank <= 40),
 held AS (SELECT doc_id, s.lang, c.rank, c.n AS c, count(*) AS n FROM said s JOIN common c ON s.lang IS NOT DISTINCT FROM c.lang AND s.word = c.word GROUP BY ALL),
 ref AS (SELECT lang, sum(n_chars) AS an, sum(n_words) AS aw, {", ".join(f"sum(k{i}) AS a{i}" for i in range(len(CLASSES)))} FROM f GROUP BY lang),
 top AS (SELECT lang, sum(n) AS top FROM common GROUP BY lang),
 spoken AS (SELECT doc_id, sum({_PART.format(p="p", q="q")}) AS parts, sum(p) AS p, sum(q) AS q FROM (SELECT h.doc_id, h.n / greatest(f.n_words, 1) AS p, h.c / greatest(r.aw, 1) AS q FROM held h JOIN f USING (doc_id) JOIN ref r ON r.lang IS NOT DISTINCT FROM h.lang) GROUP BY doc_id),
 m AS (SELECT f.*, {_SHARES}, top / greatest(aw, 1) AS common_share, coalesce(parts, 0) AS parts, coalesce(s.p, 0) AS sp, coalesce(s.q, 0) AS sq FROM f JOIN ref r ON r.lang IS NOT DISTINCT FROM f.lang LEFT JOIN top ON top.lang IS NOT DISTINCT FROM f.lang LEFT JOIN spoken s ON s.doc_id = f.doc_id),
 d AS (SELECT *, {_REST}, greatest(coalesce(common_share, 0) - sq, 0) AS lacking, greatest(1 - sp, 0) AS wp, greatest(1 - coalesce(common_share, 0), 0) AS wq FROM m),
 e AS (SELECT *, sqrt(greatest(({_CHARS}) / 2, 0)) AS char_distance, sqrt(greatest((parts + CASE WHEN lacking > 0 THEN lacking ELSE 0 END + {_PART.format(p="wp", q="wq")}) / 2, 0)) AS word_distance FROM d),
 v AS (SELECT e.*, coalesce(n_repeat, 0) AS n_repeat, n_words < 50 OR 100 * coalesce(n_repeat, 0) > 50 * n_words AS base_failed FROM e LEFT JOIN z USING (doc_id))
 SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_chars - k3 AS BIGINT) AS word_chars, CAST(k4 AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words, base_failed,
 NOT base_failed AND NOT (n_chars >= 200 AND char_distance > 0.2 + 1.5 / sqrt(n_chars)) AND NOT (n_words >= 50 AND word_distance > 0.25 + 1.2 / sqrt(n_words)) AS kept FROM v"""

_BARE = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP6 = f"""WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
 u AS (SELECT DISTINCT doc_id, source, {_BARE.format("line")} AS line FROM (SELECT doc_id, source, unnest(lines) AS line FROM l)),
 h AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
 b AS (SELECT u.source, list(line) AS gone FROM (SELECT source, line, count(*) AS n FROM u WHERE line <> '' GROUP BY source, line) u JOIN h ON h.source IS NOT DISTINCT FROM u.source WHERE n >= 5 AND n > 0.1 * pages GROUP BY u.source),
 k AS (SELECT doc_id, l.source, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), {_BARE.format("x")})) AS kept FROM l LEFT JOIN b ON b.source IS NOT DISTINCT FROM l.source)
 SELECT doc_id, source, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
 CASE WHEN lines IS NULL THEN NULL WHEN len(kept) = 0 THEN sha256('') ELSE sha256(array_to_string(kept, chr(10))) END AS kept_sha256 FROM k"""

OP12 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, CAST(list_sum(list_transform(list_zip(a.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND (v.label <> a.label OR v.vec_id <> a.vec_id)),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
 WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
 WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

#: each control string as (pattern behind which, and pattern before which a backslash goes)
_CONTROLS = "(<)(/?s>)|(\\[)(/?(?:INST|SYS|ROLE)\\])"
_ESCAPED = "regexp_replace(replace({0}, chr(92), repeat(chr(92), 2)), '" + _CONTROLS + "', '\\1\\3' || repeat(chr(92), 2) || '\\2\\4', 'g')"

OP13 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 e AS (SELECT *, length({_ESCAPED.format("text")}) AS size, length({_ESCAPED.format("role")}) AS role_size FROM t)
 SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(size + CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 ELSE role_size + 23 END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op2_suffix_dedup": OP2,
    "op3_minhash_dedup": OP3,
    "op4_quality_rules": OP4,
    "op6_line_dedup": OP6,
    "op12_hard_negatives": OP12,
    "op13_chat_formatting": OP13,
}
