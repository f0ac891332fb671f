"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

EMBEDDING_NEARDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON vec_id = least.a LEFT JOIN counts ON vec_id = counts.a
"""

QUALITY_RULES = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), repeats AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next_i
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(next_i - i, 8))) AS n FROM repeats GROUP BY doc_id
), m AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id
), v AS (
  SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS v1, 1000 * n_dup_lines // greatest(n_lines, 1) AS v2,
    1000 * word_chars // greatest(n_words, 1) AS v3, 1000 * n_repeat_words // greatest(n_words, 1) AS v4
  FROM m
), each AS (
  SELECT lang, source, unnest([1, 2, 3, 4]) AS k, unnest([v1, v2, v3, v4]) AS x FROM v
), bucketed AS (
  SELECT lang, source, k, CASE WHEN x < 1 THEN 0 ELSE 1 + ceil(round(ln(x::DOUBLE) / ln(1.02), 9)) END AS bucket FROM each
), levels AS (
  SELECT 1 AS level, lang, source, k, bucket FROM bucketed
  UNION ALL SELECT 2, lang, NULL, k, bucket FROM bucketed
  UNION ALL SELECT 3, NULL, NULL, k, bucket FROM bucketed
), sketches AS (
  SELECT level, lang, source, k, bucket, count(*) AS n FROM levels GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, k ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, k) AS whole
  FROM sketches
), quarters AS (
  SELECT level, lang, source, k, max(whole) AS rows,
    min(CASE WHEN 4 * upto >= whole THEN bucket END) AS b1, min(CASE WHEN 4 * upto >= 3 * whole THEN bucket END) AS b3
  FROM ranked GROUP BY ALL
), valued AS (
  SELECT *, CASE WHEN b1 = 0 THEN 0 ELSE pow(1.02, b1 - 1) * (2 / 2.02) END AS q1,
    CASE WHEN b3 = 0 THEN 0 ELSE pow(1.02, b3 - 1) * (2 / 2.02) END AS q3,
    CASE k WHEN 1 THEN 150 WHEN 2 THEN 350 WHEN 3 THEN 3000 ELSE 300 END AS least_gap
  FROM quarters
), fences AS (
  SELECT level, lang, source, k, rows, CASE WHEN k = 3 THEN q1 - greatest(3 * (q3 - q1), least_gap) ELSE -1 END AS low,
    q3 + greatest(3 * (q3 - q1), least_gap) AS high
  FROM valued
), fenced AS (
  SELECT v.doc_id, bool_or(x < chosen.low OR x > chosen.high) AS outside
  FROM (SELECT doc_id, lang, source, unnest([1, 2, 3, 4]) AS k, unnest([v1, v2, v3, v4]) AS x FROM v) v
  JOIN fences f1 ON f1.level = 1 AND f1.lang IS NOT DISTINCT FROM v.lang AND f1.source IS NOT DISTINCT FROM v.source AND f1.k = v.k
  JOIN fences f2 ON f2.level = 2 AND f2.lang IS NOT DISTINCT FROM v.lang AND f2.k = v.k
  JOIN fences f3 ON f3.level = 3 AND f3.k = v.k
  JOIN fences chosen ON chosen.k = v.k AND CASE
    WHEN f1.rows >= 200 THEN chosen.level = 1 AND chosen.lang IS NOT DISTINCT FROM v.lang AND chosen.source IS NOT DISTINCT FROM v.source
    WHEN f2.rows >= 200 THEN chosen.level = 2 AND chosen.lang IS NOT DISTINCT FROM v.lang
    ELSE chosen.level = 3 END
  GROUP BY v.doc_id
), based AS (
  SELECT v.*, outside, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM v JOIN fenced ON v.doc_id = fenced.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT outside AS kept
FROM based
"""

MIXING = """
WITH counts AS (
  SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY source
), whole AS (
  SELECT sum(n)::BIGINT AS all_n, sum(weight::DECIMAL(38, 9))::DOUBLE AS all_weight FROM counts
), rates AS (
  SELECT source, 1.0::DOUBLE * all_n * (weight / all_weight) / n AS rate FROM counts, whole
), terms AS (
  SELECT source, rate, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rates
), sums AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below FROM terms
), numbers AS (
  SELECT *, (('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5)
    / 281474976710656.0::DOUBLE AS u
  FROM documents
), drawn AS (
  SELECT doc_id, count(*) AS times
  FROM numbers JOIN sums ON numbers.source IS NOT DISTINCT FROM sums.source WHERE below < u GROUP BY doc_id
), copies AS (
  SELECT doc_id, unnest(range(0, times)) AS copy FROM drawn
)
SELECT d.doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
  md5('deal42|' || d.doc_id::VARCHAR || '|' || copy::VARCHAR) AS shuffle_key
FROM documents d JOIN copies ON d.doc_id = copies.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH w AS (
  SELECT doc_id, {WORDS} AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
), later AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), marked AS (
  SELECT words.doc_id, word, words.i,
    coalesce(max(later.i) OVER (PARTITION BY words.doc_id ORDER BY words.i) > words.i - 20, false) AS gone
  FROM words LEFT JOIN later ON words.doc_id = later.doc_id AND words.i = later.i
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

#: the table of the usual CRC-32 and its value for a list of bytes
CRC_TABLE = """crc_table AS (
  SELECT list(value ORDER BY byte) AS crcs FROM (
    SELECT byte, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, byte) AS value
    FROM range(256) bytes(byte))
)"""


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, where ``crcs`` of the table is at hand."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda k: ('0x' || substr(hex(encode({text})), k, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING_VARIANTS = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY doc_id, run
), marked AS (
  SELECT run, n, {crc32("doc_id::VARCHAR || ':' || run")} AS h FROM runs, crc_table
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
    FROM marked)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (
  SELECT word, n, unnest(range(0, length(word))) AS k FROM words
), cut AS (
  SELECT DISTINCT word, n, substr(word, 1, k) || substr(word, k + 2) AS less FROM places
), blanked AS (
  SELECT word, n, substr(word, 1, k) || '*' || substr(word, k + 2) AS pattern FROM places
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM blanked a JOIN blanked b ON a.pattern = b.pattern AND a.word <> b.word
  UNION ALL SELECT cut.word, cut.n, words.word, words.n FROM cut JOIN words ON cut.less = words.word
  UNION ALL SELECT words.word, words.n, cut.word, cut.n FROM cut JOIN words ON cut.less = words.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word
), formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * words.n THEN form END AS form,
    CASE WHEN form_n >= 2 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word
), chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL
  SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON chain.next = formed.word
)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN chain ON formed.word = chain.word AND chain.next IS NULL
"""


def _leaf(text: str) -> str:
    framed = " || ".join(
        f"coalesce(octet_length(encode({f}::VARCHAR)) || ':' || {f}::VARCHAR, '-')" for f in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({framed})"


def _levels(name: str, of: str) -> str:
    """All nodes of trees over rows (tree, i, digest) that start on level 0, and the siblings beside each."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, i, digest, count(*) OVER (PARTITION BY tree) AS n FROM {of}
  UNION ALL
  SELECT tree, level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8 FROM {name} WHERE n > 1
  GROUP BY tree, level, i // 8, n
), {name}_beside AS (
  SELECT tree, level, i,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name} WHERE n > 1
)"""


MERKLE_MANIFEST = f"""
WITH RECURSIVE {CRC_TABLE}, leaves AS (
  SELECT lang AS tree, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, {_leaf("text")} AS digest,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(LOWERED)} ELSE {_leaf("text")} END AS given
  FROM documents, crc_table
), {_levels("node", "leaves")}, subroots AS (
  SELECT 0 AS tree, tree AS lang, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, digest FROM node WHERE n = 1
), {_levels("top", "subroots")}, path AS (
  SELECT doc_id, level, before, after
  FROM leaves JOIN node_beside b ON leaves.tree IS NOT DISTINCT FROM b.tree AND leaves.i // (8 ** level)::BIGINT = b.i
  UNION ALL
  SELECT doc_id, 100 + level, before, after
  FROM leaves JOIN subroots ON leaves.tree IS NOT DISTINCT FROM subroots.lang
  JOIN top_beside b ON subroots.i // (8 ** level)::BIGINT = b.i
), proofs AS (
  SELECT doc_id, string_agg(before || after, '' ORDER BY level) AS proof, list(before || '|' || after ORDER BY level) AS steps
  FROM path GROUP BY doc_id
), folds AS (
  SELECT leaves.*, subroots.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(coalesce(steps, []), lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2)), given) AS folded_root
  FROM leaves JOIN subroots ON leaves.tree IS NOT DISTINCT FROM subroots.lang LEFT JOIN proofs ON leaves.doc_id = proofs.doc_id
)
SELECT doc_id, digest AS leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""

ORACLES: dict[str, str] = {
    "op1_embedding_neardup": EMBEDDING_NEARDUP,
    "op2_quality_rules": QUALITY_RULES,
    "op5_mixing": MIXING,
    "op7_substring_dedup": SUBSTRING_DEDUP,
    "op12_spelling_variants": SPELLING_VARIANTS,
    "op13_merkle_manifest": MERKLE_MANIFEST,
}
