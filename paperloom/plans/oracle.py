"""The queries of the catalog as plain SQL (DuckDB dialect) over the same tables.

Shared views are common table expressions; ``_sql`` puts the needed ones in front of
a query.  They are written for clarity, with pair joins and full outer joins where
the Spark side takes another way.
"""

from paperloom import constants as C

ORACLES: dict[str, str] = {}
VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, needs: str, body: str) -> None:
    VIEWS[name] = (needs.split(), body)


def _order(names: list[str], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _order(VIEWS[name][0], done)
            done.append(name)
    return done


def _sql(name: str, needs: str, body: str) -> None:
    views = _order(needs.split(), [])
    head = ",\n".join(f"{v} AS MATERIALIZED (\n{VIEWS[v][1].strip()}\n)" for v in views)
    ORACLES[name] = (f"WITH {head}\n" if head else "") + body.strip()


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- vectors ------------------------------------------------------------------------

_view("seg", "", """
SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS group_id, CAST(vec_id AS INTEGER) AS segment_index,
       CAST(embedding AS DOUBLE[]) AS embedding
FROM embeddings""")
_view("dseg", "seg", """
SELECT seg.*, coalesce(d.lang, 'none') AS lang, coalesce(d.source, 'none') AS source
FROM seg LEFT JOIN documents d ON d.doc_id = seg.doc_id""")
_view("proto_sum", "dseg", """
SELECT a.group_id, a.lang, a.doc_id,
       coalesce(round(sum(list_inner_product(a.embedding, b.embedding)), 9), 0.0) AS s
FROM dseg a LEFT JOIN dseg b ON a.group_id = b.group_id AND a.lang = b.lang AND a.doc_id <> b.doc_id
GROUP BY a.group_id, a.lang, a.doc_id""")
_view("proto", "proto_sum dseg", """
SELECT p.group_id, CAST(p.doc_id AS INTEGER) AS proto_index, p.lang, d.embedding
FROM (SELECT * FROM proto_sum QUALIFY row_number() OVER
        (PARTITION BY group_id, lang ORDER BY greatest(s, -1.0) DESC, doc_id) = 1) p
JOIN dseg d ON d.doc_id = p.doc_id""")
_view("buf", "seg", "SELECT * FROM seg WHERE doc_id IN (SELECT doc_id FROM labels)")
_view("grp", "seg", """
SELECT group_id, 'group-' || group_id AS group_name, count(*) AS doc_count FROM seg GROUP BY group_id""")
_view("q", "dseg", """
SELECT source || '/' || lang AS query_id, list(s / n ORDER BY i) AS embedding
FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY source, lang)) AS n
      FROM (SELECT source, lang, i, sum(x) AS s
            FROM (SELECT source, lang, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM dseg)
            GROUP BY source, lang, i))
GROUP BY source, lang""")


def _topk(table: str, index: str, floor: float, k: int = 20, queries: str = "q", tie: str = "") -> str:
    return f"""
SELECT query_id, group_id, CAST({index} AS BIGINT) AS hit_index, similarity, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, group_id, {tie}{index}) AS rank
      FROM (SELECT q.query_id, t.* EXCLUDE (embedding),
                   round(list_cosine_similarity(q.embedding, t.embedding), 6) AS similarity
            FROM {queries} q CROSS JOIN {table} t)
      WHERE similarity >= {floor})
WHERE rank <= {k}"""


_view("proto_hit", "q proto grp", _topk("proto", "proto_index", 0.4))
_view("buffer_hit", "q buf grp", _topk("buf", "segment_index", 0.4))
_view("segment_hit", "q seg grp", _topk("seg", "segment_index", 0.37))
_view("dq", "seg", "SELECT CAST(doc_id AS VARCHAR) AS query_id, embedding FROM seg")
_sql("document_proto_topk", "proto dq", _topk("proto", "proto_index", 0.4, queries="dq"))
for _name, _hit in [("proto_topk", "proto_hit"), ("buffer_topk", "buffer_hit"), ("segment_topk", "segment_hit")]:
    _sql(_name, _hit, f"SELECT * FROM {_hit}")


def _score(hit: str) -> str:
    return f"""
SELECT query_id, group_id, round(0.7 * max(similarity) + 0.3 * avg(similarity) + 1e-9, 6) AS similarity,
       max(similarity) AS max_similarity, count(*) AS hit_count,
       first(hit_index ORDER BY similarity DESC, hit_index) AS top_index
FROM {hit} GROUP BY query_id, group_id"""


def _merge(first: str, second: str) -> str:
    return f"""
SELECT query_id, group_id,
       CASE WHEN a.hit_count IS NULL THEN b.similarity WHEN b.hit_count IS NULL THEN a.similarity
            ELSE round(0.7 * greatest(a.max_similarity, b.max_similarity)
                 + 0.3 * (a.max_similarity * a.hit_count + b.max_similarity * b.hit_count)
                       / (a.hit_count + b.hit_count) + 1e-9, 6) END AS similarity,
       greatest(a.max_similarity, b.max_similarity) AS max_similarity,
       coalesce(a.hit_count, 0) + coalesce(b.hit_count, 0) AS hit_count,
       CASE WHEN a.hit_count IS NULL OR b.max_similarity > a.max_similarity THEN b.top_index
            ELSE a.top_index END AS top_index
FROM {first} a FULL OUTER JOIN {second} b USING (query_id, group_id)"""


for _kind in ("proto", "buffer", "segment"):
    _view(f"{_kind}_score", f"{_kind}_hit", _score(f"{_kind}_hit"))
_view("early", "proto_score buffer_score", _merge("proto_score", "buffer_score"))
_view("candidate", "early segment_score", _merge("early", "segment_score"))
_view("ranked", "candidate", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, group_id) AS r FROM candidate""")
_view("routed", "q ranked grp", """
SELECT q.query_id, q.embedding,
       CASE WHEN t.group_id IS NULL THEN 'CREATE_NEW_GROUP' WHEN t.similarity >= 0.7 THEN 'AUTO_ASSIGN'
            ELSE 'REVIEW_BY_AGENT' END AS route,
       coalesce(t.similarity, 0.0) AS top_similarity,
       CASE WHEN t.similarity >= 0.7 THEN t.group_id END AS existing_group_id,
       t.group_id AS top_group
FROM q LEFT JOIN (SELECT * FROM ranked WHERE r = 1) t USING (query_id)""")
_view("listed", "ranked grp", """
SELECT query_id, string_agg(r.group_id, ',' ORDER BY r) AS ids, count(*) AS n,
       string_agg('- ' || g.group_name || ' (id=' || r.group_id || ', similarity='
                  || printf('%.3f', r.similarity) || ')', chr(10) ORDER BY r) AS lines,
       first(g.group_name ORDER BY r) AS first_name, first(r.similarity ORDER BY r) AS first_similarity,
       list(r.group_id ORDER BY r) AS id_list
FROM ranked r JOIN grp g USING (group_id) WHERE r.r <= 4 GROUP BY query_id""")

for _kind, _table, _index, _floor in [
    ("dq_proto", "proto", "proto_index", 0.4), ("dq_buffer", "buf", "segment_index", 0.4), ("dq_segment", "seg", "segment_index", 0.37),
]:
    _view(f"{_kind}_hit", f"dq {_table} grp", _topk(_table, _index, _floor, queries="dq"))
    _view(f"{_kind}_score", f"{_kind}_hit", _score(f"{_kind}_hit"))
_view("dq_early", "dq_proto_score dq_buffer_score", _merge("dq_proto_score", "dq_buffer_score"))
_view("dq_candidate", "dq_early dq_segment_score", _merge("dq_early", "dq_segment_score"))
_view("dq_ranked", "dq_candidate", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, group_id) AS r FROM dq_candidate""")
_sql("document_routes", "dq dq_ranked", """
SELECT dq.query_id,
       CASE WHEN any_value(t.group_id) IS NULL THEN 'CREATE_NEW_GROUP' WHEN max(t.similarity) >= 0.7 THEN 'AUTO_ASSIGN'
            ELSE 'REVIEW_BY_AGENT' END AS route,
       coalesce(max(t.similarity), 0.0) AS top_similarity,
       CASE WHEN max(t.similarity) >= 0.7 THEN first(t.group_id ORDER BY t.r) END AS existing_group_id,
       coalesce(string_agg(t.group_id, ',' ORDER BY t.r), '') AS candidate_ids
FROM dq LEFT JOIN (SELECT * FROM dq_ranked WHERE r <= 4) t ON dq.query_id = t.query_id GROUP BY dq.query_id""")
_sql("group_multi_hit_score", "segment_score", "SELECT * FROM segment_score")
_sql("group_candidates_merged", "candidate", "SELECT * FROM candidate")
_sql("route_decision", "routed listed", """
SELECT query_id, route, top_similarity, existing_group_id, coalesce(ids, '') AS candidate_ids
FROM routed LEFT JOIN listed USING (query_id)""")
_sql("candidate_format", "routed listed", """
SELECT query_id, coalesce(lines, 'No candidate groups found.') AS lines,
       CAST(coalesce(n, 0) AS INTEGER) AS n_shown, first_name, round(first_similarity, 4) AS first_similarity
FROM routed LEFT JOIN listed USING (query_id)""")
_sql("review_vector_cache", "routed", """
SELECT query_id AS doc_id, route = 'REVIEW_BY_AGENT' AS cached,
       CASE WHEN route = 'REVIEW_BY_AGENT' THEN array_to_string(list_transform(embedding,
            lambda x: CAST(floor((x + 1e-9::DOUBLE) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)), ',') END AS vector
FROM routed""")
_sql("assigned_group_name", "routed listed grp", """
SELECT query_id,
       CASE WHEN list_contains(coalesce(id_list, []), wanted) THEN 'group-' || wanted ELSE wanted END AS group_name
FROM (SELECT query_id, id_list, coalesce(existing_group_id, split_part(query_id, '/', 1)) AS wanted
      FROM routed LEFT JOIN listed USING (query_id))""")
_sql("group_chunk_topk", "proto seg", """
SELECT query_id, group_id, doc_id, similarity, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, group_id, doc_id) AS rank
      FROM (SELECT p.group_id || '/' || p.lang AS query_id, s.group_id, s.doc_id,
                   round(list_cosine_similarity(p.embedding, s.embedding), 6) AS similarity
            FROM proto p JOIN seg s USING (group_id)))
WHERE rank <= 5""")

_sql("pruned_topk", "seg", """
SELECT query_id, doc_id, similarity, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank
      FROM (SELECT q.doc_id AS query_id, s.doc_id, round(list_cosine_similarity(q.embedding, s.embedding), 6) AS similarity
            FROM seg q CROSS JOIN seg s))
WHERE rank <= 10""")
_view("el", "seg", """
SELECT doc_id, group_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM seg""")
_view("total", "el", "SELECT group_id, list(s ORDER BY i) AS total FROM (SELECT group_id, i, sum(x) AS s FROM el GROUP BY group_id, i) GROUP BY group_id")
_sql("vector_similarity", "seg total", """
SELECT doc_id, round(list_inner_product(embedding, total) + 1e-9, 6) AS dot,
       round(list_inner_product(embedding[1:10], total[1:10]) + 1e-9, 6) AS dot_shorter,
       round(list_cosine_similarity(embedding, total) + 1e-9, 6) AS cosine
FROM seg JOIN total USING (group_id)""")
_sql("vector_norm_check", "seg", """
SELECT doc_id, CAST(len(embedding) AS INTEGER) AS dim,
       round(sqrt(list_inner_product(embedding, embedding)) + 1e-9, 6) AS norm,
       CASE WHEN len(embedding) <> 64 THEN 'Expected 64-dimensional embedding, got ' || len(embedding) || '.' END AS vector_error
FROM seg""")
_sql("l2_normalized", "el", """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) + 1e-9, 6) AS value
FROM el""")
_sql("group_mean_vector", "el", """
SELECT group_id, n, CAST(i - 1 AS INTEGER) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY group_id)) + 1e-9, 6) AS value
FROM (SELECT group_id, i, avg(x) AS m, count(*) AS n FROM el GROUP BY group_id, i)""")
_sql("weighted_pool", "dseg", """
SELECT source, lang, CAST(i - 1 AS INTEGER) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY source, lang)) + 1e-9, 6) AS value
FROM (SELECT source, lang, i, sum(x * w) / sum(w) AS m
      FROM (SELECT s.source, s.lang, greatest(d.n_chars, 1) AS w, unnest(s.embedding) AS x,
                   generate_subscripts(s.embedding, 1) AS i
            FROM dseg s LEFT JOIN documents d USING (doc_id))
      GROUP BY source, lang, i)""")
_sql("nearest_centroid", "seg proto", """
SELECT group_id, doc_id, CAST(proto_index AS INTEGER) AS cluster, round(greatest(sim, -1.0) + 1e-9, 6) AS similarity
FROM (SELECT s.group_id, s.doc_id, p.proto_index, list_inner_product(s.embedding, p.embedding) AS sim
      FROM seg s JOIN proto p USING (group_id))
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY greatest(sim, -1.0) DESC, proto_index) = 1""")
_view("medoid_sum", "seg", """
SELECT a.group_id, a.doc_id, coalesce(round(sum(list_inner_product(a.embedding, b.embedding)), 9), 0.0) AS s
FROM seg a LEFT JOIN seg b ON a.group_id = b.group_id AND a.doc_id <> b.doc_id
GROUP BY a.group_id, a.doc_id""")
_sql("group_medoid", "medoid_sum", """
SELECT group_id, doc_id, round(s + 1e-9, 6) AS score, count(*) OVER (PARTITION BY group_id) AS n_members
FROM medoid_sum
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY greatest(s, -1.0) DESC, doc_id) = 1""")


def _kmeans(prefix: str, k: str, rounds: int, table: str = "seg", member: str = "doc_id") -> str:
    """Views for ``rounds`` rounds over a table; returns the name of the last assignment."""
    _view(f"{prefix}_c0", table, f"""
SELECT group_id, CAST(r - 1 AS INTEGER) AS cluster, embedding
FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY md5(group_id || ':' || {member}), {member}) AS r,
             count(*) OVER (PARTITION BY group_id) AS n FROM {table})
WHERE r <= {k}""")

    def assign(at: int) -> str:
        _view(f"{prefix}_a{at}", f"{table} {prefix}_c{at}", f"""
SELECT s.group_id, s.{member}, s.embedding,
       first(c.cluster ORDER BY greatest(list_inner_product(s.embedding, c.embedding), -1.0) DESC, c.cluster) AS cluster
FROM {table} s JOIN {prefix}_c{at} c USING (group_id) GROUP BY s.group_id, s.{member}, s.embedding""")
        return f"{prefix}_a{at}"

    for at in range(rounds):
        members = assign(at)
        _view(f"{prefix}_c{at + 1}", f"{members} {prefix}_c{at}", f"""
SELECT group_id, cluster, coalesce(m.embedding, c.embedding) AS embedding
FROM {prefix}_c{at} c LEFT JOIN
     (SELECT group_id, cluster, list(s / n ORDER BY i) AS embedding
      FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY group_id, cluster)) AS n
            FROM (SELECT group_id, cluster, i, sum(x) AS s
                  FROM (SELECT group_id, cluster, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
                        FROM {members})
                  GROUP BY group_id, cluster, i))
      GROUP BY group_id, cluster) m USING (group_id, cluster)""")
    return assign(rounds)


_PROTO_K = "least(n, least(20, greatest(2, n // 20)))"
_SEGMENT_K = "least(n, least(5, greatest(2, n // 5)))"
_one = _kmeans("one", _PROTO_K, 1)
_sql("kmeans_one_step", _one, f"SELECT group_id, doc_id, cluster FROM {_one}")
_full = _kmeans("full", _PROTO_K, C.KMEANS_ITERATIONS)
_sql("kmeans_groups", _full, f"SELECT group_id, doc_id, cluster FROM {_full}")
_sql("kmeans_blocks", _full, f"SELECT group_id, doc_id, cluster FROM {_full}")
_sql("group_prototypes", _full, f"""
SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY cluster) - 1 AS INTEGER) AS proto_index, doc_id
FROM (SELECT a.group_id, a.cluster, a.doc_id,
             coalesce(round(sum(list_inner_product(a.embedding, b.embedding)), 9), 0.0) AS s
      FROM {_full} a LEFT JOIN {_full} b
        ON a.group_id = b.group_id AND a.cluster = b.cluster AND a.doc_id <> b.doc_id
      GROUP BY a.group_id, a.cluster, a.doc_id
      QUALIFY row_number() OVER (PARTITION BY a.group_id, a.cluster ORDER BY greatest(s, -1.0) DESC, a.doc_id) = 1)""")
_parts = _kmeans("part", _SEGMENT_K, C.KMEANS_ITERATIONS)
_sql("cluster_segments", _parts, f"""
SELECT group_id AS doc_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY cluster) - 1 AS INTEGER) AS segment_index,
       chunk_indices, array_to_string(list_transform(s,
            lambda x: CAST(floor((x / n + 1e-9::DOUBLE) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)), ',') AS vector
FROM (SELECT group_id, cluster, max(members) AS chunk_indices, list(s ORDER BY i) AS s, sqrt(sum(s * s)) AS n
      FROM (SELECT group_id, cluster, i, sum(x) AS s, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members
            FROM (SELECT group_id, cluster, doc_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM {_parts})
            GROUP BY group_id, cluster, i)
      GROUP BY group_id, cluster)""")
_sql("vector_scan", "", """
SELECT CAST(label AS INTEGER) AS group_id, vec_id, CAST(i - 1 AS INTEGER) AS pos, round(x + 1e-9, 6) AS value
FROM (SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i
      FROM embeddings)""")

# --- text --------------------------------------------------------------------------

_WORDS = r"regexp_extract_all({0}, '\S+')"


def _words(text: str) -> str:
    return _WORDS.format(text)


def _analysis(table: str, key: str, text: str) -> str:
    share = "len(list_filter(lines, lambda x: regexp_matches(x, '{0}')))"
    code = share.format(r"[;{}()<>]|def\s+|class\s+|function\s+|=>")
    bullets = share.format(r"^(?:[-*+]\s+|\d+[.)]\s+)")
    heads = share.format(r"^#+\s+")
    return f"""
SELECT *, CASE WHEN struct_type = 'short' OR len(lines) = 0 THEN NULL
               WHEN lines[1] LIKE '#%' THEN trim(ltrim(lines[1], '#'))
               WHEN lines[1] = upper(lines[1]) AND lines[1] <> lower(lines[1]) AND length(lines[1]) < 60 THEN lines[1]
               WHEN length(lines[1]) < 80 AND lines[1] LIKE '%:' THEN trim(rtrim(lines[1], ':'))
               WHEN len(sentence) > 0 THEN array_to_string(sentence[1:12], ' ') END AS title
FROM (SELECT *, CASE WHEN n_words < 150 THEN 'short'
                     WHEN contains(text, '```') OR (len(lines) > 0 AND {code} / len(lines) >= 0.3) THEN 'code'
                     WHEN len(lines) > 0 AND {bullets} / len(lines) >= 0.4 THEN 'list'
                     WHEN {heads} >= 2 THEN 'structured' ELSE 'prose' END AS struct_type
      FROM (SELECT {key}, text, CAST(len({_words('text')}) AS INTEGER) AS n_words,
                   list_filter(list_transform(string_split(text, chr(10)),
                               lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines,
                   {_words("split_part(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '.', 1)")} AS sentence
            FROM (SELECT {key}, {text} AS text FROM {table})))"""


_view("doc", "", _analysis("documents", "doc_id", "text"))
_view("chunk", "doc", f"""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(total AS INTEGER) AS total_chunks, chunk_text,
       CAST(len({_words('chunk_text')}) AS INTEGER) AS word_count
FROM (SELECT doc_id, total, unnest(range(total)) AS i,
             CASE WHEN struct_type = 'short' THEN source_text
                  ELSE array_to_string(words[i * (size - overlap) + 1 : i * (size - overlap) + size], ' ') END AS chunk_text
      FROM (SELECT *, CASE WHEN struct_type = 'short' THEN 1
                           ELSE greatest(1, CAST(ceil((len(words) - overlap) / (size - overlap)) AS BIGINT)) END AS total
            FROM (SELECT *, CASE struct_type WHEN 'code' THEN 384 WHEN 'list' THEN 256 ELSE 512 END AS size,
                         CASE struct_type WHEN 'code' THEN 48 WHEN 'list' THEN 32 ELSE 64 END AS overlap,
                         {_words('source_text')} AS words
                  FROM (SELECT doc_id, struct_type,
                               CASE WHEN title IS NULL OR title = '' THEN text
                                    ELSE title || chr(10) || chr(10) || text END AS source_text
                        FROM doc))))""")

_sql("word_stats", "doc", f"""
SELECT doc_id, n_words, CAST(greatest(1, ceil(n_words * 0.75)) AS INTEGER) AS n_tokens,
       CAST(len(lines) AS INTEGER) AS n_lines, array_to_string({_words('text')}, '|') AS words
FROM doc""")
_sql("struct_type", "doc", "SELECT doc_id, n_words, struct_type FROM doc")
_sql("title_extract", "doc", "SELECT doc_id, title FROM doc")
_sql("recursive_chunk_words", "doc", r"""
SELECT doc_id, ws[1] AS first_word, ws[-1] AS last_word, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct, TRUE AS all_fit
FROM (SELECT doc_id, regexp_extract_all(CASE WHEN coalesce(title, '') = '' THEN text ELSE title || ' ' || text END, '\S+') AS ws
      FROM doc)
WHERE len(ws) > 0""")
_sql("window_chunks", "chunk", "SELECT doc_id, chunk_index, chunk_text FROM chunk")
_sql("chunk_stats", "chunk", """
SELECT doc_id, chunk_index, total_chunks, word_count,
       CAST(greatest(1, ceil(word_count * 0.75)) AS INTEGER) AS token_count
FROM chunk""")
_view("planned", "chunk", """
SELECT *, CAST(CASE WHEN total_chunks <= 4 THEN 1 WHEN total_chunks <= 12 THEN 2 WHEN total_chunks <= 24 THEN 3
                    ELSE 5 END AS INTEGER) AS n_segments
FROM chunk""")
_view("placed", "planned", """
SELECT *, CASE WHEN total_chunks <= 24
               THEN CAST(chunk_index // CAST(ceil(total_chunks / n_segments) AS INTEGER) AS INTEGER) END AS segment_index
FROM planned""")
_sql("segment_plan", "placed", "SELECT doc_id, chunk_index, n_segments, segment_index FROM placed")


def _slug(text: str) -> str:
    text = rf"regexp_replace(lower({text}), '^\s+|\s+$', '', 'g')"
    text = rf"regexp_replace({text}, '[^\p{{L}}\p{{N}}_\s-]', '', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '[\s_]+', '-', 'g'), '-{{2,}}', '-', 'g')"
    return f"trim(substring({text}, 1, 60), '-')"


_sql("slugify", "", f"SELECT doc_id, {_slug('text')} AS slug FROM documents")
_sql("doc_path", "", f"""
SELECT doc_id, CASE WHEN quality = 0 THEN 'old/' || doc_id
                    ELSE 'docs/' || {_slug("source || ' ' || lang")} || '/'
                         || CASE WHEN quality = 1 THEN 'design' ELSE 'reference' END || '/' || source || '/'
                         || doc_id || CASE WHEN toxic = 1 THEN '.MD' ELSE '.md' END END AS doc_path
FROM documents LEFT JOIN labels USING (doc_id)""")
_sql("group_name_resolve", "doc", f"""
SELECT doc_id, {_slug("CASE WHEN quality = 1 THEN 'Team ' || source WHEN title IS NULL OR title = '' THEN CAST(doc_id AS VARCHAR) ELSE title END")} AS group_name,
       'Document group for ' || coalesce(title, 'unknown project') || '.' AS description
FROM doc JOIN (SELECT doc_id, source FROM documents) USING (doc_id) LEFT JOIN labels USING (doc_id)""")

# --- hashed term vectors -------------------------------------------------------------


def _term_vectors(table: str, keys: str, text: str, dim: int = 128) -> str:
    """Dense unit vectors of texts; a text without terms has no row."""
    return f"""
SELECT {keys}, list(coalesce(n, 0) / length ORDER BY b) AS embedding
FROM (SELECT DISTINCT {keys}, sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS length
      FROM (SELECT {keys}, b, count(*) AS n FROM (
              SELECT {keys}, CAST('0x' || left(md5(t), 8) AS BIGINT) % {dim} AS b
              FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {table}))
            GROUP BY {keys}, b)) l
CROSS JOIN (SELECT unnest(range({dim})) AS b) d
LEFT JOIN (SELECT {keys}, b, count(*) AS n FROM (
              SELECT {keys}, CAST('0x' || left(md5(t), 8) AS BIGINT) % {dim} AS b
              FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {table}))
           GROUP BY {keys}, b) c USING ({keys}, b)
GROUP BY {keys}"""


_view("doc_vec", "", _term_vectors("documents", "doc_id", "text"))
_view("ask", "", _term_vectors("benchmark", "item_id", "text"))
_view("chunk_vec", "chunk", _term_vectors("chunk", "doc_id, chunk_index", "'search_document: ' || chunk_text"))
_sql("embed_terms", "doc_vec", """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, round(x + 1e-9, 6) AS value
FROM (SELECT doc_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM doc_vec)""")
_view("stored", "placed chunk_vec", """
SELECT p.*, v.embedding, d.source AS group_id, d.lang,
       'docs/' || d.source || '/reference/' || d.lang || '/' || doc_id || '.md' AS doc_path
FROM placed p JOIN chunk_vec v USING (doc_id, chunk_index) JOIN documents d USING (doc_id)""")
_view("tseg_sum", "stored", """
SELECT doc_id, segment_index, group_id, lang, i, sum(x * w) AS s
FROM (SELECT doc_id, segment_index, group_id, lang, greatest(word_count, 1) AS w, unnest(embedding) AS x,
             generate_subscripts(embedding, 1) AS i FROM stored)
GROUP BY doc_id, segment_index, group_id, lang, i""")
_view("tseg", "tseg_sum", """
SELECT doc_id, segment_index, group_id, lang, doc_id || ':' || segment_index AS segment_id, list(s / n ORDER BY i) AS embedding
FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY doc_id, segment_index)) AS n FROM tseg_sum)
GROUP BY doc_id, segment_index, group_id, lang""")
_sql("segment_split", "tseg stored", """
SELECT doc_id, segment_index, chunk_indices, CAST(i - 1 AS INTEGER) AS pos, round(x + 1e-9, 6) AS value
FROM (SELECT doc_id, segment_index, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM tseg)
JOIN (SELECT doc_id, segment_index, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) AS chunk_indices
      FROM stored GROUP BY doc_id, segment_index) USING (doc_id, segment_index)""")
_sql("document_sizes", "chunk tseg", """
SELECT doc_id, c.n AS n_chunks, coalesce(s.n, 0) AS n_segments
FROM (SELECT doc_id, count(*) AS n FROM chunk GROUP BY doc_id) c
LEFT JOIN (SELECT doc_id, count(*) AS n FROM tseg GROUP BY doc_id) s USING (doc_id)""")
_view("tproto", "tseg", """
SELECT group_id, lang, doc_id, segment_index, embedding,
       row_number() OVER (PARTITION BY group_id ORDER BY lang) - 1 AS proto_index
FROM (SELECT * FROM (SELECT a.group_id, a.lang, a.doc_id, a.segment_index, a.segment_id, a.embedding,
             coalesce(round(sum(list_inner_product(a.embedding, b.embedding)), 9), 0.0) AS s
      FROM tseg a LEFT JOIN tseg b
        ON a.group_id = b.group_id AND a.lang = b.lang AND a.segment_id <> b.segment_id
      GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY group_id, lang ORDER BY greatest(s, -1.0) DESC, segment_id) = 1)""")
_view("tier1", "tproto tseg ask", """
SELECT query_id, group_id, similarity, rank, max(similarity) OVER (PARTITION BY query_id) >= 0.55 AS near
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, group_id) AS rank
      FROM (SELECT item_id AS query_id, t.group_id,
                   max(round(list_cosine_similarity(a.embedding, t.embedding), 6)) AS similarity
            FROM ask a CROSS JOIN (SELECT group_id, embedding FROM tproto UNION ALL
                                   SELECT group_id, embedding FROM tseg WHERE doc_id IN (SELECT doc_id FROM labels)) t
            GROUP BY item_id, t.group_id))""")
_view("short", "tier1", """
SELECT query_id, group_id, similarity, rank FROM tier1
WHERE CASE WHEN near THEN similarity >= 0.55 AND rank <= 5 ELSE rank <= 2 END""")
_sql("group_shortlist", "short", "SELECT query_id, group_id, similarity, CAST(rank AS INTEGER) AS rank FROM short")
_sql("global_chunk_topk", "ask chunk_vec", """
SELECT query_id, doc_id, chunk_index, similarity, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id, chunk_index) AS rank
      FROM (SELECT item_id AS query_id, doc_id, chunk_index,
                   round(list_cosine_similarity(a.embedding, c.embedding), 6) AS similarity
            FROM ask a CROSS JOIN chunk_vec c))
WHERE rank <= 40""")
_sql("scoped_chunk_topk", "stored", """
SELECT query_id, doc_id, chunk_index, similarity, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id, chunk_index) AS rank
      FROM (SELECT a.doc_id || '/' || a.chunk_index AS query_id, c.doc_id, c.chunk_index,
                   round(list_cosine_similarity(a.embedding, c.embedding), 6) AS similarity
            FROM stored a JOIN stored c USING (group_id)))
WHERE rank <= 5""")
_view("fetched", "ask stored short", """
SELECT query_id, doc_id, chunk_index, group_id, doc_path, chunk_text, vector_similarity, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_similarity DESC, doc_id, chunk_index) AS rank
      FROM (SELECT a.item_id AS query_id, c.doc_id, c.chunk_index, c.group_id, c.doc_path, c.chunk_text,
                   round(list_cosine_similarity(a.embedding, c.embedding), 6) AS vector_similarity
            FROM ask a JOIN short s ON s.query_id = a.item_id JOIN stored c ON c.group_id = s.group_id))
WHERE rank <= 40""")
_view("reranked", "fetched", r"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_rank
FROM (SELECT f.*, round(1.0 / (1.0 + exp(-(8.0 * len(list_intersect(asked, terms)) / len(asked) - 4.0))), 6) AS rerank_score
      FROM (SELECT *, list_distinct(regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}]+')) AS terms FROM fetched) f
      JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS asked FROM benchmark) b
        ON b.item_id = f.query_id)""")
_view("final", "reranked", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_rank) AS final_rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_path ORDER BY rerank_rank) AS p FROM reranked)
WHERE p <= 2 QUALIFY final_rank <= 7""")
_view("block", "final", """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS source_index, doc_path, group_id, text,
       best_similarity, n_chunks
FROM (SELECT query_id, doc_path, min(final_rank) AS first_rank, any_value(group_id) AS group_id,
             string_agg(chunk_text, chr(10) || chr(10) ORDER BY chunk_index) AS text,
             max(rerank_score) AS best_similarity, count(*) AS n_chunks
      FROM final GROUP BY query_id, doc_path)
QUALIFY source_index <= 5""")
_view("rated", "short final", """
SELECT *, CASE WHEN n_chunks = 0 THEN 15
               WHEN band = 'HIGH' THEN 90 - CASE WHEN tier_drop_flag THEN 15 ELSE 0 END
               WHEN band = 'MEDIUM' THEN 70 - CASE WHEN tier_drop_flag THEN 15 ELSE 0 END ELSE 30 END AS score,
       CASE WHEN n_chunks = 0 THEN 'No relevant chunks found.'
            WHEN band = 'HIGH' THEN 'Strong prototype match, ' || source_diversity || ' corroborating sources'
            WHEN band = 'MEDIUM' THEN 'Moderate matches found, relevance may vary'
            WHEN top_prototype_sim <= 0.55 THEN 'Weak prototype match — query may not align with any group topic'
            ELSE 'Weak evidence returned at the chunk level' END AS reason
FROM (SELECT *, round(top_prototype_sim - top_chunk_vec_sim, 6) > 0.20 AS tier_drop_flag,
             CASE WHEN n_chunks = 0 THEN 'LOW'
                  WHEN top_prototype_sim > 0.72 AND top_chunk_rerank > 0.80 AND source_diversity >= 2 THEN 'HIGH'
                  WHEN top_prototype_sim > 0.55 AND top_chunk_rerank > 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS band
      FROM (SELECT b.item_id AS query_id, coalesce(t.top_prototype_sim, 0.0) AS top_prototype_sim,
                   coalesce(f.n_chunks, 0) AS n_chunks, coalesce(f.top_chunk_rerank, 0.0) AS top_chunk_rerank,
                   coalesce(f.top_chunk_vec_sim, 0.0) AS top_chunk_vec_sim, coalesce(f.source_diversity, 0) AS source_diversity
            FROM benchmark b
            LEFT JOIN (SELECT query_id, max(similarity) AS top_prototype_sim FROM short GROUP BY query_id) t ON t.query_id = b.item_id
            LEFT JOIN (SELECT query_id, count(*) AS n_chunks, max(rerank_score) AS top_chunk_rerank,
                              max(vector_similarity) AS top_chunk_vec_sim, count(DISTINCT doc_path) AS source_diversity
                       FROM final GROUP BY query_id) f ON f.query_id = b.item_id))""")
_sql("shortlist_chunks", "fetched", """
SELECT query_id, doc_id, chunk_index, group_id, doc_path, vector_similarity, CAST(rank AS INTEGER) AS rank FROM fetched""")
_sql("rerank_sigmoid", "reranked", """
SELECT query_id, doc_id, chunk_index, rerank_score, CAST(rerank_rank AS INTEGER) AS rerank_rank FROM reranked""")
_sql("per_doc_cap", "final", """
SELECT query_id, doc_id, chunk_index, doc_path, CAST(final_rank AS INTEGER) AS final_rank FROM final""")
_sql("source_blocks", "block", """
SELECT query_id, CAST(source_index AS INTEGER) AS source_index, doc_path, group_id, text, best_similarity,
       CAST(n_chunks AS INTEGER) AS n_chunks FROM block""")
_sql("retrieval_confidence", "rated", """
SELECT query_id, top_prototype_sim, n_chunks, top_chunk_rerank, top_chunk_vec_sim, source_diversity, tier_drop_flag,
       band, CAST(score AS INTEGER) AS score, reason FROM rated""")
_sql("context_string", "rated block", """
SELECT r.query_id, '**Retrieval Confidence: ' || band || ' (' || score || '%)** — ' || reason || chr(10) || chr(10)
       || coalesce(body, '') || chr(10) || chr(10) || 'Sources:' || chr(10) || coalesce(lines, '') AS context
FROM rated r LEFT JOIN (
  SELECT query_id,
         string_agg('[Source ' || source_index || '] ' || doc_path || chr(10) || text, chr(10) || chr(10) ORDER BY source_index) AS body,
         string_agg('[' || source_index || '] ' || doc_path, chr(10) ORDER BY source_index) AS lines
  FROM block GROUP BY query_id) b USING (query_id)""")
_sql("retrieve", "rated block short fetched", """
SELECT r.query_id, q.text AS query, CAST(coalesce(b.n, 0) AS INTEGER) AS n_blocks, b.citations, r.band,
       CAST(r.score AS INTEGER) AS score, CAST(s.n AS INTEGER) AS n_groups,
       coalesce(f.n, 0) AS chunks_retrieved, r.n_chunks AS chunks_returned
FROM rated r JOIN benchmark q ON q.item_id = r.query_id
LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(source_index || '=' || doc_path, ';' ORDER BY source_index) AS citations
           FROM block GROUP BY query_id) b ON b.query_id = r.query_id
LEFT JOIN (SELECT query_id, count(*) AS n FROM short GROUP BY query_id) s ON s.query_id = r.query_id
LEFT JOIN (SELECT query_id, count(*) AS n FROM fetched GROUP BY query_id) f ON f.query_id = r.query_id""")
_sql("source_rows", "block", """
SELECT query_id, CAST(source_index AS INTEGER) AS source_index, doc_path,
       'https://docs.example.org/main/' || doc_path AS url, text AS chunk_text, best_similarity AS similarity,
       string_split(doc_path, '/')[-1] AS title
FROM block""")

_view("answer", "", r"""
SELECT conv_id, turn, array_to_string(list_transform(string_split(text, '. '), lambda s, i: s || ' [' || i || ']'), '. ') AS answer
FROM conversations""")
_view("mark", "answer", r"""
SELECT conv_id, turn, answer, list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: CAST(x AS BIGINT)) AS numbers,
       string_split_regex(answer, '\[\d+\]') AS parts
FROM answer""")
_view("kept", "mark", """
SELECT *, list_filter(range(1, turn + 1), lambda n: list_contains(numbers, n)) AS kept FROM mark""")
_sql("citation_map", "kept", """
SELECT conv_id, turn, CAST(len(list_distinct(numbers)) AS INTEGER) AS n_cited,
       array_to_string(list_transform(kept, lambda n, i: n || '>' || i), ',') AS renumbered,
       array_to_string(list_transform(parts, lambda p, i: p || CASE WHEN i > len(numbers) THEN ''
           WHEN list_contains(kept, numbers[i]) THEN '[' || list_position(kept, numbers[i]) || ']'
           ELSE CAST(numbers[i] AS VARCHAR) END), '') AS answer
FROM kept""")

_view("reply", "block", r"""
SELECT query_id, string_split_regex(answer, '\[\d+\]') AS parts, known, list_filter(numbers, lambda n: list_contains(known, n)) AS kept,
       numbers
FROM (SELECT item_id AS query_id, a.answer, coalesce(known, []) AS known,
             list_transform(regexp_extract_all(a.answer, '\[(\d+)\]', 1), lambda x: CAST(x AS BIGINT)) AS numbers
      FROM (SELECT item_id, array_to_string(list_transform(string_split(text, '. '), lambda s, i: s || ' [' || i || ']'), '. ') AS answer
            FROM benchmark) a
      LEFT JOIN (SELECT query_id, list(source_index ORDER BY source_index) AS known FROM block GROUP BY query_id) k
        ON k.query_id = a.item_id)""")
_sql("search_response", "reply rated block", """
SELECT r.query_id,
       array_to_string(list_transform(parts, lambda p, i: p || CASE WHEN i > len(numbers) THEN ''
           WHEN list_contains(kept, numbers[i]) THEN '[' || list_position(kept, numbers[i]) || ']'
           ELSE CAST(numbers[i] AS VARCHAR) END), '') AS answer,
       CAST(c.score AS DOUBLE) AS confidence_score, CAST(len(kept) AS INTEGER) AS n_sources, coalesce(s.sources, '') AS sources
FROM reply r JOIN rated c USING (query_id)
LEFT JOIN (SELECT query_id, string_agg(list_position(kept, source_index) || '=' || string_split(doc_path, '/')[-1], ';'
                                       ORDER BY source_index) AS sources
           FROM block JOIN reply USING (query_id) WHERE list_contains(kept, source_index) GROUP BY query_id) s USING (query_id)""")

# --- stored tables --------------------------------------------------------------------

_view("old_doc", "", """
SELECT 'doc-' || doc_id AS doc_id, source AS group_id, source || '/' || doc_id AS doc_path, text AS content FROM documents""")
_view("new_doc", "", """
SELECT 'doc-' || doc_id AS doc_id, source || '-q' || quality AS group_id,
       source || '/' || quality || '/' || doc_id AS doc_path, lower(text) AS content
FROM documents JOIN labels USING (doc_id)
UNION ALL
SELECT 'page-' || page_id, regexp_extract(html, 'lang="([^"]*)"', 1), url, html FROM pages""")


def _lines(table: str) -> str:
    return f"""
SELECT doc_id, group_id, CAST(i - 1 AS INTEGER) AS chunk_index, chunk_text
FROM (SELECT doc_id, group_id, unnest(string_split(content, chr(10))) AS chunk_text,
             generate_subscripts(string_split(content, chr(10)), 1) AS i FROM {table})"""


_view("old_line", "old_doc", _lines("old_doc"))
_view("new_line", "new_doc", _lines("new_doc"))
_sql("replace_by_document", "old_line new_line new_doc", """
SELECT * FROM old_line WHERE doc_id NOT IN (SELECT doc_id FROM new_doc) UNION ALL SELECT * FROM new_line""")
_sql("upsert_documents", "old_doc new_doc", """
SELECT * FROM old_doc WHERE doc_id NOT IN (SELECT doc_id FROM new_doc) UNION ALL SELECT * FROM new_doc""")
_sql("upsert_latest", "", """
SELECT user_id, event_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
_sql("insert_if_absent", "new_doc", """
WITH old_group AS (SELECT lang AS group_id, count(*) AS n, 'old-' || lang AS group_name FROM documents GROUP BY lang)
SELECT * FROM old_group UNION ALL
SELECT group_id, count(*) AS n, 'new-' || group_id FROM new_doc
WHERE group_id NOT IN (SELECT group_id FROM old_group) GROUP BY group_id""")
ORACLES["insert_if_absent"] = ORACLES["insert_if_absent"].replace("\nWITH old_group", ",\nold_group")
_sql("append_chunks", "old_line new_line", """
SELECT doc_id, group_id, count(*) AS n FROM (SELECT * FROM old_line UNION ALL SELECT * FROM new_line) GROUP BY doc_id, group_id""")
_view("change", "", """
SELECT 'doc-' || doc_id AS doc_id, CASE WHEN quality = 1 THEN 'good' END AS group_id,
       CASE WHEN toxic = 1 THEN 'hidden' END AS doc_path FROM labels""")
_sql("cascade_regroup", "old_line change", """
SELECT doc_id, coalesce(c.group_id, l.group_id) AS group_id, chunk_index FROM old_line l LEFT JOIN change c USING (doc_id)""")
_sql("document_update", "old_doc change", """
SELECT doc_id, coalesce(c.group_id, o.group_id) AS group_id, coalesce(c.doc_path, o.doc_path) AS doc_path
FROM old_doc o LEFT JOIN change c USING (doc_id)""")
_sql("cascade_delete", "old_doc old_line change", """
SELECT doc_id, group_id, n_chunks FROM old_doc
LEFT JOIN (SELECT doc_id, count(*) AS n_chunks FROM old_line GROUP BY doc_id) USING (doc_id)
WHERE doc_id NOT IN (SELECT doc_id FROM change)""")
_sql("buffer_refresh", "dseg buf", """
SELECT group_id, doc_id, segment_index FROM buf WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL
SELECT source, doc_id, segment_index FROM dseg WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
_sql("buffered_distinct_docs", "buf", "SELECT group_id, count(DISTINCT doc_id) AS n_buffered FROM buf GROUP BY group_id")
_view("all_grp", "grp dseg", "SELECT group_id FROM grp UNION ALL SELECT DISTINCT source FROM dseg")
_view("all_seg", "seg dseg", """
SELECT group_id, doc_id, embedding FROM seg UNION ALL SELECT source, doc_id, embedding FROM dseg""")
_sql("doc_count_refresh", "all_grp seg", """
SELECT group_id, (SELECT count(*) FROM seg s WHERE s.group_id = g.group_id) AS doc_count FROM all_grp g""")
_sql("proto_count_update", "grp proto", """
SELECT group_id, (SELECT count(*) FROM proto p WHERE p.group_id = g.group_id) AS proto_count FROM grp g""")
_view("policy", "all_grp buf proto all_seg", """
SELECT *, (n_buffered >= 20 OR NOT has_prototypes) AND has_segments AS needs_recompute
FROM (SELECT group_id, (SELECT count(DISTINCT doc_id) FROM buf b WHERE b.group_id = g.group_id) AS n_buffered,
             group_id IN (SELECT group_id FROM proto) AS has_prototypes,
             group_id IN (SELECT group_id FROM all_seg) AS has_segments
      FROM all_grp g)""")
_view("all_medoid_sum", "all_seg", """
SELECT a.group_id, a.doc_id, coalesce(round(sum(list_inner_product(a.embedding, b.embedding)), 9), 0.0) AS s
FROM all_seg a LEFT JOIN all_seg b ON a.group_id = b.group_id AND a.doc_id <> b.doc_id GROUP BY a.group_id, a.doc_id""")
_sql("recompute_policy", "policy", "SELECT * FROM policy")
_sql("prototype_replace", "policy proto all_medoid_sum", """
SELECT group_id, proto_index FROM proto WHERE group_id NOT IN (SELECT group_id FROM policy WHERE needs_recompute)
UNION ALL
SELECT group_id, CAST(doc_id AS INTEGER) FROM
  (SELECT * FROM all_medoid_sum WHERE group_id IN (SELECT group_id FROM policy WHERE needs_recompute)
   QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY greatest(s, -1.0) DESC, doc_id) = 1)""")
_sql("buffer_clear", "policy buf", """
SELECT group_id, doc_id FROM buf WHERE group_id NOT IN (SELECT group_id FROM policy WHERE needs_recompute)""")
_sql("regroup_affected", "old_doc new_doc", """
SELECT o.group_id, count(*) AS n_moved,
       o.group_id IN (SELECT group_id FROM old_doc WHERE doc_id NOT IN (SELECT doc_id FROM new_doc)
                      UNION ALL SELECT group_id FROM new_doc) AS has_segments
FROM old_doc o JOIN new_doc n USING (doc_id) WHERE o.group_id <> n.group_id GROUP BY o.group_id""")

# --- events ------------------------------------------------------------------------------

_view("tool", "", """
SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'github' WHEN 'view' THEN 'jira' WHEN 'purchase' THEN 'confluence'
       WHEN 'signup' THEN 'miro' ELSE 'pager' END AS source FROM events""")
_sql("route_by_source", "tool", f"""
SELECT event_id, source, source <> 'pager' AS dispatched,
       CASE source WHEN 'pager' THEN 'No normalizer registered for source: "pager"'
                   ELSE 'Normalization error: missing required fields' END AS error
FROM tool""")
_sql("payload_filter", "tool", """
SELECT event_id, source, CASE source WHEN 'github' THEN 'acme/' || user_id ELSE CAST(user_id AS VARCHAR) END AS object_key
FROM tool WHERE source IN ('github', 'jira', 'confluence')""")
_view("commit_file", "", """
SELECT doc_id AS event_id, source AS repo, i, CAST(length(line) AS INTEGER) AS additions,
       CASE WHEN length(line) > 80 THEN 'Docs/' || split_part(line, ' ', 1)
            ELSE 'src/' || split_part(line, ' ', 1) || '.py' END AS filename
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
_view("doc_file", "commit_file", """
SELECT * FROM commit_file WHERE lower(filename) LIKE '%readme%' OR lower(filename) LIKE '%.md' OR lower(filename) LIKE '%docs%'""")
_sql("doc_file_filter", "doc_file", "SELECT event_id, filename, additions FROM doc_file")
_sql("commit_enrichment", "commit_file doc_file", """
SELECT e.doc_id AS event_id, CAST(CASE WHEN f.files IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_commits, coalesce(f.files, '') AS files
FROM documents e LEFT JOIN (
  SELECT event_id, string_agg(filename || '=' || content, ';' ORDER BY i) AS files
  FROM doc_file LEFT JOIN (SELECT repo, filename, count(*) AS content FROM commit_file
                           WHERE event_id IN (SELECT doc_id FROM labels) GROUP BY repo, filename) c USING (repo, filename)
  GROUP BY event_id HAVING count(*) = count(content)) f ON f.event_id = e.doc_id""")
_sql("changed_files", "commit_file", """
SELECT event_id, string_agg(filename, ';' ORDER BY i) AS files
FROM (SELECT event_id, filename, min(i) AS i FROM commit_file GROUP BY event_id, filename) GROUP BY event_id""")
_view("push_file", "", """
SELECT doc_id, i, line, 'docs/' || split_part(line, ' ', 1) || '.md' AS filename
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM documents)""")
_sql("normalize_github", "push_file", """
SELECT 'g' || d.doc_id AS event_id, 'acme-' || source || '-' || names AS doc_id, 'github' AS source, source AS title,
       CASE WHEN blocks IS NULL THEN lang ELSE lang || chr(10) || blocks END AS content, CAST(NULL AS VARCHAR) AS error,
       TRUE AS stamped, lang AS branch, 'acme/' || source AS repo, source AS author, first_file
FROM documents d
JOIN (SELECT doc_id, string_agg(replace(filename, '/', '-'), '_' ORDER BY i) AS names
      FROM (SELECT doc_id, replace(filename, '/', '-') AS filename, min(i) AS i FROM push_file GROUP BY ALL) GROUP BY doc_id) n USING (doc_id)
JOIN (SELECT doc_id, first(filename ORDER BY i) AS first_file FROM push_file GROUP BY doc_id) f USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg('FILE: ' || filename || chr(10) || line, chr(10) || chr(10) ORDER BY i) AS blocks
           FROM push_file WHERE line <> '' GROUP BY doc_id) b USING (doc_id)""")
_sql("normalize_jira", "", """
SELECT 'j' || o_orderkey AS event_id, 'ORD-' || o_orderkey AS doc_id, 'jira' AS source, o_orderpriority AS title,
       o_orderpriority || chr(10) || 'status: empty -> ' || o_orderstatus || chr(10) || 'price: empty -> ' || price AS content,
       CAST(NULL AS VARCHAR) AS error, TRUE AS stamped, o_orderstatus AS status, o_orderpriority AS priority,
       CAST(o_custkey AS VARCHAR) AS project, price AS change
FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS price FROM orders)""")


# the constructs that the given pages hold, one step each, written apart from the library's rules
_view("page_plain", "", r"""
SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(html,
       '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS t
FROM pages""")
_view("page_marked", "page_plain", r"""
SELECT page_id, url, html, replace(replace(
       regexp_replace(regexp_replace(t, '<b>([^<]*)</b>', '**\1**', 'g'),
                      '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', '[\2](\1)', 'g'),
       '<li>', chr(10) || '- '), '<h1>', chr(10) || chr(10) || '# ') AS t
FROM page_plain""")
_view("page_lines", "page_marked", r"""
SELECT page_id, url, html, regexp_replace(regexp_replace(replace(t, '<br>', chr(10)),
       '</?(p|div|ul|article|nav|footer|title|h1)( [^>]*)?>', chr(10) || chr(10), 'g'), '(?s)<[^>]+>', '', 'g') AS t
FROM page_marked""")
_view("page_chars", "page_lines", r"""
SELECT page_id, url, html, replace(replace(replace(replace(t,
       '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t
FROM page_lines""")
_view("page", "page_chars", r"""
SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(t,
       '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text
FROM page_chars""")
_sql("html_text", "page", "SELECT page_id, text FROM page")
_view("page_doc", "page", _analysis("page", "page_id", "text"))
_sql("page_struct_type", "page_doc", "SELECT page_id, n_words, struct_type, title FROM page_doc")
_sql("bullet_features", "page", r"""
SELECT page_id, CAST(len(f) AS INTEGER) AS n_features, array_to_string(f, '|') AS features, description
FROM (SELECT page_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS description,
             list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
                                        lambda x: x LIKE '-%' OR x LIKE '*%'),
                            lambda x: regexp_replace(x, '^[-*]\s*', '')) AS f
      FROM page)""")
_sql("normalize_confluence", "page", """
SELECT 'c' || page_id AS event_id, CAST(page_id AS VARCHAR) AS doc_id, 'confluence' AS source,
       CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title, text AS content,
       CASE WHEN text = '' THEN 'Normalization error: missing required fields' END AS error, TRUE AS stamped,
       CASE WHEN version <> 1 THEN CAST(version - 1 AS VARCHAR) END AS version_before,
       CASE WHEN version <> 0 THEN CAST(version AS VARCHAR) END AS version_after, url, 'page_event' AS kind
FROM (SELECT *, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
             TRY_CAST(regexp_extract(url, '/(\\d+)', 1) AS INTEGER) AS version FROM page)""")
_sql("normalize_miro", "", """
SELECT 'm' || event_id AS event_id, CAST(user_id AS VARCHAR) AS doc_id, 'miro' AS source, 'Board ' || user_id AS title,
       event_type || chr(10) || props AS content, CAST(NULL AS VARCHAR) AS error, TRUE AS stamped,
       'item:' || event_type AS kind, event_type AS action, CAST(event_id AS VARCHAR) AS item_id
FROM events""")
_sql("change_gate", "", """
SELECT event_id, user_id, event_type FROM events
QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)""")
_sql("change_gate_batches", "", """
SELECT event_id, user_id, event_type FROM events
QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)""")
_sql("readme_gate", "", """
SELECT doc_id, source, md5(old_text) AS old_md5
FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY source ORDER BY doc_id), '') AS old_text FROM documents)
WHERE old_text <> text""")
_view("turn_line", "", r"""
SELECT conv_id, turn, i, line, row_number() OVER (PARTITION BY conv_id, turn, line ORDER BY i) AS copy
FROM (SELECT conv_id, turn, unnest(l) AS line, generate_subscripts(l, 1) AS i
      FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l FROM conversations))""")
_view("previous_turn", "", """
SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations""")
_view("new_line_run", "turn_line previous_turn", """
SELECT n.*, n.i - row_number() OVER (PARTITION BY n.conv_id, n.turn ORDER BY n.i) AS run
FROM turn_line n JOIN previous_turn p USING (conv_id, turn)
WHERE NOT EXISTS (SELECT 1 FROM turn_line o WHERE o.conv_id = n.conv_id AND o.turn = p.before
                  AND o.line = n.line AND o.copy = n.copy)""")
_sql("added_lines", "new_line_run", r"""
SELECT conv_id, turn, added
FROM (SELECT conv_id, turn, regexp_replace(string_agg(part, chr(10) ORDER BY run), '^\s+|\s+$', '', 'g') AS added
      FROM (SELECT conv_id, turn, run, string_agg(line, '' ORDER BY i) AS part FROM new_line_run GROUP BY conv_id, turn, run)
      GROUP BY conv_id, turn)
WHERE added <> ''""")
_sql("version_changes", "", """
SELECT conv_id, version, before IS DISTINCT FROM text AS changed,
       CASE WHEN before IS DISTINCT FROM text THEN before END AS from_text,
       CASE WHEN before IS DISTINCT FROM text THEN text END AS to_text, substring(text, 1, 200) AS summary
FROM (SELECT conv_id, turn + 1 AS version, text,
             CASE WHEN lag(turn) OVER w = turn - 1 THEN lag(text) OVER w END AS before
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
_view("message", "", """
SELECT doc_id AS message_id, coalesce(toxic, 0) = 1 AS broken, coalesce(quality, 1) = 0 AS no_content, source, lang, text
FROM documents LEFT JOIN labels USING (doc_id)""")
_sql("required_fields", "message", r"""
SELECT message_id, CASE WHEN broken THEN 'Missing required fields: doc_id, source, content, metadata'
                        WHEN no_content OR text = '' THEN 'Missing required fields: content'
                        WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN 'Content field is empty' ELSE '' END AS errors
FROM message""")
_sql("duplicate_check", "", """
SELECT d.doc_id, d.source, CASE WHEN toxic = 0 THEN 'q' || quality END AS existing_group_id,
       CASE WHEN toxic = 0 THEN 'docs/' || d.doc_id END AS existing_path,
       coalesce(toxic = 0, FALSE) AS is_duplicate, CASE WHEN toxic = 0 THEN 'AUTO_ASSIGN' END AS route
FROM documents d LEFT JOIN labels USING (doc_id)""")
_sql("dead_letter_split", "message", """
SELECT message_id, CASE WHEN NOT broken THEN CAST(message_id AS VARCHAR) END AS doc_id,
       CASE WHEN broken OR no_content THEN 'quarantine' ELSE 'normalized' END AS destination,
       CASE WHEN broken THEN 'message is not valid JSON' WHEN no_content THEN 'missing fields: content' END AS error
FROM message""")
_sql("dead_letter_replay", "message", """
SELECT message_id, CAST(message_id AS VARCHAR) AS doc_id, 'replay' AS source, text AS content FROM message WHERE broken""")


def _sessions(gap: str) -> str:
    return f"""
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started_at,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS sent_at,
       last(event_type || ':' || props ORDER BY ts, event_id) AS payload, count(*) AS n
FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL {gap} THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))
GROUP BY user_id, burst"""


_sql("debounce_sessions", "", f"SELECT user_id, sent_at, payload, n FROM ({_sessions('5 seconds')})")
_sql("debounce_long_gap", "", f"SELECT * FROM ({_sessions('6 hours')})")

# --- model output ---------------------------------------------------------------------------

_LABELLED = """'Project Identity: ' || source || chr(10) || 'Lifecycle Stage: ' || lang || chr(10) ||
       'Technical Concepts: ' || array_to_string(string_split(text, ' ')[1:3], ', ') || chr(10) || 'Summary: ' || text"""
_sql("fingerprint_compose", "", f"""
SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN {_LABELLED}
                    WHEN lang = 'de' THEN 'Key Entities: source, lang' || chr(10) || 'Summary: ' || text
                    ELSE regexp_replace('{{"fingerprint": ' || text, '^\\s+|\\s+$', '', 'g') END AS fingerprint,
       CASE WHEN lang = 'es' THEN 'JSON parse error' END AS error
FROM documents""".replace("'Key Entities: source, lang'", "'Key Entities: ' || source || ', ' || lang"))
_sql("doc_type_check", "", """
SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'design' ELSE 'reference' END AS doc_type FROM documents""")
_sql("strip_fences", "", r"""
SELECT doc_id, CAST(length(body) AS INTEGER) AS n_chars, md5(body) AS body_md5
FROM (SELECT doc_id, CASE WHEN lang = 'es' THEN regexp_replace('{"fingerprint": ' || text, '\s+$', '')
       WHEN lang = 'de' THEN CAST(to_json({'fingerprint': text, 'doc_type': lang, 'key_entities': [source, lang]}) AS VARCHAR)
       ELSE CAST(to_json({'fingerprint': text, 'doc_type': ' Design ', 'project_identity': source, 'functional_domain': '',
                          'lifecycle_stage': lang, 'technical_concepts': string_split(text, ' ')[1:3],
                          'key_entities': CAST([] AS VARCHAR[])}) AS VARCHAR) END AS body
      FROM documents)""")
_view("decision", "", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'ASSIGN' ELSE 'CREATE_NEW' END AS decision,
       CASE lang WHEN 'en' THEN source END AS assigned_group_id,
       CASE lang WHEN 'en' THEN least(1.0, n_chars / 1000.0) ELSE 0.0 END AS confidence,
       CASE lang WHEN 'en' THEN text WHEN 'fr' THEN ''
                 ELSE 'Defaulted to CREATE_NEW due to error in agent review process.' END AS reasoning,
       CASE lang WHEN 'de' THEN 'Invalid decision: MAYBE' WHEN 'es' THEN 'No JSON object found in model response' END AS error
FROM documents""")
_sql("decision_parse", "decision", "SELECT * FROM decision")
_sql("message_content", "", """
SELECT conv_id, turn, CASE role WHEN 'assistant' THEN text || chr(10) || role ELSE text END AS text FROM conversations""")
_sql("final_outcome", "message routed decision", r"""
SELECT CAST(message_id AS VARCHAR) AS doc_id,
       CASE WHEN invalid THEN 'INVALID' WHEN assign AND coalesce(target, '') = '' THEN 'ERROR'
            WHEN assign THEN 'ASSIGNED' ELSE 'CREATED' END AS outcome,
       CASE WHEN NOT invalid THEN target END AS target_group_id,
       CASE WHEN invalid THEN 'validate_input'
            ELSE 'validate_input>check_duplicate' || CASE WHEN reviewed THEN '>agent_review' ELSE '' END
                 || CASE WHEN assign THEN '>assign_node' ELSE '>create_node' END END AS decision_path, errors
FROM (SELECT *, duplicate OR (reviewed AND decision = 'ASSIGN') OR route = 'AUTO_ASSIGN' AS assign,
             CASE WHEN duplicate THEN 'q' || quality WHEN reviewed AND decision = 'ASSIGN' THEN assigned_group_id
                  WHEN route = 'AUTO_ASSIGN' THEN existing_group_id END AS target
      FROM (SELECT m.*, l.quality, d.decision, d.assigned_group_id, r.existing_group_id,
                   CASE WHEN broken THEN 'Missing required fields: source, content, metadata'
                        WHEN no_content OR m.text = '' THEN 'Missing required fields: content'
                        WHEN regexp_replace(m.text, '^\s+|\s+$', '', 'g') = '' THEN 'Content field is empty' ELSE '' END AS errors,
                   errors <> '' AS invalid,
                   NOT invalid AND coalesce(l.toxic = 0, FALSE) AS duplicate,
                   CASE WHEN l.toxic = 0 THEN 'AUTO_ASSIGN' WHEN broken THEN 'CREATE_NEW_GROUP'
                        ELSE coalesce(r.route, 'CREATE_NEW_GROUP') END AS route,
                   NOT invalid AND NOT duplicate AND route = 'REVIEW_BY_AGENT' AS reviewed
            FROM (SELECT * FROM message) m LEFT JOIN labels l ON l.doc_id = m.message_id
            LEFT JOIN routed r ON r.query_id = m.source || '/' || m.lang
            LEFT JOIN decision d ON d.doc_id = m.message_id))""")

_ingested = _kmeans("ingest", _PROTO_K, C.KMEANS_ITERATIONS, "tseg", "segment_id")
_sql("ingest_batch", _ingested, f"""
SELECT d.group_id, d.doc_count, coalesce(p.n, 0) AS proto_count, CAST(0 AS BIGINT) AS n_buffered
FROM (SELECT source AS group_id, count(*) AS doc_count FROM documents GROUP BY source) d
LEFT JOIN (SELECT group_id, count(DISTINCT cluster) AS n FROM {_ingested} GROUP BY group_id) p USING (group_id)""")

_view("moved_seg", "seg", """
SELECT s.doc_id, s.group_id AS old_group, s.embedding,
       CASE WHEN quality = 0 THEN NULL WHEN toxic = 1 THEN CAST((CAST(s.group_id AS BIGINT) + 1) % 10 AS VARCHAR) ELSE s.group_id END AS group_id
FROM seg s LEFT JOIN labels l ON l.doc_id = s.doc_id""")
_view("moved_group", "moved_seg", """
SELECT DISTINCT unnest([old_group, group_id]) AS group_id FROM moved_seg WHERE group_id IS DISTINCT FROM old_group""")
_view("moved_medoid", "moved_seg", """
SELECT group_id, doc_id, count(*) OVER (PARTITION BY group_id) AS n
FROM (SELECT a.group_id, a.doc_id, coalesce(round(sum(list_inner_product(a.embedding, b.embedding)), 9), 0.0) AS s
      FROM moved_seg a LEFT JOIN moved_seg b ON a.group_id = b.group_id AND a.doc_id <> b.doc_id
      WHERE a.group_id IS NOT NULL GROUP BY a.group_id, a.doc_id)
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY greatest(s, -1.0) DESC, doc_id) = 1""")
_sql("regroup_repair", "moved_group moved_medoid", """
SELECT g.group_id, coalesce(n, 0) AS n_documents, doc_id AS prototype
FROM moved_group g LEFT JOIN moved_medoid m ON g.group_id = m.group_id WHERE g.group_id IS NOT NULL""")
_sql("stored_state", "", """
SELECT d.doc_id, CASE WHEN lang = 'de' THEN 'de' WHEN toxic = 1 THEN 'flagged' ELSE source END AS group_id,
       CASE WHEN lang = 'de' THEN 2 WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END AS version
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE lang = 'de' OR l.doc_id IS NULL OR quality = 1""")

_sql("seed_load", "", """
SELECT source || ':' || doc_id || '.md' AS doc_id, doc_id || '.md' AS doc_path, source AS group_id,
       'Document ' || doc_id AS title,
       'Title: Document ' || doc_id || chr(10) || 'Group: ' || lang || chr(10) || 'Source: jira' || chr(10) || chr(10)
       || text || chr(10) AS content
FROM documents""")

_view("seeded", "", _analysis("""
(SELECT source || '-' || lang || ':' || doc_id || '.md' AS doc_id, doc_id || '.md' AS doc_path, source || '-' || lang AS group_id, lang,
        'Title: Document ' || doc_id || chr(10) || 'Group: ' || lang || chr(10) || 'Source: jira' || chr(10) || chr(10)
        || text || chr(10) AS content
 FROM documents)""", "doc_id, doc_path, group_id, lang", "content"))
_sql("seed_ingest", "seeded", """
SELECT doc_id, doc_path, group_id, 'Seed group for ' || lang AS group_summary, total AS n_chunks,
       CAST(n_words + 2 + (total - 1) * overlap AS BIGINT) AS chunk_words, count(*) OVER (PARTITION BY group_id) AS doc_count
FROM (SELECT *, CASE WHEN struct_type = 'short' THEN 1
                     ELSE greatest(1, CAST(ceil((n_words + 2 - overlap) / (size - overlap)) AS BIGINT)) END AS total
      FROM (SELECT *, CASE struct_type WHEN 'code' THEN 384 WHEN 'list' THEN 256 ELSE 512 END AS size,
                   CASE struct_type WHEN 'code' THEN 48 WHEN 'list' THEN 32 ELSE 64 END AS overlap FROM seeded))""")

# --- pages as new documents --------------------------------------------------------------

_view("incoming", "page", """
SELECT 'page-' || page_id AS query_id, text, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM page""")
_view("page_vec", "incoming", _term_vectors("incoming", "query_id", "'search_query: ' || text"))
_view("tbuf", "tseg", "SELECT * FROM tseg WHERE doc_id IN (SELECT doc_id FROM labels)")
for _kind, _table, _index, _floor, _tie in [
    ("page_proto", "tproto", "proto_index", 0.4, ""),
    ("page_buffer", "tbuf", "segment_index", 0.4, "doc_id, "),
    ("page_segment", "tseg", "segment_index", 0.37, "doc_id, "),
]:
    _view(f"{_kind}_hit", f"page_vec {_table}", _topk(_table, _index, _floor, queries="page_vec", tie=_tie))
    _view(f"{_kind}_score", f"{_kind}_hit", _score(f"{_kind}_hit"))
_view("page_early", "page_proto_score page_buffer_score", _merge("page_proto_score", "page_buffer_score"))
_view("page_candidate", "page_early page_segment_score", _merge("page_early", "page_segment_score"))
_sql("classify_pages", "incoming page_candidate", f"""
SELECT doc_id, outcome, route, top_similarity, group_name,
       CASE outcome WHEN 'ASSIGNED' THEN top_group
                    WHEN 'CREATED' THEN left(sha256(group_name || '/' || doc_id), 32) END AS group_id,
       CASE WHEN outcome <> 'INVALID' THEN 'docs/' || group_name || '/reference/confluence/' || doc_id || '.md' END AS doc_path
FROM (SELECT query_id AS doc_id, top_group, outcome, CASE WHEN outcome <> 'INVALID' THEN route END AS route, top_similarity,
             CASE outcome WHEN 'ASSIGNED' THEN 'team-' || top_group
                          WHEN 'CREATED' THEN {_slug("CASE WHEN title = '' THEN 'Untitled' ELSE title END")} END AS group_name
      FROM (SELECT i.query_id, i.title, c.group_id AS top_group,
                   CASE WHEN i.text <> '' THEN coalesce(c.similarity, 0.0) END AS top_similarity,
                   CASE WHEN c.group_id IS NULL THEN 'CREATE_NEW_GROUP' WHEN c.similarity >= 0.7 THEN 'AUTO_ASSIGN'
                        ELSE 'REVIEW_BY_AGENT' END AS route,
                   CASE WHEN i.text = '' THEN 'INVALID' WHEN route = 'AUTO_ASSIGN' THEN 'ASSIGNED' ELSE 'CREATED' END AS outcome
            FROM incoming i
            LEFT JOIN (SELECT * FROM page_candidate
                       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, group_id) = 1) c USING (query_id)))""")
