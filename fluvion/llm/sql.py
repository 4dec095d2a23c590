"""DuckDB SQL for the operators' queries, where SQL can express them."""

_WORDS = r"'[^\x20\x09-\x0D]+'"

VECTORS = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = e.vec_id
"""

SUBSTRING = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS h FROM words, unnest(generate_series(1, len(w) - 49)) AS t(i)
), first AS (
  SELECT h, min(doc_id) AS least FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS k FROM windows JOIN first USING (h) WHERE doc_id > least
), kept AS (
  SELECT doc_id, string_agg(w[k], ' ' ORDER BY k) AS text FROM words, unnest(generate_series(1, len(w))) AS t(k)
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.k = t.k) GROUP BY doc_id
), removed AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT words.doc_id, len(w) AS n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

MINHASH = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM words, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS t(i)
  WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""

TOPK = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
)
SELECT * FROM ranked WHERE rank <= 10
"""

# h as a group of eight hex digits of a digest.
_H = "CAST('0x' || substr(digest, {}, 8) AS BIGINT)"

MIDDLE = f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || doc_id) AS digest FROM documents
), drawn AS (
  SELECT *, len(u) AS n, {_H.format(1)} % (len(u) + 1) AS h1, {_H.format(9)} % (len(u) + 1) AS h2, {_H.format(17)} % 100 AS h3, {_H.format(25)} % 100 AS h4 FROM units
), cut AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 100 THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1 : least(h1, h2)], '') AS prefix, array_to_string(u[least(h1, h2) + 1 : greatest(h1, h2)], '') AS middle, array_to_string(u[greatest(h1, h2) + 1 : n], '') AS suffix
  FROM drawn
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM made
"""

# crc32 of each byte value, by eight steps of the polynomial.
_BYTES = "range(256)"
for _ in range(8):
    _BYTES = f"list_transform({_BYTES}, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_FEATURES = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

RESAMPLE = f"""
WITH crc AS (
  SELECT {_BYTES} AS t
), words AS (
  SELECT doc_id, {_FEATURES} AS w FROM documents
), uses AS (
  SELECT doc_id, unnest(w) AS f FROM words
), wanted AS (
  SELECT unnest({_FEATURES}) AS f FROM benchmark
), distinct_words AS (
  SELECT f, hex(f) AS x FROM (SELECT f FROM uses UNION SELECT f FROM wanted)
), buckets AS (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM distinct_words, crc
), source_n AS (
  SELECT bucket, count(*) AS n FROM uses JOIN buckets USING (f) GROUP BY bucket
), target_n AS (
  SELECT bucket, count(*) AS n FROM wanted JOIN buckets USING (f) GROUP BY bucket
), sums AS (
  SELECT (SELECT count(*) FROM uses) AS s_all, (SELECT count(*) FROM wanted) AS t_all
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * (s_all + 10000) / (CAST(s.n + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM source_n s LEFT JOIN target_n t USING (bucket), sums
), sized AS (
  SELECT doc_id, sum(gain) AS weight FROM uses JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN sized USING (doc_id)
), places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN places USING (doc_id)
"""
