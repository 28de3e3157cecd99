"""The registered queries of this package, each over its whole table, with the SQL that states the result where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundlake.llm import graphs, hmm, leaks, lines, merkle, multiindex, packing, pieces, pii, quality, simhash, suffixes, whitening
from soundlake.llm.common import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


@query("op8_line_dedup", r"""WITH l AS (
  SELECT doc_id, rowid_, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (
    SELECT doc_id, row_number() OVER () AS rowid_, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT k.*, f.holder IS NOT NULL AND k.doc_id > f.holder AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, rowid_""")
def line_dedup(spark, sf_dir):
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_simhash")
def simhash_groups(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def quality_scores(spark, sf_dir):
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op10_pii")
def private_data(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op1_suffix_dedup")
def repeated_strings(spark, sf_dir):
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op3_hmm_score")
def language_scores(spark, sf_dir):
    return hmm.score(table(spark, sf_dir, "documents"))


@query("op6_hnsw_neighbours")
def nearest_vectors(spark, sf_dir):
    return graphs.nearest(table(spark, sf_dir, "embeddings"))


@query("op9_embedding_dedup")
def embedding_groups(spark, sf_dir):
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_sampled_pieces")
def sampled_pieces(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_merkle_manifest", r"""WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS rid, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS c FROM documents),
h AS (SELECT rid, doc_id, lang, n_chars + CASE WHEN xor(c, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS changed,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS front,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS number, coalesce(strlen(text) || ':' || text, '-') AS back FROM d),
l AS (SELECT rid, doc_id, lang, sha256(front || number || back) AS leaf,
    sha256(front || coalesce(strlen(changed::VARCHAR) || ':' || changed, '-') || back) AS bad FROM h),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, bad) - 1 AS idx FROM l),
tree AS (SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM leaves GROUP BY lang UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM tree WHERE len(nodes) > 1),
subs AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM tree WHERE len(nodes) = 1),
upper_tree AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subs UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM upper_tree WHERE len(nodes) > 1),
walk AS (SELECT rid, lang, 0 AS level, idx, bad AS digest, '' AS proof, false AS done FROM leaves UNION ALL
  SELECT w.rid, w.lang, w.level + 1, w.idx // 2, CASE WHEN len(t.nodes) = 1 THEN w.digest WHEN w.idx % 2 = 0 THEN sha256(w.digest || coalesce(t.nodes[xor(w.idx, 1) + 1], ''))
    ELSE sha256(t.nodes[xor(w.idx, 1) + 1] || w.digest) END, w.proof || CASE WHEN len(t.nodes) = 1 THEN '' ELSE coalesce(t.nodes[xor(w.idx, 1) + 1], '') END, len(t.nodes) = 1
  FROM walk w JOIN tree t ON t.level = w.level AND t.lang IS NOT DISTINCT FROM w.lang WHERE NOT w.done),
climb AS (SELECT w.rid, 0 AS level, s.place AS idx, w.digest, w.proof, false AS done, s.subroot FROM walk w JOIN subs s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.done UNION ALL
  SELECT w.rid, w.level + 1, w.idx // 2, CASE WHEN len(t.nodes) = 1 THEN w.digest WHEN w.idx % 2 = 0 THEN sha256(w.digest || coalesce(t.nodes[xor(w.idx, 1) + 1], ''))
    ELSE sha256(t.nodes[xor(w.idx, 1) + 1] || w.digest) END, w.proof || CASE WHEN len(t.nodes) = 1 THEN '' ELSE coalesce(t.nodes[xor(w.idx, 1) + 1], '') END, len(t.nodes) = 1, w.subroot
  FROM climb w JOIN upper_tree t ON t.level = w.level WHERE NOT w.done),
top AS (SELECT nodes[1] AS root FROM upper_tree WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM climb JOIN leaves USING (rid) CROSS JOIN top WHERE done""")
def merkle_manifest(spark, sf_dir):
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


@query("op13_decontamination", r"""WITH b AS (
  SELECT item_id, row_number() OVER () AS bid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, bid, least(10, len(ws)) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM b),
bl AS (SELECT item_id, n, list(w) OVER (PARTITION BY bid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM bw),
win AS (SELECT DISTINCT item_id, n, array_to_string(l[1:n], ' ') AS key FROM bl WHERE len(l) >= n),
lens AS (SELECT DISTINCT n FROM win),
d AS (SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
dw AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
dl AS (SELECT rid, pos, list(w) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM dw),
m AS (SELECT rid, pos, win.n, item_id FROM (SELECT rid, pos, n, array_to_string(l[1:n], ' ') AS key FROM dl JOIN lens ON len(l) >= n) x JOIN win ON win.n = x.n AND win.key = x.key),
hits AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(pos, pos + n)) AS place FROM m) GROUP BY rid),
held AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM m GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN held USING (rid)""")
def contaminated_documents(spark, sf_dir):
    return leaks.leak_report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("op11_embedding_whitening")
def whitened_vectors(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
