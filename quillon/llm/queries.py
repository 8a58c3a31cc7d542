"""The queries of this subpackage by name, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillon.llm import bytebpe, decontaminate, embeddings, langid, licenses, neardup, runs, search, sharding, tokens, toxicity, warc


def queries() -> dict:
    return {
        "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
        "op2_bpe_codec": tokens.op2_bpe_codec,
        "op3_language_id": langid.op3_language_id,
        "op4_token_counts": tokens.op4_token_counts,
        "op5_warc_dictionary": warc.op5_warc_dictionary,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_sharding": sharding.op7_sharding,
        "op8_minhash_near_dedup": neardup.op8_minhash_near_dedup,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_embedding_near_dedup": embeddings.op10_embedding_near_dedup,
        "op11_byte_bpe_codec": bytebpe.op11_byte_bpe_codec,
        "op12_ranked_search": search.op12_ranked_search,
        "op13_periodic_runs": runs.op13_periodic_runs,
    }


_DIGEST = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, h FROM p),
e AS (SELECT page_id, n, h, array_to_string([array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(x, 5 * k + 1, 5))::INTEGER >> s) & 31) + 1] FOR s IN [15, 10, 5, 0]], '') FOR k IN range(0, 8)], '') AS g FROM d),
m AS (SELECT h, max(page_id) AS last FROM e GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, g AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM e JOIN m USING (h)"""

_REACH = """, near(a, b) AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link), reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a), low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"""

_NEAR_TEXTS = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)]) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
link(a, b) AS (SELECT a.doc_id, b.doc_id FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))){_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept FROM s LEFT JOIN low ON a = doc_id"""

_NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
link(a, b) AS (SELECT a.vec_id, b.vec_id FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93){_REACH},
deg AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN deg ON deg.a = vec_id"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; models, tokenizers, checksums and rules have brute-force tests instead."""
    return {"op5_warc_dictionary": _DIGEST, "op8_minhash_near_dedup": _NEAR_TEXTS, "op10_embedding_near_dedup": _NEAR_VECTORS, "op12_ranked_search": search.SQL}
