"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, collocations, embedding_neighbours, exact_dedup, fill_in_middle, jaccard_join, packing, quality, secrets, sentencepiece_codec, suffix_dedup, token_counts, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_texts(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.piece_digests(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(_table(spark, sf_dir, "documents")))


def op7_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neighbours.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents")).drop("live", "text_sha256")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_digests(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_jaccard_join": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
            ), s AS (
                SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
            ), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), link AS (
                SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id != b.doc_id
                GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
            ), reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
            SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = doc_id""",
        "op7_embedding_neighbours": """
            WITH RECURSIVE v AS (
                SELECT vec_id, embedding::DOUBLE[] AS e, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS s FROM embeddings
            ), link AS (
                SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
                WHERE a.vec_id != b.vec_id AND a.s > 0 AND b.s > 0 AND list_dot_product(a.e, b.e) >= 0.9 * sqrt(a.s) * sqrt(b.s)
            ), reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
            SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c::BIGINT AS component_id, vec_id = c AS kept
            FROM v JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = vec_id
            LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = vec_id""",
        "op11_collocations": r"""
            WITH p AS (
                SELECT coalesce(lang, 'und') AS lang,
                       unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
            ), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
            g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, range(1, 5) r(k)),
            f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
            c AS MATERIALIZED (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM f WHERE k > 1),
            pair AS MATERIALIZED (SELECT lang, g, f, k, j, array_to_string(w[1:j], ' ') AS lg, array_to_string(w[j + 1:k], ' ') AS rg FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
            cut AS MATERIALIZED (
                SELECT p.lang, p.g, p.f AS a, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * p.f) // (l.f + r.f))::BIGINT AS score
                FROM pair p JOIN f l ON l.lang = p.lang AND l.g = p.lg JOIN f r ON r.lang = p.lang AND r.g = p.rg
            ), best AS MATERIALIZED (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
            inner_ AS MATERIALIZED (
                SELECT lang, f, array_to_string(w[s:s + m - 1], ' ') AS g
                FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM c))
            ), part AS MATERIALIZED (SELECT DISTINCT i.lang, i.g FROM inner_ i JOIN c ON c.lang = i.lang AND c.g = i.g WHERE 100 * i.f >= 80 * c.f),
            ranked AS (
                SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase, a, l, r, n, score
                FROM (SELECT * FROM best ANTI JOIN part USING (lang, g)) JOIN n USING (lang)
            ) SELECT * FROM ranked WHERE rank <= 2000""",
        "op13_fill_in_middle": """
            WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS d FROM documents),
            c AS (SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM h),
            o AS (
                SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                       CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c
            ), r AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM o)
            SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars, CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
            FROM r""",
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    }
