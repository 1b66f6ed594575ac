"""The registered queries of the corpus operators, and their SQL where SQL can express them.

Each query applies its operator to the whole table with production parameters and
derives the digest columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, chat, collocations, decontam, embed_join, fim, ngram_join, pii, recompress, secrets, suffix_dedup, toxicity, warc
from attesta.llm.common import read_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(read_table(spark, sf_dir, "documents")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digest(bpe.roundtrip(read_table(spark, sf_dir, "documents"), path, pattern))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(ngram_join.link_documents(read_table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.roundtrip(read_table(spark, sf_dir, "pages"), min_revisit_bytes=0))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pseudonymise(read_table(spark, sf_dir, "documents"), pii.session_key(spark)))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts hold control strings."""
    said = "\\### Assistant: </turn> ok"
    own = spark.sql(
        "SELECT conv_id, turn, role, text FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)",
        args={"said": said},
    )
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    parts = F.array(
        F.struct(
            F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")
        )
    )
    return chat.digest(chat.format_chats(rows.withColumn("parts", parts)))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.link_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


CATEGORIES = ["quality", "toxic"]


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the chain's probabilities and whether the document is toxic."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    models = toxicity.train(docs, labels, CATEGORIES)
    scored = toxicity.score(docs, models, CATEGORIES)
    return scored.select(
        F.col("id").alias("doc_id"), F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), (F.col("p_toxic") >= models[1].threshold).alias("toxic")
    )


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digest(recompress.remove_repeated_words(read_table(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secrets": op2_secrets,
    "op3_bpe": op3_bpe,
    "op4_ngram_join": op4_ngram_join,
    "op5_warc": op5_warc,
    "op6_pii": op6_pii,
    "op7_embeddings": op7_embeddings,
    "op8_decontam": op8_decontam,
    "op9_chat": op9_chat,
    "op10_toxicity": op10_toxicity,
    "op11_recompression": op11_recompression,
    "op12_collocations": op12_collocations,
    "op13_fim": op13_fim,
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n_bytes FROM d),
        p AS (SELECT doc_id, u.i AS i, hash(substr(h, 2 * u.i + 1, 200)) AS x FROM n, unnest(range(0, n_bytes - 99)) AS u(i)),
        r AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM p) WHERE k > 1
        ), g AS (
            SELECT doc_id, i, sum(CASE WHEN i <= last + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
            FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM r)
        ), s AS (
            SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, run
        ), k AS (
            SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte FROM s
        ), t AS (
            SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS tail FROM s GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, string_agg(substr(h, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a) AS head FROM k JOIN n USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
        FROM n LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op4_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda k: array_to_string(w[k : k + least(len(w), 5) - 1], ' '))) AS g
            FROM d WHERE len(w) > 0
        ), n AS (SELECT doc_id, len(g) AS n FROM s), u AS (SELECT doc_id, unnest(g) AS gram FROM s),
        l AS (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM u x JOIN u y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL)
            JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
        ), reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON doc_id = a
    """,
    "op5_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), d AS (
            SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
                   CAST(unhex(sha1(payload)) AS BIT)::VARCHAR AS bits, min(page_id) OVER (PARTITION BY payload) AS first
            FROM p
        )
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(
                   list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(1 + 5 * k + j AS BIGINT), 1) AS INT) << CAST(4 - j AS INT))) AS BIGINT), 1)), '')
                   AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM d
    """,
    "op7_embeddings": """
        WITH RECURSIVE g AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach(a, b) AS (
            SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
        ), c AS (SELECT a, min(b) AS least FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
               vec_id <= coalesce(least, vec_id) AS kept
        FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
    """,
    "op8_decontam": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), i AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
        ), s AS (
            SELECT item_id, len(list_distinct(g)) AS size, unnest(list_distinct(g)) AS gram
            FROM (SELECT item_id, list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda k: array_to_string(w[k : k + least(len(w), 5) - 1], ' ')) AS g FROM i WHERE len(w) > 0)
        ), g AS (
            SELECT DISTINCT doc_id, array_to_string(w[k : k + n - 1], ' ') AS gram
            FROM d, (SELECT DISTINCT least(len(w), 5) AS n FROM i WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS u(k)
        ), hit AS (
            SELECT doc_id, item_id FROM g JOIN s USING (gram) GROUP BY doc_id, item_id, size HAVING 100 * count(*) >= 75 * size
        )
        SELECT doc_id, count(item_id) AS n_items, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id), '') AS items, count(item_id) > 0 AS contaminated
        FROM documents LEFT JOIN hit USING (doc_id) GROUP BY doc_id
    """,
    "op9_chat": r"""
        WITH own(conv_id, turn, role, text) AS (
            VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
        ), rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM own
        ), safe AS (
            SELECT *, replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t'), '<|', '\p') AS body,
                   replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), '<|', '\p'), ':', '\c') AS head
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(6 + length(head) + length(body) + 8) AS BIGINT) AS formatted_chars
        FROM safe GROUP BY conv_id
    """,
    "op11_recompression": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), p AS (
            SELECT r, u.k AS k, array_to_string(w[u.k : u.k + 34], ' ') AS x FROM d, unnest(range(1, len(w) - 33)) AS u(k)
        ), again AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY x) AS c FROM p) WHERE c > 1),
        gone AS (SELECT DISTINCT r, k + u.j AS i FROM again, unnest(range(0, 35)) AS u(j)),
        words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        t AS (
            SELECT r, count(gone.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone.i IS NULL), '') AS kept
            FROM words LEFT JOIN gone USING (r, i) GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN t USING (r)
    """,
    "op12_collocations": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
                   string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
            FROM documents
        ), p AS (SELECT lang, regexp_extract_all(u.piece, '[^\x20\x09]+') AS w FROM d, unnest(pieces) AS u(piece)),
        f AS (
            SELECT lang, s.size AS size, array_to_string(w[u.i : u.i + s.size - 1], ' ') AS phrase, count(*) AS f
            FROM p, (VALUES (1), (2), (3), (4)) AS s(size), unnest(range(1, len(w) - s.size + 2)) AS u(i) GROUP BY ALL
        ), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1 AND f >= 30),
        longer AS (
            SELECT lang, array_to_string(w[u.i : u.i + s.size - 1], ' ') AS phrase, max(a) AS most
            FROM c, (VALUES (2), (3)) AS s(size), unnest(range(1, c.size - s.size + 2)) AS u(i) WHERE s.size < c.size GROUP BY ALL
        ), cut AS (
            SELECT c.lang, c.phrase, c.a, u.k AS k, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
            FROM c, unnest(range(1, c.size)) AS u(k)
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : u.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[u.k + 1 :], ' ')
        ), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (
            SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op13_fim": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
            FROM documents
        ), g AS (
            SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
                   CAST('0x' || h[17:24] AS BIGINT) % 100 AS a, CAST('0x' || h[25:32] AS BIGINT) % 100 AS b
            FROM d
        ), f AS (
            SELECT doc_id, text, n, array_to_string(u[: least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1 : greatest(x, y)], '') AS m,
                   array_to_string(u[greatest(x, y) + 1 :], '') AS s,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR a >= 50 THEN 'plain' WHEN b < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM g
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM f
    """,
}
