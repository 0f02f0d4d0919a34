"""The queries of this subpackage and their SQL, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, bpe, chat, common, exact_dedup, fim, html_text, lm_score, packing, pii, quality, simhash, spelling, topk

#: Where the vocabulary files lie on every machine; a parameter of the operators.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks, for the faster library.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(common.documents(spark, sf_dir), order=2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(docs, model)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(common.documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.count_sections(common.documents(spark, sf_dir), TOKENIZER)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(common.documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), TOKENIZER, RANKS)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(common.documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(common.documents(spark, sf_dir), TOKENIZER)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest_conversations(chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(common.documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest_documents(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_score, op2_quality, op3_pii, op4_token_counts, op5_html_text, op6_simhash, op7_packing, op8_top_k, op9_exact_dedup, op10_bpe,
        op11_chat_format, op12_spelling_variants, op13_fill_in_middle,
    )
}

ORACLE_SQL = {
    "op8_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
    """,
    # a turn's marks open where the role changes and close where it changes next
    "op11_chat_format": r"""
        WITH r AS (SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        p AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM r),
        e AS (SELECT *, regexp_replace(text, '(\[/?(?:INST|SYS|ROLE)|\[(?:NEXT|TEXT)|</?s)(\\*)([\]>])', '\1\\\2\3', 'g') AS shown,
            regexp_replace(role, '(\[/?(?:INST|SYS|ROLE)|\[(?:NEXT|TEXT)|</?s)(\\*)([\]>])', '\1\\\2\3', 'g') AS named FROM p),
        m AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        n AS (SELECT *, length(shown)
            + CASE WHEN NOT opens THEN 6 WHEN role = 'user' THEN 6 WHEN role = 'system' THEN 5 WHEN role = 'assistant' THEN 3 ELSE 12 + length(named) END
            + CASE WHEN NOT closes THEN 0 WHEN role = 'user' THEN 7 WHEN role = 'system' THEN 6 WHEN role = 'assistant' THEN 4 ELSE 7 END AS chars FROM m)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
        FROM n GROUP BY conv_id
    """,
    # the crc32 of a string, byte by byte from a table that the polynomial gives; words one edit apart by what deleting a letter leaves
    "op12_spelling_variants": r"""
        WITH RECURSIVE bits AS (SELECT range::UBIGINT AS i, range::UBIGINT AS v, 0 AS k FROM range(256)
            UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
        tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
        runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
        each AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
        hexed AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM each),
        hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(1, length(x), 2), lambda k: ('0x' || substr(x, k, 2))::UBIGINT),
            lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h FROM hexed, tab),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
            GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
        less AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words),
        cut AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM less),
        near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
        best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS r FROM near),
        formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.other END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n
            FROM words w LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON w.word = b.word),
        way AS (SELECT word, word AS at FROM formed UNION ALL SELECT way.word, f.form FROM way JOIN formed f ON f.word = way.at WHERE f.form IS NOT NULL),
        ends AS (SELECT way.word, way.at FROM way JOIN formed f ON f.word = way.at WHERE f.form IS NULL)
        SELECT f.word, f.form, e.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
        u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
            ('0x' || substr(x, 1, 8))::UBIGINT AS h1, ('0x' || substr(x, 9, 8))::UBIGINT AS h2, ('0x' || substr(x, 17, 8))::UBIGINT AS h3, ('0x' || substr(x, 25, 8))::UBIGINT AS h4 FROM d),
        c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b FROM u),
        s AS (SELECT doc_id, text, n, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS z,
            CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM s
    """,
}
