"""One query for each corpus operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt_dedup import remove_repeated_bytes
from .decontam import contaminated
from .exact_dedup import exact_duplicates
from .hard_negatives import mine_hard_negatives
from .html_extract import main_text
from .jaccard_join import similar_components
from .langid import identify
from .line_dedup import drop_shared_lines
from .lm import score_documents
from .packing import pack_documents
from .quality import score_quality
from .substring_tree import remove_repeated_words
from .token_align import align_tokens

#: File of the public tokenizer that packing counts with.
TOKENIZER = "word_bpe_49k.json"
#: Files of the two that are aligned.
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, _table(spark, sf_dir, "documents"), tokenizer_path())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, _table(spark, sf_dir, "documents"))


def op4_substring_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(spark, _table(spark, sf_dir, "documents"), window=35)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, _table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark, _table(spark, sf_dir, "documents"), n=4, share=85)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, _table(spark, sf_dir, "documents"))


def op8_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark, _table(spark, sf_dir, "documents"), window=200)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark, _table(spark, sf_dir, "pages"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_shared_lines(spark, _table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(spark, _table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(spark, _table(spark, sf_dir, "documents"), *map(tokenizer_path, ALIGNED))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_substring_tree": op4_substring_tree,
    "op5_langid": op5_langid,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_lm": op7_lm,
    "op8_bwt_dedup": op8_bwt_dedup,
    "op9_html": op9_html,
    "op10_decontam": op10_decontam,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_align": op13_token_align,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLES = {
    "op3_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOW} AS t FROM documents)
        WINDOW g AS (PARTITION BY t)""",
    "op4_substring_tree": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        s AS (SELECT r, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS win FROM p),
        g AS (SELECT r, i, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM s),
        c AS (SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM g),
        k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.r = k.r""",
    "op6_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT r, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 3, 1) + 1) END) AS i FROM d),
        s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS sh FROM p),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        c AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.r <> b.r GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        m AS (SELECT r AS a, r AS b FROM d UNION SELECT m.a, l.b FROM m JOIN l ON l.a = m.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, o.component_id
        FROM d LEFT JOIN n ON n.r = d.r JOIN (SELECT m.a, min(e.doc_id) AS component_id FROM m JOIN d e ON e.r = m.b GROUP BY m.a) o ON o.a = d.r""",
    "op8_bwt_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
        p AS (SELECT r, t, octet_length(t) AS n, unnest(range(1, octet_length(t) + 1)) AS i FROM d),
        s AS (SELECT r, i, hex(t[i:i]) AS b, CASE WHEN i + 199 <= n THEN md5(t[i:i + 199]) END AS win FROM p),
        g AS (SELECT r, i, b, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM s),
        c AS (SELECT r, i, b, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM g),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS head FROM c),
        k AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY r)
        SELECT d.doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN k ON d.r = k.r""",
    "op11_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
        p AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        l AS (SELECT r, doc_id, i, w[i] AS line, {_LOW.replace("coalesce(text, '')", "trim(w[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM p),
        g AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(g.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.k IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN g ON g.k = l.k GROUP BY r""",
    "op12_hard_negatives": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, b.label = a.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
              FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5),
        n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.id)::INTEGER AS rank
              FROM p JOIN s ON s.anchor = p.anchor WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
