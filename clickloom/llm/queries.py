"""Registered queries of the training-data operators, with SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.backoff_lm import BackoffScorer
from clickloom.llm.decontaminate import Decontaminator
from clickloom.llm.fixity import FILE_RECORDS, FixityAudit, warc_records
from clickloom.llm.jaccard_join import JaccardJoin
from clickloom.llm.pieces_sampling import PieceSampler
from clickloom.llm.pii import PiiFinder
from clickloom.llm.prefix_trie import PrefixTrie
from clickloom.llm.quality import QualityClassifier
from clickloom.llm.spelling import SpellingVariants
from clickloom.llm.suffix_dedup import SuffixDedup
from clickloom.llm.tables import read
from clickloom.llm.token_files import TokenFiles
from clickloom.llm.topk import ThresholdSearch, quantized
from clickloom.llm.toxicity import ToxicityClassifier


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica of all pages in which some records have grown, changed or gone, as their ids say."""
    pages = read(spark, sf_dir, "pages")
    damaged = pages.where("NOT coalesce(page_id % 211 = 8, false)").withColumn(
        "html",
        F.when(F.expr("page_id % 97 = 13"), F.concat("html", F.lit(" ")))
        .when(F.expr("page_id % 89 = 7"), F.concat(F.lit("?"), F.expr("substr(html, 2)")))
        .otherwise(F.col("html")),
    )
    return FixityAudit().audit(warc_records(pages), warc_records(damaged))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PiiFinder().report(read(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TokenFiles().round_trip(read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QualityClassifier().classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Decontaminator().report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(read(spark, sf_dir, "embeddings"))
    return ThresholdSearch(k=5).search(vectors, F.expr("vec_id % 50 = 0"))


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PieceSampler().encode(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ToxicityClassifier().classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = BackoffScorer().score(read(spark, sf_dir, "documents"))
    rounded = [F.round(c, 6).alias(c) for c in ("log_score", "mean_log_score")]
    return scores.select("doc_id", "n_words", *rounded)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(width=4, percent=85).classes(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PrefixTrie().nodes(read(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SuffixDedup().report(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SpellingVariants().group(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_fixity,
        op2_pii_spans,
        op3_token_files,
        op4_quality,
        op5_decontaminate,
        op6_threshold_topk,
        op7_piece_sampling,
        op8_toxicity,
        op9_backoff_scores,
        op10_jaccard_join,
        op11_prefix_trie,
        op12_suffix_dedup,
        op13_spelling_variants,
    )
}

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a text's UTF-8 bytes, bit by bit; 3988292384 is the fixed polynomial."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda o: ('0x' || o)::BIGINT)"
    bits = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda r, k: xor(r >> 1, 3988292384 * (r & 1)), xor(c, b))"
    return f"xor(list_reduce({octets}, lambda c, b: {bits}, 4294967295::BIGINT), 4294967295)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# the other queries are tested against brute force, round trips and held-out labels in tests/llm
ORACLE: dict[str, str] = {
    "op1_warc_fixity": f"""
        WITH a AS (
            SELECT coalesce(page_id // {FILE_RECORDS}, -1) AS file, page_id AS key, coalesce(url, '') AS url,
                   coalesce(html, '') AS html
            FROM pages
        ), b AS (
            SELECT file, key, url,
                   CASE WHEN key % 97 = 13 THEN html || ' ' WHEN key % 89 = 7 THEN '?' || substr(html, 2) ELSE html END AS html
            FROM a WHERE NOT coalesce(key % 211 = 8, false)
        ), ra AS (
            SELECT file, key, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
                || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS content
            FROM a
        ), rb AS (
            SELECT file, key, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
                || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS content
            FROM b
        ), pa AS (
            SELECT file, key, strlen(content) AS length, sha256(content) AS digest,
                   coalesce(sum(strlen(content)) OVER (PARTITION BY file ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM ra
        )
        SELECT pa.file, pa.key, CASE WHEN rb.content IS NULL THEN 'missing' ELSE 'changed' END AS status,
               CAST(pa.start AS BIGINT) AS start, pa.length, pa.digest AS expected_digest, sha256(rb.content) AS found_digest
        FROM pa LEFT JOIN rb ON pa.file = rb.file AND pa.key = rb.key
        WHERE pa.digest IS DISTINCT FROM sha256(rb.content)
    """,
    "op5_decontaminate": f"""
        WITH d AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}'), []) AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w
            FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
        ), starts AS (
            SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s
            FROM b WHERE len(w) > 0
        ), wins AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g FROM starts),
        places AS (
            SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s
            FROM d, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k
        ), hits AS (
            SELECT doc_id, s, p.k, item_id
            FROM (SELECT doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g FROM places) p
            JOIN wins ON wins.k = p.k AND wins.g = p.g
        ), n AS (
            SELECT doc_id, count(DISTINCT i) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS i FROM hits) GROUP BY doc_id
        ), i AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items,
                   sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS items_sha256
            FROM hits GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
    """,
    "op6_threshold_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op9_backoff_scores": f"""
        WITH w AS (
            SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
            FROM (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents)
        ), g AS (
            SELECT doc_id, i, word, lag(word) OVER p AS w1, lag(word, 2) OVER p AS w2
            FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)
        ), c1 AS (SELECT word, count(*) AS n FROM g GROUP BY word HAVING count(*) >= 2),
        c2 AS (SELECT w1, word, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY w1, word HAVING count(*) >= 2),
        c3 AS (SELECT w2, w1, word, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY w2, w1, word HAVING count(*) >= 2),
        s AS (
            SELECT g.doc_id,
                   CASE WHEN c3.n IS NOT NULL THEN ln(c3.n / b.n)
                        WHEN c2.n IS NOT NULL THEN ln(c2.n / a.n) + ln(0.4) * (g.w2 IS NOT NULL)::INT
                        ELSE ln(coalesce(c1.n, 1) / (SELECT count(*) FROM g)) + ln(0.4) * ((g.w1 IS NOT NULL)::INT + (g.w2 IS NOT NULL)::INT)
                   END AS s
            FROM g
            LEFT JOIN c3 ON c3.w2 = g.w2 AND c3.w1 = g.w1 AND c3.word = g.word
            LEFT JOIN c2 b ON b.w1 = g.w2 AND b.word = g.w1
            LEFT JOIN c2 ON c2.w1 = g.w1 AND c2.word = g.word
            LEFT JOIN c1 a ON a.word = g.w1
            LEFT JOIN c1 ON c1.word = g.word
        ), d AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM s GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(d.n, 0) AS n_words, round(coalesce(d.s, 0), 6) AS log_score,
               round(d.s / d.n, 6) AS mean_log_score
        FROM documents LEFT JOIN d USING (doc_id)
    """,
    "op11_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                   dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS kind
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT c, list(kind ORDER BY pos) AS s, {_crc32("c::VARCHAR")} % 9 AS h, c - c % 5 AS base FROM t GROUP BY c
        ), rebuilt AS (
            SELECT own.c, list_concat(coalesce(list_slice(b.s, 1, own.h), []::BIGINT[]), list_slice(own.s, own.h + 1, len(own.s))) AS s
            FROM own LEFT JOIN own b ON b.c = own.base
        ), members AS (
            SELECT c, d, list_slice(s, 1, d) AS k, len(s) = d AS ends
            FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)
        ), n AS (
            SELECT k, d, min(c) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
            FROM members GROUP BY k, d
        ), kinds AS (SELECT DISTINCT kind, strlen(text) AS bytes FROM t),
        v AS (SELECT n.*, (n_convs - 1) * coalesce(bytes, 0) AS saved FROM n LEFT JOIN kinds ON kinds.kind = n.k[n.d]),
        links AS (SELECT p.k, x.k AS below FROM v p JOIN v x ON x.d = p.d + 1 AND list_slice(x.k, 1, p.d) = p.k),
        fan AS (SELECT k, count(*) AS n_children FROM links GROUP BY k),
        subtree AS (
            SELECT a.k, count(*) FILTER (x.n_children IS NULL) AS n_leaves, sum(x.saved) AS saved_tokens
            FROM v a JOIN (SELECT v.*, n_children FROM v LEFT JOIN fan USING (k)) x
                ON x.d >= a.d AND list_slice(x.k, 1, a.d) = a.k
            GROUP BY a.k
        )
        SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs,
               coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM v LEFT JOIN fan USING (k) JOIN subtree USING (k) LEFT JOIN links ON links.below = v.k LEFT JOIN v p ON p.k = links.k
    """,
    "op12_suffix_dedup": """
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
        ), places AS MATERIALIZED (
            SELECT r, p, hash(substr(x, 2 * p + 1, 800)) AS w1, hash(substr(x, 2 * p + 1, 800) || '.') AS w2
            FROM (SELECT r, x, unnest(range(len(x) // 2 - 399)) AS p FROM d WHERE len(x) >= 800)
        ), twice AS (SELECT w1, w2 FROM places GROUP BY w1, w2 HAVING count(*) > 1),
        starts AS (SELECT r, p FROM places SEMI JOIN twice USING (w1, w2)),
        parted AS (
            SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400, true) AS fresh FROM starts
        ), numbered AS (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM parted),
        spans AS (SELECT r, min(p) AS a, max(p) + 400 AS e FROM numbered GROUP BY r, k),
        gaps AS (
            SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS e FROM spans
            UNION ALL SELECT r, max(e), NULL FROM spans GROUP BY r
        ), kept AS (
            SELECT r, string_agg(CASE WHEN e IS NULL THEN substr(x, 2 * a + 1) ELSE substr(x, 2 * a + 1, 2 * (e - a)) END, '' ORDER BY a) AS x
            FROM gaps JOIN d USING (r) GROUP BY r
        ), lost AS (SELECT r, sum(e - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
        SELECT doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
        FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
    """,
    "op13_spelling_variants": f"""
        WITH RECURSIVE runs AS (
            SELECT DISTINCT ON (doc_id, run) doc_id, run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h
            FROM (
                SELECT doc_id, run, count(*) AS n
                FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
                WHERE length(run) >= 7 GROUP BY doc_id, run
            )
        ), w AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM (
                SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                               ELSE run END AS word
                FROM runs
            )
            WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
        ), gaps AS (
            SELECT word, n, unnest(generate_series(1, length(word))) AS k,
                   substr(word, 1, k - 1) || substr(word, k + 1) AS rest
            FROM w
        ), pairs AS (
            SELECT a.word, b.word AS near FROM gaps a JOIN gaps b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word FROM gaps a JOIN w b ON a.rest = b.word
            UNION SELECT b.word, a.word FROM gaps a JOIN w b ON a.rest = b.word
        ), best AS (
            SELECT pairs.word, CAST(count(*) AS BIGINT) AS n_near, arg_min(near, (-v.n, encode(near))) AS near, max(v.n) AS near_n
            FROM pairs JOIN w v ON v.word = near GROUP BY pairs.word
        ), forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form,
                   CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
            FROM w LEFT JOIN best ON best.word = w.word
        ), walk AS (
            SELECT word, word AS root, form FROM forms
            UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.form
        )
        SELECT forms.word, forms.form, walk.root, forms.n, n_near, form_n
        FROM forms JOIN walk ON walk.word = forms.word AND walk.form IS NULL
    """,
}
