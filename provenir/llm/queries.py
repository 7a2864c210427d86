"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embeddup, fim, htmltext, langid, ngramjoin, prefixtrie, substrings, topk, toxicity, urlfilter, warc
from ..cluster import spread
from .common import table

#: Contract of op5: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, a small table on all cores."""
    return spread(table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.near_duplicates(table(spark, sf_dir, "embeddings"))


def vocabulary_path() -> str:
    """The vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary_path())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.link_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = langid.remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, score_into="score").select("doc_id", "held_out", "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    held_out = langid.remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, into="score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"), shared="n_shared").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.numbered(table(spark, sf_dir, "conversations")), every=5, most=9))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(topk.index(vectors), vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.restore(fim.transform(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fim"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return done.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", sha("fim.output").alias("output_sha256"), sha("restored.text").alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_bpe": op3_bpe,
    "op4_warc": op4_warc,
    "op5_url_filter": op5_url_filter,
    "op6_ngram_join": op6_ngram_join,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_html_text": op10_html_text,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_topk_search": op12_topk_search,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark),
        sized AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM items WHERE len(ws) > 0),
        grams AS (SELECT DISTINCT k, array_to_string(ws[i:i + k - 1], ' ') AS gram, item_id FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM sized)),
        docs AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
        sizes AS (SELECT DISTINCT k FROM sized),
        places AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, sizes)),
        found AS (SELECT r, i, k, item_id FROM places JOIN grams USING (k, gram)),
        covered AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS w FROM found) GROUP BY r),
        named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM found GROUP BY r)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY payload) AS kept FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> kept THEN kept END AS refers_to
        FROM d""",
    "op5_url_filter": rf"""
        WITH RECURSIVE rules(rhost, rpath, said) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
        tags AS (SELECT url AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages),
        raw AS (SELECT a, replace(CASE WHEN regexp_matches(tag, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                     WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END, '&amp;', '&') AS t FROM tags),
        edges AS (SELECT a, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(a, '^[^:/?#]*:') || t WHEN starts_with(t, '/') THEN regexp_extract(a, '^[^:/?#]*://[^/?#]*') || t END AS b FROM raw),
        links AS (SELECT a, b FROM edges WHERE b <> '' AND a <> b UNION SELECT b, a FROM edges WHERE b <> '' AND a <> b),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT a FROM links)),
        parts AS (SELECT url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_AZ}), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM urls),
        fits AS (SELECT url, rhost || rpath AS rule, said, row_number() OVER (PARTITION BY url ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, said) AS k
                 FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
        best AS (SELECT url, rule, said FROM fits WHERE k = 1),
        class AS (SELECT r.a AS url, bool_or(said = 'allow') AS allows, bool_or(said = 'block') AS blocks FROM (SELECT a, b FROM reach UNION SELECT a, a FROM links) r LEFT JOIN best ON best.url = r.b GROUP BY r.a)
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(said, CASE WHEN allows THEN 'allow' WHEN blocks THEN 'block' ELSE 'allow' END) AS verdict
        FROM pages LEFT JOIN parts USING (url) LEFT JOIN best USING (url) LEFT JOIN class USING (url)""",
}
SQL |= {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        ok AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM v
               WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_dot_product(a.u, b.u) >= 0.9),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept
        FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op6_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        place AS (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0),
        sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM place),
        size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id FROM w LEFT JOIN size USING (doc_id) LEFT JOIN c ON c.a = w.doc_id""",
}

#: CRC-32 of the decimal digits of a number, a bit at a time.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, d: list_reduce(list_prepend(xor(c, d), list_transform(range(8), lambda z: CAST(z AS BIGINT))), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"

SQL |= {
    "op11_prefix_trie": f"""
        WITH raw AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
        named AS (SELECT c, turn, sha256(length(role) || ':' || role || t) AS d, strlen(t) AS size FROM raw),
        turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS p, d, size FROM named),
        own AS (SELECT c, max(p) AS n FROM turns GROUP BY c),
        hashed AS (SELECT c, n, c - c % 5 AS b, {_CRC.format("c")} % 9 AS h FROM own),
        convs AS (SELECT x.c, x.n, b, h, least(h, coalesce(y.n, 0)) AS taken FROM hashed x LEFT JOIN own y ON y.c = x.b),
        seq AS (SELECT convs.c, p - h + taken AS depth, d, size FROM convs JOIN turns USING (c) WHERE p > h
                UNION ALL SELECT convs.c, p, d, size FROM convs JOIN turns ON turns.c = b WHERE p <= taken),
        keyed AS (SELECT c, depth, size, sha256(array_to_string(array_agg(d) OVER (PARTITION BY c ORDER BY depth), ',')) AS k FROM seq),
        lines AS (SELECT c, depth, size, k, lag(k, 1, 'root') OVER (PARTITION BY c ORDER BY depth) AS up FROM keyed UNION ALL SELECT c, 0, 0, 'root', NULL FROM own),
        long AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends FROM lines),
        nodes AS (SELECT k, any_value(up) AS up, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ended FROM long GROUP BY k, depth),
        children AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
        full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (k)),
        totals AS (SELECT l.k, count(*) FILTER (n.n_children = 0) AS n_leaves, sum(n.saved) AS saved_tokens FROM full_nodes n JOIN lines l ON l.c = n.conv_id AND l.depth <= n.depth GROUP BY l.k)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ended) AS ends_sha256
        FROM full_nodes n JOIN totals USING (k) LEFT JOIN nodes p ON p.k = n.up""",
    "op12_topk_search": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS q FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
        ok AS (SELECT * FROM v WHERE len(list_filter(q, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        pairs AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CASE WHEN len(a.q) = 0 THEN 0 ELSE CAST(list_dot_product(a.q, b.q) AS BIGINT) END AS score FROM ok a JOIN ok b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
        SELECT * FROM ranked WHERE rank <= 10""",
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
        h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substring(x, i, 8) AS BIGINT)) AS h FROM d),
        f AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
              CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
}
