"""The registered queries of the operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfdelta.llm import (binary_packing, bwt_dedup, ecoc_langid, filter_audit, fingerprints, jaccard_join, link_trust, prefix_bpe, quality_classifier,
                            quality_table, source_divergence, warc_store, window_doubling)
from shelfdelta.session import staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(digest, {at}, 5))::BIGINT >> {shift}) & 31)::INT, 1)"
    for at in range(1, 41, 5) for shift in (15, 10, 5, 0))


@query(f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
         r AS (SELECT digest, max(page_id) AS original FROM p GROUP BY digest)
    SELECT page_id, octet_length(payload) AS payload_bytes, {_BASE32_SQL} AS payload_digest,
           CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> original THEN original END AS refers_to
    FROM p JOIN r USING (digest)""")
def op1_warc_store(spark: SparkSession, sf: str) -> DataFrame:
    """All pages archived, read back, and described from the restored records."""
    path = staging_path(spark, "llm-warc")
    warc_store.ingest(table(spark, sf, "pages"), path)
    field = warc_store.header_field
    back = warc_store.restore(spark, path)
    refers = F.regexp_extract(field("WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1)
    return back.select(F.col("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
                       warc_store.base32_of_hex(F.sha1("payload")).alias("payload_digest"), field("WARC-Type").alias("record_type"),
                       F.when(field("WARC-Type") == "revisit", refers.cast("long")).alias("refers_to"))


@query()
def op2_binary_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers as known

    pieces = binary_packing.pack(table(spark, sf, "documents"), known.path("byte_bpe_50k.json"), known.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op3_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.with_neighbours(table(spark, sf, "documents"))


@query()
def op4_prefix_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers as known

    path = known.path("byte_bpe_50k.tiktoken")
    coded = prefix_bpe.decode(prefix_bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), path, known.PATTERN), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("bytes", 256).alias("decoded_sha256"))


_STOPS_SQL = ", ".join(f"'{w}'" for w in quality_table.STOP_WORDS)


@query(rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
         w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                      length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
         g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
               FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
         twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
         rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(0, 3) r(o) GROUP BY doc_id),
         m AS (SELECT w.doc_id, len(w.w) AS n_words, word_chars, n_symbols, len(lines) AS n_lines,
                      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
                      len(list_filter(w.w, lambda x: lower(x) IN ({_STOPS_SQL}))) AS n_stop
               FROM w LEFT JOIN rep USING (doc_id)),
         f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND n_words >= 50 AND word_chars / n_words BETWEEN 2.0 AND 25.0 AND n_symbols / n_words <= 0.1
               AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.3 AND n_repeat_words / n_words <= 0.5 AS kept
    FROM f""")
def op5_quality_table(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("_measure")
    judged = quality_table.measured(table(spark, sf, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                         quality_table.base_failed().alias("base_failed"), (~quality_table.base_failed() & quality_table.passes()).alias("kept"))


@query()
def op6_bwt_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return bwt_dedup.deduplicated(table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op7_ecoc_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = ecoc_langid.train(docs, ~held_out)
    return ecoc_langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


@query()
def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf, "documents"))


@query()
def op9_link_trust(spark: SparkSession, sf: str) -> DataFrame:
    return link_trust.judge(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query(r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
         g AS (SELECT doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS s
               FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
         later AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
         gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, range(0, 13) r(o)),
         word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
         kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
           sha256(coalesce(kept.t, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)""")
def op10_window_doubling(spark: SparkSession, sf: str) -> DataFrame:
    return window_doubling.deduplicated(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op11_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
    weights = quality_classifier.train(docs, labels, ~held_out)
    return quality_classifier.predict(docs, weights, name="score").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
         e AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
         w AS (SELECT part, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, doc_id > first_id AS again FROM d JOIN e USING (t)),
         good AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
                  FROM labels GROUP BY doc_id),
         m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                      CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
                      + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
                      + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END
                      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                      + CASE WHEN again THEN 16 ELSE 0 END AS mask
               FROM w LEFT JOIN good USING (doc_id)),
         c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
         f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
         o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
               WHERE length(replace(replace(replace(replace(replace('ABCDE', a.x, ''), b.x, ''), c.x, ''), d.x, ''), e.x, '')) = 0),
         s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
                      1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
                      list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i::INT, 1)) - 65))) AS earlier
               FROM o, (SELECT unnest(range(1, 6)) AS step)),
         r AS (SELECT part, filter_order, step::INT AS step, letter,
                      coalesce(sum(n) FILTER (mask & (coalesce(earlier, 0)::INT | bit) = 0), 0)::BIGINT AS kept,
                      coalesce(sum(n) FILTER (mask & coalesce(earlier, 0)::INT = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
                      coalesce(sum(n) FILTER (mask & coalesce(earlier, 0)::INT <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
                      coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                      coalesce(sum(good) FILTER (mask & coalesce(earlier, 0)::INT = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
                      coalesce(sum(toxic) FILTER (mask & coalesce(earlier, 0)::INT = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
               FROM c, s GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
    FROM r""")
def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query(r"""
    WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
         t AS (SELECT row_id, lang, source, unnest(w) AS term FROM d),
         k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
         l AS (SELECT lang, count(*) AS v, sum(n) AS n_lang FROM k GROUP BY lang),
         g AS (SELECT DISTINCT lang, source FROM d),
         c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
         s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
         p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                      1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + l.v) AS p,
                      1 + 1000000000::HUGEINT * (k.n + 1) // (l.n_lang + l.v) AS q
               FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
         f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
               FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
         r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
               UNION ALL
               SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value,
           (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
    FROM r QUALIFY part = 'pair' OR rank <= 200""")
def op13_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf, "documents"))
