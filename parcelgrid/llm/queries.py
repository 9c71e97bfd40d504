"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid.llm import audit_sql
from parcelgrid.llm.registry import query, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_token_counts")
def op10(spark, folder):
    from parcelgrid.llm.token_counts import token_counts

    counts = token_counts(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op6_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)""")
def op6(spark, folder):
    from parcelgrid.llm.common import normalised
    from parcelgrid.llm.exact_dedup import exact_duplicates

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_duplicates(docs, extra={"text_sha256": F.sha2(normalised(F.col("row.text")), 256)})


@query("op1_minhash_dedup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT x AS doc_id, x AS other FROM links UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other)
SELECT doc_id, len(s) AS n_shingles, coalesce(m, doc_id) AS component_id, doc_id = coalesce(m, doc_id) AS kept
FROM sets LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) USING (doc_id)""")
def op1(spark, folder):
    from parcelgrid.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), size=3, percent=85)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
strata AS (
  SELECT source, length(bin(size)) AS width, count(*) AS n, sum(size) AS total FROM sized GROUP BY ALL),
sources AS (
  SELECT source, sum(total)::BIGINT AS s,
         list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS pos
  FROM strata GROUP BY source),
steps AS (
  SELECT *, (1.5 * sum(s) OVER () - coalesce(sum(2.0 * s) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level,
         2.0 * s / w AS stop
  FROM sources
  WINDOW before AS (ORDER BY 2.0 * s / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, s AS source_size,
         least(2.0 * s, w * (SELECT arg_min(level, (stop, pos)) FROM steps WHERE level <= stop)) AS target
  FROM steps),
placed AS (
  SELECT doc_id, size, source_size, target, width, sized.source,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         floor(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~') || '|mix'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * ceil(n / 96.0))::INT AS part
  FROM sized JOIN strata ON strata.width = length(bin(size)) AND strata.source IS NOT DISTINCT FROM sized.source
  JOIN goals ON goals.source IS NOT DISTINCT FROM sized.source),
drawn AS (
  SELECT *, rate - floor(rate) AS f,
         row_number() OVER (PARTITION BY source, width, part ORDER BY size DESC, doc_id) - 1 AS i,
         ('0x' || substr(md5(coalesce(source, '~') || '|' || width || '|' || part || '|mix'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (floor(rate) + floor(u + (i + 1) * f) - floor(u + i * f)))::BIGINT AS taken
FROM drawn"""


@query("op2_source_mix", MIX_SQL)
def op2(spark, folder):
    from parcelgrid.llm.mixing import drawn, word_count

    docs = table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return drawn(docs, size=F.col("words")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op5_packing")
def op5(spark, folder):
    from parcelgrid.llm.packing import packed

    return packed(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"), end=2,
                  digest={"ids_crc32": F.crc32}, with_ids=False)


@query("op7_language_mixture")
def op7(spark, folder):
    from parcelgrid.llm import language as L

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", L.held_out().alias("held_out"))
    model = L.trained(L.language_counts(docs.where("NOT held_out")))
    docs = docs.withColumn("_id", F.struct("doc_id", "held_out"))
    return L.languages(docs, model, key="_id").select("_id.*", "lang_pred", "score", "langs")


# The pages of this table hold one article each, and no references but those below.
@query("op9_host_consensus_text", r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS t FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
d AS (SELECT page_id, url, regexp_replace(replace(t, '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM t),
x AS (SELECT page_id, url, trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS text FROM d)
SELECT page_id, url, text, length(text) AS n_chars FROM x""")
def op9(spark, folder):
    from parcelgrid.llm.html_text import extracted

    texts = extracted(table(spark, folder, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


@query("op4_suffix_repetition")
def op4(spark, folder):
    from parcelgrid.llm.repetition import repetition

    return repetition(table(spark, folder, "documents"))


@query("op3_site_quality")
def op3(spark, folder):
    from parcelgrid.llm.site_quality import classified

    docs = table(spark, folder, "documents").select("doc_id", "text", "source", F.col("lang").alias("path"))
    return classified(docs, table(spark, folder, "labels"), host="source", path="path")


@query("op8_chat_repair")
def op8(spark, folder):
    from parcelgrid.llm.chat import repaired

    return repaired(table(spark, folder, "conversations"))


@query("op11_minimax_shards", audit_sql.SHARDS)
def op11(spark, folder):
    from parcelgrid.llm.shards import sharded

    return sharded(table(spark, folder, "documents"), shards=16)


@query("op12_source_divergence", audit_sql.DIVERGENCE)
def op12(spark, folder):
    from parcelgrid.llm.divergence import audited

    return audited(table(spark, folder, "documents"), least_docs=10, top=10)


@query("op13_phrase_collocations", audit_sql.PHRASES)
def op13(spark, folder):
    from parcelgrid.llm.phrases import collocations

    return collocations(table(spark, folder, "documents"), longest=3, least=10, top=2000)
