"""Document text, number checks, notices and news."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid import settings as S
from parcelgrid.functions import text as X
from parcelgrid.operators import verify as V
from parcelgrid.plans.assess import report_text, user_caveats
from parcelgrid.queries.registry import big, query
from parcelgrid.standins import Tables


@query("B32_clean_and_scan", r"""
SELECT doc_id, length(trim(c, chr(32) || chr(10))) AS n_clean, md5(trim(c, chr(32) || chr(10))) AS digest, length(trim(text, chr(32) || chr(10))) < 200 AS scanned
FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text || chr(9) || ' x', '[ \t\x{00a0}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS c FROM documents)
""")
def b32_clean(t: Tables):
    d = t.source("documents").select("doc_id", "text", X.clean_text(F.concat("text", F.lit("\t x"))).alias("c"))
    return d.select(big("doc_id").alias("doc_id"), big(F.length("c")).alias("n_clean"), F.md5("c").alias("digest"),
                    X.is_scanned(F.col("text")).alias("scanned"))


@query("B32_focus_windows", r"""
, hits AS (SELECT doc_id, i FROM lines WHERE line LIKE '%tion%' OR line LIKE '%ou qu%'),
keep AS (SELECT DISTINCT l.doc_id, l.i, l.line FROM lines l JOIN hits h ON l.doc_id = h.doc_id AND l.i BETWEEN h.i - 2 AND h.i + 2),
marked AS (SELECT doc_id, i, CASE WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY i) < i - 1 THEN '…' || chr(10) ELSE '' END || line AS s FROM keep),
joined AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY i) AS f FROM marked GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(f, text)) AS digest, length(coalesce(f, text)) AS n
FROM documents d LEFT JOIN joined USING (doc_id)""")
def b32_focus(t: Tables):
    f = X.focus_text(F.col("text"), ["tion", "ou qu"])
    d = t.source("documents").select(big("doc_id").alias("doc_id"), f.alias("f"))
    return d.select("doc_id", F.md5("f").alias("digest"), big(F.length("f")).alias("n"))


from parcelgrid.queries.registry import ORACLES  # noqa: E402

ORACLES["B32_focus_windows"] = (
    "WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line"
    " FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))" + ORACLES["B32_focus_windows"])


@query("B33_json_in_reply", """
SELECT event_id, CAST(CASE WHEN event_id % 7 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS DOUBLE) AS k FROM events""")
def b33(t: Tables):
    e = t.source("events").selectExpr(
        "event_id", "CASE WHEN event_id % 7 = 0 THEN '```json {broken' ELSE 'noise ' || props || ' end' END AS reply")
    return e.select(big("event_id").alias("event_id"), X.json_in_reply(F.col("reply"), "k BIGINT")["k"].cast("double").alias("k"))


NUMBERS = r"list_transform(regexp_extract_all({x}, '[0-9][0-9,]*\.?[0-9]*%?'), lambda v: rtrim(rtrim(replace(v, ',', ''), '%'), '.'))"


@query("B34_number_tokens", f"""
SELECT doc_id, array_to_string(list_sort(list_distinct({NUMBERS.format(x='text')})), ' ') AS numbers,
 replace(regexp_extract(text, '[0-9][0-9,]*\\.?[0-9]*'), ',', '') AS first_number FROM documents""")
def b34(t: Tables):
    return t.source("documents").select(
        big("doc_id").alias("doc_id"), F.array_join(X.number_tokens(F.col("text")), " ").alias("numbers"),
        F.coalesce(X.value_token(F.col("text")), F.lit("")).alias("first_number"))


@query("B36_naturalize", r"""
SELECT doc_id, md5(regexp_replace('가' || '. ' || '나' || '. ' || '다·라 ' || text, '\.\s*\.', '.', 'g')) AS digest FROM documents""")
def b36(t: Tables):
    s = F.concat(F.lit("가 — 나  · 다·라 "), F.col("text"))
    return t.source("documents").select(big("doc_id").alias("doc_id"), F.md5(X.naturalize(s)).alias("digest"))


def _claims(t: Tables):
    """A number claimed about every document, with a quoted sentence."""
    return t.source("documents").selectExpr(
        "doc_id", "text AS source_text",
        "CASE doc_id % 4 WHEN 0 THEN '용적률' WHEN 1 THEN '건폐율' WHEN 2 THEN '계획세대수' ELSE '구역면적' END AS attr",
        "CASE WHEN doc_id % 11 = 3 THEN NULL ELSE (doc_id % 90 + 10) || '.0%' END AS raw",
        "CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 30) ELSE '값은 ' || (doc_id % 90 + 10) || '.0 입니다' END AS sentence",
    ).withColumn("source_text", F.when(
        F.col("doc_id") % 2 == 0, F.concat("source_text", F.lit(" 값은 "), (F.col("doc_id") % 90 + 10).cast("string"), F.lit(".0 입니다"))
    ).otherwise(F.col("source_text")))


CLAIM_SQL = r"""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' 값은 ' || (doc_id % 90 + 10) || '.0 입니다' ELSE text END AS src,
 doc_id % 4 AS a, CASE WHEN doc_id % 11 = 3 THEN NULL ELSE (doc_id % 90 + 10) || '.0' END AS tok,
 CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 30) ELSE '값은 ' || (doc_id % 90 + 10) || '.0 입니다' END AS sent FROM documents),
n AS (SELECT doc_id, a, tok, regexp_replace(src, '\s+', '', 'g') AS s, regexp_replace(sent, '\s+', '', 'g') AS q FROM c),
g AS (SELECT doc_id, a, tok, contains(replace(s, ',', ''), tok) AS in_source,
 length(q) >= 8 AND contains(s, q) AND contains(replace(q, ',', ''), tok) AS traced,
 CASE a WHEN 0 THEN CAST(tok AS DOUBLE) BETWEEN 50 AND 600 WHEN 1 THEN CAST(tok AS DOUBLE) BETWEEN 20 AND 80
  ELSE CAST(tok AS DOUBLE) >= 1 END AS in_range FROM n),
v AS (SELECT doc_id, a, CASE WHEN tok IS NULL THEN 'missing' WHEN NOT in_source THEN 'rejected'
 WHEN NOT in_range OR NOT traced THEN 'flagged' ELSE 'verified' END AS grade FROM g)
"""


@query("V1_verify_attribute", CLAIM_SQL + "SELECT doc_id, grade FROM v")
def v1(t: Tables):
    return V.verify_attributes(_claims(t)).select(big("doc_id").alias("doc_id"), "grade")


@query("V2_table_provenance", """
SELECT doc_id, doc_id % 4 IN (0, 1) AS in_grid, doc_id % 5 < 2 AS in_row FROM documents""")
def v2(t: Tables):
    k = F.col("doc_id").cast("string")
    cell = F.concat(k, F.lit(".5 %"))
    grid = F.expr("doc_id % 4")
    table = (
        F.when(grid == 0, F.array(F.array(F.lit("구분"), F.lit("용적률(%)")), F.array(F.lit("변경"), cell)))
        .when(grid == 1, F.array(F.array(F.lit("용적률"), F.lit("비고"), cell)))
        .when(grid == 2, F.array(F.array(F.lit("용적률"), F.lit("비고")), F.array(F.lit("-"), cell)))
        .otherwise(F.array(F.array(F.lit("면적")), F.array(cell))))
    row = F.when(F.col("doc_id") % 5 < 2, F.array(F.concat(F.lit("용적률 "), cell))).otherwise(F.array(F.lit("용적률 없음"), cell))
    token = F.concat(k, F.lit(".5"))
    d = t.source("documents").select("doc_id", F.array(table).alias("g"), row.alias("r"), token.alias("tok"))
    label = F.lit("용적률")
    return d.select(big("doc_id").alias("doc_id"),
                    V.table_provenance(label, F.col("tok"), None, F.col("g")).alias("in_grid"),
                    V.table_provenance(label, F.col("tok"), F.col("r"), None).alias("in_row"))


@query("V3_grade_counts", CLAIM_SQL + """
SELECT lang, count(*) FILTER (grade = 'verified' AND doc_id % 8 <> 0) AS verified, count(*) FILTER (grade = 'flagged') AS flagged,
 count(*) FILTER (grade = 'rejected') AS rejected, count(*) FILTER (grade = 'missing') AS missing,
 count(*) FILTER (grade = 'verified' AND doc_id % 8 = 0) AS ocr_review FROM v JOIN documents USING (doc_id) GROUP BY lang""")
def v3(t: Tables):
    graded = V.verify_attributes(_claims(t), ocr=F.col("doc_id") % 8 == 0)
    return V.grade_counts(graded.join(t.source("documents").select("doc_id", "lang"), "doc_id"), ["lang"])


@query("V4_reply_attributes", """
SELECT event_id, a.attr, CASE WHEN a.i = event_id % 4 THEN (event_id % 300) || '%' END AS raw,
 CASE WHEN a.i = event_id % 4 THEN '문장 ' || event_id END AS sentence
FROM events, (VALUES (0, '용적률'), (1, '건폐율'), (2, '계획세대수'), (3, '구역면적')) a(i, attr)""")
def v4(t: Tables):
    attrs = "CASE event_id % 4 WHEN 0 THEN '용적률' WHEN 1 THEN '건폐율' WHEN 2 THEN '계획세대수' ELSE '구역면적' END"
    e = t.source("events").selectExpr(
        "event_id", f"'```json {{\"' || {attrs} || '\": {{\"raw\": \"' || (event_id % 300) || '%\", \"label\": \"x\", \"sentence\": \"문장 '"
        " || event_id || '\"}, \"other\": \"미기재\"} ```' AS reply")
    return V.reply_attributes(e).select(big("event_id").alias("event_id"), "attr", "raw", "sentence")


@query("V5_unmatched_numbers", f"""
WITH d AS (SELECT doc_id, text || ' 12345 7 3' AS report, text AS fact FROM documents),
n AS (SELECT doc_id, {NUMBERS.format(x='report')} AS r, {NUMBERS.format(x='fact')} AS f FROM d)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(r, lambda v: NOT list_contains(f, v)
 AND v NOT IN ('1', '2', '3', '4', '5')))), ' ') AS unmatched FROM n""")
def v5(t: Tables):
    d = t.source("documents")
    u = V.unmatched_numbers(F.concat("text", F.lit(" 12345 7 3")), F.array("text"))
    return d.select(big("doc_id").alias("doc_id"), F.array_join(u, " ").alias("unmatched"))


@query("V6_report_text", """
SELECT event_id, '### 될까' || chr(10) || '산출 불가' || CASE WHEN event_id % 3 = 0 THEN '. 노후 ' || event_id || '%' ELSE '' END
 || CASE WHEN event_id % 2 = 0 THEN chr(10) || '### 얼마' || chr(10) || '시세 ' || event_id ELSE '' END
 || chr(10) || '### 리스크' || chr(10) || '신호 없음' AS report,
 CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_caveats FROM events""")
def v6(t: Tables):
    k = F.col("event_id").cast("string")
    none = F.lit(None).cast("string")
    given = {
        "rule_result": F.lit("산출 불가"), "old_ratio": F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("노후 "), k, F.lit("%"))),
        "price_context": F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("시세 "), k)), "social_signal": F.lit("신호 없음")}
    facts = F.struct(*[given.get(n, none).alias(n) for _, keys in S.REPORT_SECTIONS for n in keys])
    caveats = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(S.BASE_CAVEATS[3]), F.lit(S.BASE_CAVEATS[0]))).otherwise(
        F.array(F.lit(S.BASE_CAVEATS[3])))
    return t.source("events").select("event_id", facts.alias("f"), caveats.alias("c")).select(
        big("event_id").alias("event_id"), report_text(F.col("f")).alias("report"),
        big(F.size(user_caveats(F.col("c")))).alias("n_caveats"))


REPLY = ("CASE event_type WHEN 'error' THEN '```json {\"signals\": [{\"type\": \"갈등\", \"direction\": \"악재\", \"evidence\": \"e' || event_id || '\"}]} ```'"
         " WHEN 'click' THEN '{\"signals\": []}' ELSE '응답 없음' END")


def _replies(t: Tables):
    return t.source("events").selectExpr(
        "'Z' || lpad(CAST(user_id AS STRING), 7, '0') AS zone_id", "'http://n/' || event_id AS url",
        "event_type AS source", f"{REPLY} AS reply")


@query("D25_signal_status", """
WITH e AS (SELECT 'Z' || lpad(CAST(user_id AS STRING), 7, '0') AS zone_id, event_type FROM events),
z AS (SELECT 'Z' || lpad(CAST(c_custkey AS STRING), 7, '0') AS zone_id FROM customer),
g AS (SELECT zone_id, count(*) AS n_docs, count(*) FILTER (event_type = 'error') AS n FROM e GROUP BY 1)
SELECT zone_id, coalesce(n_docs, 0) AS n_docs, coalesce(n, 0) AS n_signals,
 CASE WHEN n > 0 THEN '신호 있음' ELSE '신호 없음' END AS status FROM z LEFT JOIN g USING (zone_id)""")
def d25(t: Tables):
    zones = t.source("customer").selectExpr("'Z' || lpad(CAST(c_custkey AS STRING), 7, '0') AS zone_id")
    return V.signal_status(zones, _replies(t))


@query("D25_social_signals", """
SELECT 'Z' || lpad(CAST(user_id AS STRING), 7, '0') AS zone_id, 'http://n/' || event_id AS url, 'e' || event_id AS evidence,
 '갈등' AS type FROM events WHERE event_type = 'error'""")
def d25_signals(t: Tables):
    return V.social_signals(_replies(t)).select("zone_id", "url", "evidence", "type")
