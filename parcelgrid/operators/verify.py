"""Checking numbers quoted in text against their source, and social signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid import settings as S
from parcelgrid.functions import text as X

REPLY_SCHEMA = ", ".join(
    f"`{a}` STRUCT<raw: STRING, label: STRING, `변경구분`: STRING, sentence: STRING>" for a in S.ATTRIBUTE_RANGES)
SIGNAL_SCHEMA = "signals ARRAY<STRUCT<type: STRING, direction: STRING, evidence: STRING>>"


def _literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])


def reply_attributes(replies: DataFrame, *, reply: str = "reply", keep: list[str] | None = None) -> DataFrame:
    """One row per (notice, attribute) from a stored reply; absent ones are not stated.

    Attributes come out as attr, raw, label, change, sentence.
    """
    keep = keep or [c for c in replies.columns if c != reply]
    parsed = replies.withColumn("_j", X.json_in_reply(F.col(reply), REPLY_SCHEMA))
    item = [F.struct(
        F.lit(a).alias("attr"), F.col(f"_j.{a}.raw").alias("raw"), F.col(f"_j.{a}.label").alias("label"),
        F.col(f"_j.{a}.변경구분").alias("change"),
        F.coalesce(F.col(f"_j.{a}.sentence"), F.lit("")).alias("sentence")) for a in S.ATTRIBUTE_RANGES]
    rows = parsed.select(*keep, F.inline(F.array(*item)))
    stated = F.coalesce(F.col("raw") != "", F.lit(False))
    return rows.withColumns({c: F.when(stated, F.col(c)) for c in ("raw", "label", "change", "sentence")})


def _cell_has(cell: Column, token: Column) -> Column:
    return F.contains(F.replace(X.squeeze(cell), F.lit(","), F.lit("")), token)


def table_provenance(label: Column, token: Column, rows: Column | None, grids: Column | None) -> Column:
    """Value and label share a column of a table, or a row of a table or text line."""
    found = F.lit(False)
    if grids is not None:
        def in_grid(grid: Column) -> Column:
            columns = F.flatten(F.transform(grid, lambda row: F.array_compact(
                F.transform(row, lambda c, j: F.when(F.contains(F.coalesce(c, F.lit("")), label), j)))))
            same_column = F.exists(grid, lambda row: F.exists(
                F.transform(row, lambda c, j: F.array_contains(columns, j) & _cell_has(c, token)), lambda ok: ok))
            same_row = F.exists(grid, lambda row: F.contains(F.array_join(row, " "), label)
                                & _cell_has(F.array_join(row, " "), token))
            return same_column | same_row

        found = found | F.coalesce(F.exists(grids, in_grid), F.lit(False))
    if rows is not None:
        found = found | F.coalesce(
            F.exists(rows, lambda r: F.contains(r, label) & _cell_has(r, token)), F.lit(False))
    return F.coalesce(found & token.isNotNull(), F.lit(False))


def verify_attributes(items: DataFrame, *, rows: str | None = None, grids: str | None = None,
                      ocr: Column | None = None) -> DataFrame:
    """Grade extracted numbers: verified, flagged, rejected or missing.

    ``items``: attr, raw, sentence, source_text. A number must stand in the
    source, lie in its plausible range and be traceable to a quoted sentence
    or a table cell. Checked against the whole source text.
    """
    token = X.value_token(F.col("raw"))
    source, sentence = X.squeeze(F.col("source_text")), X.squeeze(F.col("sentence"))
    bare = F.replace(source, F.lit(","), F.lit(""))
    label = F.coalesce(F.try_element_at(_literal_map(S.ATTRIBUTE_LABELS), F.col("attr")), F.col("attr"))
    low = F.try_element_at(_literal_map({k: v[0] for k, v in S.ATTRIBUTE_RANGES.items()}), F.col("attr"))
    high = F.try_element_at(_literal_map({k: v[1] for k, v in S.ATTRIBUTE_RANGES.items()}), F.col("attr"))
    no = F.lit(False)
    out = items.withColumns({"_token": token, "value": token.try_cast("double")}).withColumns({
        "in_source": F.coalesce(F.contains(bare, F.col("_token")), no),
        "sentence_in_source": F.coalesce((F.length(sentence) >= 8) & F.contains(source, sentence), no),
        "token_in_sentence": F.coalesce(
            F.contains(F.replace(sentence, F.lit(","), F.lit("")), F.col("_token")), no),
        "in_table": table_provenance(label, F.col("_token"), F.col(rows) if rows else None,
                                     F.col(grids) if grids else None),
        "in_range": F.coalesce(
            F.col("value").isNotNull()
            & ((F.col("value") >= low) | low.isNull()) & ((F.col("value") <= high) | high.isNull()), no),
    })
    traced = (F.col("sentence_in_source") & F.col("token_in_sentence")) | F.col("in_table")
    grade = (
        F.when(F.col("raw").isNull(), "missing")
        .when(~F.col("in_source"), "rejected")
        .when(~F.col("in_range") | ~traced, "flagged")
        .when(ocr if ocr is not None else no, S.OCR_GRADE)
        .otherwise("verified")
    )
    return out.withColumn("grade", grade).drop("_token")


def grade_counts(verified: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each grade per notice."""
    return verified.groupBy(*keys).agg(*[
        F.count(F.when(F.col("grade") == g, 1)).alias(n)
        for n, g in (("verified", "verified"), ("flagged", "flagged"), ("rejected", "rejected"),
                     ("missing", "missing"), ("ocr_review", S.OCR_GRADE))])


def unmatched_numbers(report: Column, facts: Column, caveats: Column | None = None) -> Column:
    """Numbers of a report found neither in its facts, its caveats nor among section numbers.

    ``facts`` and ``caveats`` are arrays of texts.
    """
    allowed = F.array(*[F.lit(n) for n in S.STRUCTURAL_NUMBERS])
    for source in [facts] + ([caveats] if caveats is not None else []):
        allowed = F.concat(allowed, F.flatten(F.transform(source, X.number_tokens)))
    return F.array_sort(F.array_except(X.number_tokens(report), allowed))


def social_signals(replies: DataFrame) -> DataFrame:
    """(zone_id, url, source, type, direction, evidence): signals quoted in article replies."""
    j = X.json_in_reply(F.col("reply"), SIGNAL_SCHEMA)
    return replies.select("zone_id", "url", "source", F.explode(j["signals"]).alias("_s")).select(
        "zone_id", "url", "source", "_s.type", "_s.direction", "_s.evidence")


def signal_status(zones: DataFrame, replies: DataFrame) -> DataFrame:
    """(zone_id, n_docs, n_signals, status); a zone without articles has no signal."""
    docs = replies.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_docs"))
    found = social_signals(replies).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_signals"))
    return zones.select("zone_id").distinct().join(docs, "zone_id", "left").join(found, "zone_id", "left").select(
        "zone_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("n_signals", F.lit(0)).alias("n_signals"),
        F.when(F.col("n_signals") > 0, "신호 있음").otherwise("신호 없음").alias("status"))
