"""Lot addresses as people write them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelgrid.functions.shapes import let


def _present(c: Column) -> Column:
    return F.when(c != "", c)


def location_parts(text: Column) -> Column:
    """Struct (dong, main_no, sub_no, is_mountain), null when no lot number is found.

    The dong stays as written; it must end in 동 or 가.
    """
    s = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s*(일대|일원)\s*$", ""), " ", "")
    pattern = r"(?s)^(.*?)(산)?([0-9]+)(?:-([0-9]+))?$"

    def parts(v: Column) -> Column:
        return let(F.regexp_extract(v, pattern, 1), lambda dong: F.when(
            dong.endswith("동") | dong.endswith("가"),
            F.struct(
                dong.alias("dong"),
                F.regexp_extract(v, pattern, 3).try_cast("long").alias("main_no"),
                F.coalesce(F.regexp_extract(v, pattern, 4).try_cast("long"), F.lit(0)).cast("long").alias("sub_no"),
                (F.regexp_extract(v, pattern, 2) == "산").alias("is_mountain"),
            )))

    return let(s, parts)


def legal_dong(dong: Column) -> Column:
    """Administrative dong to legal dong: drop digits right before a final 동."""
    return F.regexp_replace(dong, "([0-9]+)동$", "동")


def land_class(raw: Column) -> Column:
    """Trailing Hangul of a lot text ('179-3대' gives '대')."""
    return _present(F.regexp_extract(raw, "([가-힣]+)$", 1))


def dong_of(address: Column) -> Column:
    """Last word of a legal address."""
    s = F.regexp_replace(address, r"^\s+|\s+$", "")
    return F.when(s != "", F.element_at(F.split(s, r"\s+"), -1))


def lot_parts(raw: Column) -> Column:
    """Struct (main_no, sub_no) of '179-3' or '711'."""
    pattern = r"^\s*([0-9]+)(?:-([0-9]+))?\s*$"
    return F.when(
        raw.rlike(pattern),
        F.struct(
            F.regexp_extract(raw, pattern, 1).try_cast("long").alias("main_no"),
            F.coalesce(F.regexp_extract(raw, pattern, 2).try_cast("long"), F.lit(0)).cast("long").alias("sub_no"),
        ),
    )


def address_parts(text: Column, district_codes: dict[str, str]) -> Column:
    """Struct (sigungu, dong, legal, main_no, sub_no, error) of a full lot address.

    ``error`` names why an address was refused and is null for a usable one.
    """
    s = F.regexp_replace(F.trim(text), r"^서울(특별시)?\s*", "")
    split = "(?s)^.*?([가-힣]+구)(.*)$"
    gu, rest = F.regexp_extract(s, split, 1), F.trim(F.regexp_extract(s, split, 2))
    codes = F.create_map(*[F.lit(v) for kv in district_codes.items() for v in kv])
    code = F.try_element_at(codes, gu)
    road = rest.rlike(r"(로|길)\s*[0-9]") & ~rest.rlike(r"[동가]\s*[0-9]")

    def outcome(parts: Column) -> Column:
        error = (
            F.when(code.isNull(), "unknown_district")
            .when(road, "road_address")
            .when(parts.isNull(), "unparsable_lot")
        )
        return let(error, lambda e: F.struct(
            F.when(e.isNull(), code).alias("sigungu"),
            F.when(e.isNull(), parts["dong"]).alias("dong"),
            F.when(e.isNull(), legal_dong(parts["dong"])).alias("legal"),
            F.when(e.isNull(), parts["main_no"]).alias("main_no"),
            F.when(e.isNull(), parts["sub_no"]).alias("sub_no"),
            e.alias("error"),
        ))

    return let(location_parts(rest), outcome)
