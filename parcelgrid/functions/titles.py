"""Notice titles and zone names."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from parcelgrid import settings as S


def _any_word(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def clean_title(title: Column) -> Column:
    """Drop middle dots and a '?' that stands between two Hangul letters."""
    s = F.regexp_replace(title, f"[{S.MIDDLE_DOTS}]", "")
    return F.regexp_replace(s, r"(?<=[가-힣])\?(?=[가-힣])", "")


def is_designation_title(title: Column) -> Column:
    """A designation or plan decision, not a rebuild and not a later stage."""
    return (
        ~title.contains(S.REBUILD_WORD)
        & ~title.rlike(_any_word(S.LATER_STAGE_WORDS))
        & title.rlike(_any_word(S.DESIGNATION_WORDS))
    )


def is_cycle_done(title: Column) -> Column:
    return title.rlike(_any_word(S.CYCLE_DONE_WORDS))


def zone_tokens(title: Column) -> Column:
    """Sorted distinct 'region + number' tokens of a title.

    Zones listed in brackets count one by one; outside brackets only a token
    at the very start counts. The region is matched lazily so that '제' before
    a number is never swallowed.
    """
    s = F.regexp_replace(clean_title(title), " ", "")
    item = r"([가-힣]{2,4}?)제?([0-9]+)(?:,([0-9]+))?구역"

    def listed(group: Column) -> Column:
        def grab(i: int) -> Column:
            return F.regexp_extract_all(group, F.lit(item), F.lit(i))

        first = F.zip_with(grab(1), grab(2), lambda r, n: F.concat(r, n))
        second = F.zip_with(grab(1), grab(3), lambda r, n: F.when(n != "", F.concat(r, n)))
        return F.concat(first, second)

    brackets = F.regexp_extract_all(s, F.lit(r"[(（]([^)）]*)[)）]"), F.lit(1))
    lead = r"^([가-힣]{2,4}?)제?([0-9]+)"
    head = F.concat(F.regexp_extract(s, lead, 1), F.regexp_extract(s, lead, 2))
    every = F.concat(F.flatten(F.transform(brackets, listed)), F.array(F.when(head != "", head)))
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def region_of(token: Column) -> Column:
    """Region part of a token, one final 동 or 가 dropped while two letters remain."""
    r = F.regexp_extract(token, "^([가-힣]+)", 1)
    cut = F.regexp_replace(r, "(동|가)$", "")
    return F.when(F.length(cut) >= 2, cut).otherwise(r)


def promotion_parent(title: Column) -> Column:
    """First known promotion district inside a promotion title."""
    s = clean_title(title)
    hits = F.filter(F.array(*[F.lit(p) for p in S.PROMOTION_PARENTS]), lambda p: F.contains(s, p))
    return F.when(s.contains(S.PROMOTION_WORD), F.get(hits, F.lit(0)))


def norm_zone_name(name: Column) -> Column:
    """Zone name without spaces, '제' before digits, and project suffixes."""
    s = F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", "")
    s = F.regexp_replace(s, "제([0-9])", "$1")
    return F.regexp_replace(s, f"({_any_word(S.ZONE_SUFFIX_WORDS)})", "")


def zone_name_in_title(title: Column) -> Column:
    """'XX제N구역' found in a title, else the whole title."""
    t = F.coalesce(title, F.lit(""))
    hit = F.regexp_extract(t, "([가-힣]+제?[0-9]+구역)", 1)
    return F.when(hit != "", hit).otherwise(t)


def name_core(name: Column) -> Column:
    """'region + number' of a name, preferring a number followed by 구역."""
    t = F.coalesce(name, F.lit(""))

    def grab(p: str) -> Column:
        return F.concat(F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2))

    strict, loose = r"([가-힣]{2,}?)제?\s*([0-9]+)\s*구역", r"([가-힣]{2,}?)제?\s*([0-9]+)"
    return F.when(t.rlike(strict), grab(strict)).otherwise(grab(loose))


def notice_number(text: Column) -> Column:
    hit = F.regexp_extract(text, "([0-9]{4}-[0-9]+)", 1)
    return F.when(hit != "", hit)


def notice_date(text: Column) -> Column:
    """Digits of a date text, at most YYYYMMDD."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", ""), 1, 8)


def holdout_key(title: Column, sigungu: Column) -> Column:
    """(district, region, number) key text used by the holdout-bias report."""
    s = F.coalesce(title, F.lit(""))
    for w in S.HOLDOUT_NOISE_WORDS:
        s = F.replace(s, F.lit(w), F.lit(""))
    s = F.replace(F.replace(s, F.lit("제"), F.lit("")), F.lit(" "), F.lit(""))
    p = "([가-힣]{2,}?)([0-9]+)"
    return F.when(
        s.rlike(p), F.concat_ws("|", sigungu, F.regexp_extract(s, p, 1), F.regexp_extract(s, p, 2))
    )


def sortable_date(d: Column) -> Column:
    """Date text padded so that a bare year sorts as its first day."""
    ten = F.substring(d, 1, 10)
    return F.when(F.length(ten) >= 10, ten).otherwise(F.concat(F.substring(ten, 1, 4), F.lit("-01-01")))


def dong_base(address: Column) -> Column:
    """Leading Hangul of an address's last word, before 동, 가, 로, 길 or a digit."""
    last = F.element_at(F.split(F.trim(address), r"\s+"), -1)
    hit = F.regexp_extract(last, "^([가-힣]+?)(?:동|[0-9]|가|로|길|$)", 1)
    return F.when(hit != "", hit)
