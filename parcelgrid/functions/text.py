"""Document text, number tokens, JSON inside replies, display formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelgrid import settings as S
from parcelgrid.functions.shapes import let

NUMBER = r"([0-9][0-9,]*\.?[0-9]*)"


def clean_text(text: Column) -> Column:
    """Nulls and runs of blanks to one blank, three or more line ends to two."""
    s = F.regexp_replace(text, "\\x00", " ")
    s = F.regexp_replace(s, "[ \\t\\u00a0]+", " ")
    s = F.regexp_replace(s, "\\n{3,}", "\n\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def is_scanned(text: Column, min_chars: int = S.SCAN_MIN_CHARS) -> Column:
    return F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) < min_chars


def squeeze(text: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def focus_text(text: Column, words: list[str] | None = None, *, extra: Column | None = None,
               window: int = 2, max_chars: int | None = None) -> Column:
    """Lines within ``window`` of a keyword line, gaps marked with '…'.

    Works inside one row: hits are spread to their neighbours on the line
    array, so nothing is exploded or shuffled. Without a hit the whole text is
    kept. ``max_chars`` cuts the result for readers with a limit of their own.
    """
    words = words or S.FOCUS_WORDS
    pattern = F.lit("|".join(words))

    def hit(line: Column) -> Column:
        found = F.regexp_like(line, pattern)
        return found | F.contains(line, extra) if extra is not None else found

    def near(lines: Column) -> Column:
        """Sorted line numbers to keep; empty without a hit."""
        hits = F.filter(F.transform(lines, lambda l, i: F.when(hit(l), i)), lambda i: i.isNotNull())
        last = F.size(lines) - 1
        return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(
            F.greatest(i - window, F.lit(0)), F.least(i + window, last))))))

    def joined(lines: Column) -> Column:
        def show(keep: Column) -> Column:
            marked = F.transform(keep, lambda i, k: F.concat(
                F.when((k > 0) & (F.get(keep, k - 1) < i - 1), F.lit("…\n")).otherwise(F.lit("")), F.get(lines, i)))
            return F.when(F.size(keep) > 0, F.array_join(marked, "\n")).otherwise(text)

        return let(near(lines), show)

    found = let(F.split(text, "\n"), joined)
    return found if max_chars is None else F.substring(found, 1, max_chars)


def json_in_reply(reply: Column, schema: str) -> Column:
    """First brace to last brace of a reply parsed as ``schema``; null if broken."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(body != "", body), schema, {"mode": "PERMISSIVE"})


def value_token(raw: Column) -> Column:
    """First number of a text, commas dropped."""
    hit = F.regexp_extract(raw, NUMBER, 1)
    return F.when(hit != "", F.regexp_replace(hit, ",", ""))


def number_tokens(text: Column) -> Column:
    """Sorted distinct numbers of a text without commas, '%' and final dots."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*\.?[0-9]*%?)"), F.lit(1))
    bare = F.transform(found, lambda t: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(t, ",", ""), "%$", ""), r"\.+$", ""))
    return F.array_sort(F.array_distinct(bare))


def naturalize(text: Column) -> Column:
    """Spaced long dashes and spaced middle dots become sentence ends."""
    s = F.regexp_replace(text, r"\s+—\s+", ". ")
    s = F.regexp_replace(s, r"\s+·\s+", ". ")
    return F.regexp_replace(s, r"\.\s*\.", ".")


def half_even(x: Column) -> Column:
    """Whole number nearest to ``x``, halves to the even one."""
    return F.bround(x, 0).cast("long")


def percent_text(x: Column) -> Column:
    return F.when(x.isNull(), "값없음").otherwise(
        F.concat(half_even(x * 100).cast("string"), F.lit("%")))


def won_text(x: Column) -> Column:
    return F.when(x.isNull(), "값없음").otherwise(F.concat(F.format_number(half_even(x), 0), F.lit("만원")))


def attribute_text(attr: str, raw: Column) -> Column:
    """Plan value with its unit; a value that already carries it stays as is."""
    unit = S.ATTRIBUTE_UNITS.get(attr, "")
    s = F.trim(F.coalesce(raw, F.lit("")))
    pattern = r"^\s*([0-9,]+(?:\.[0-9]+)?)(.*)$"
    num, rest = F.regexp_extract(s, pattern, 1), F.trim(F.regexp_extract(s, pattern, 2))
    if attr == "구역면적":
        num = F.when(num.contains("."), F.regexp_replace(num, r"\.?0+$", "")).otherwise(num)
    shown = F.concat(num, F.lit(unit), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise(""))
    keep = ~s.rlike(pattern) if not unit else s.contains(unit) | ~s.rlike(pattern)
    return F.when(keep, s).otherwise(shown)
