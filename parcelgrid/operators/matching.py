"""Address, notice and zone matching. No match is preferred to a wrong match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid import settings as S
from parcelgrid.functions import address as A, titles as N
from parcelgrid.functions.ids import district_of
from parcelgrid.operators.keyed import match_left

LOT_KEY = ["sigungu", "dong", "main_no", "sub_no"]


def lot_index(parcels: DataFrame) -> DataFrame:
    """(sigungu, dong, main_no, sub_no) to pnu; ordinary lots win over mountain lots."""
    lot = A.lot_parts(F.col("jibun"))
    keyed = parcels.select(
        "pnu", "sigungu", A.dong_of(F.col("dong_addr")).alias("dong"),
        lot["main_no"].alias("main_no"), lot["sub_no"].alias("sub_no"),
    ).where(F.col("dong").isNotNull() & F.col("main_no").isNotNull())
    return keyed.groupBy(*LOT_KEY).agg(
        F.min_by("pnu", F.struct(F.substring("pnu", 11, 1) == "2", F.col("pnu"))).alias("pnu"))


def lot_lookup(rows: DataFrame, index: DataFrame, *, out: str = "pnu") -> DataFrame:
    """Attach ``out`` by the dong as written, else by its legal form.

    ``rows`` carry sigungu, dong, main_no and sub_no. ``by_legal`` tells which
    rows the second look-up recovered.
    """
    first = index.select(*LOT_KEY, F.col("pnu").alias("_p1"))
    second = index.select("sigungu", F.col("dong").alias("_legal"), "main_no", "sub_no", F.col("pnu").alias("_p2"))
    legal = A.legal_dong(F.col("dong"))
    hit = match_left(rows.withColumn("_legal", F.when(legal != F.col("dong"), legal)), first, LOT_KEY)
    # Only what the first look-up missed goes on to the second.
    hit = hit.withColumn("_legal", F.when(F.col("_p1").isNull(), F.col("_legal")))
    hit = match_left(hit, second, ["sigungu", "_legal", "main_no", "sub_no"])
    return hit.select(
        *rows.columns,
        F.coalesce("_p1", "_p2").alias(out),
        (F.col("_p1").isNull() & F.col("_p2").isNotNull()).alias("by_legal"),
    )


def locate(rows: DataFrame, index: DataFrame, location: Column, *, out: str = "pnu") -> DataFrame:
    """Parse a location text of rows that carry ``sigungu`` and look it up.

    Each distinct text of a district is parsed and looked up once, whatever the
    number of rows that carry it; one join brings the answers back.
    """
    text = rows.withColumn("_text", location)
    distinct = text.select("sigungu", "_text").where("sigungu IS NOT NULL AND _text IS NOT NULL").distinct()
    # Parsed once into a column of its own; its fields are only read from there.
    parsed = distinct.withColumn("_loc", A.location_parts(F.col("_text"))).withColumns(
        {c: F.col(f"_loc.{c}") for c in ("dong", "main_no", "sub_no")}).drop("_loc")
    found = lot_lookup(parsed, index, out=out)
    return match_left(text, found, ["sigungu", "_text"]).drop("_text").withColumn("by_legal", F.coalesce("by_legal", F.lit(False)))


def scoped_lookup(addresses: DataFrame, detail: DataFrame, wide: DataFrame,
                  district_codes: dict[str, str], *, known: DataFrame | None = None,
                  text: str = "address") -> DataFrame:
    """Addresses plus pnu, scope ('full' / 'partial') and error.

    A 19-digit input is taken as the id itself; it is 'full' when the detail
    scope knows it. Other texts are looked up in the detail index first and in
    the wide one second.
    """
    base = addresses.columns
    s = F.trim(F.col(text))
    rows = addresses.withColumn("_p", A.address_parts(F.col(text), district_codes)).withColumns({
        "_given": F.when(s.rlike("^[0-9]{19}$"), s),
        **{c: F.col(f"_p.{c}") for c in LOT_KEY}, "_error": F.col("_p.error"),
    }).drop("_p")
    rows = lot_lookup(rows, detail, out="_full").drop("by_legal")
    rows = lot_lookup(rows, wide, out="_wide").drop("by_legal")
    inside = (known if known is not None else detail).select(F.col("pnu").alias("_given")).distinct()
    rows = match_left(rows, inside.withColumn("_in", F.lit(True)), ["_given"])
    given = F.col("_given").isNotNull()
    pnu = F.coalesce("_given", "_full", "_wide")
    return rows.select(
        *base,
        pnu.alias("pnu"),
        F.when(given & F.col("_in"), "full").when(given, "partial")
        .when(F.col("_full").isNotNull(), "full").when(F.col("_wide").isNotNull(), "partial").alias("scope"),
        F.when(given, F.lit(None).cast("string")).when(F.col("_error").isNotNull(), F.col("_error"))
        .when(pnu.isNull(), "lot_not_found").alias("error"),
    )


def resolve_notices(targets: DataFrame, index: DataFrame) -> DataFrame:
    """Notice url by number, then date if it narrows, then name core.

    ``targets``: target_id, number, date, zone_name; ``index``: number, date,
    url, title. With a name only an equal name counts; without one only a
    single remaining row does.
    """
    t = targets.select(
        "target_id", N.notice_number(F.col("number")).alias("number"),
        N.notice_date(F.col("date")).alias("_date"), N.name_core(F.col("zone_name")).alias("_core"),
    )
    i = index.select("number", F.col("date").alias("_idate"), "url", "title",
                     N.name_core(F.col("title")).alias("_icore"))
    # The index is summed up per key first, so each target meets one row however many notices share its number.
    row = F.struct("url", "title")
    least = F.min(row)
    every = i.groupBy("number").agg(F.count("url").alias("_n"), F.min_by(row, F.when(F.col("url").isNotNull(), row)).alias("_any"))
    dated = i.where("_idate <> ''").groupBy("number", F.col("_idate").alias("_date")).agg(
        F.count(F.lit(1)).alias("_nd"), least.alias("_on_date"))
    cores = i.where("_icore <> ''")
    named = cores.groupBy("number", F.col("_icore").alias("_core")).agg(least.alias("_name"))
    both = cores.where("_idate <> ''").groupBy("number", F.col("_icore").alias("_core"), F.col("_idate").alias("_date")).agg(
        least.alias("_name_date"))
    seen = t
    for summed, keys in ((every, ["number"]), (dated, ["number", "_date"]), (named, ["number", "_core"]),
                         (both, ["number", "_core", "_date"])):
        seen = match_left(seen, summed, keys)
    seen = seen.withColumns({"_n": F.coalesce("_n", F.lit(0)), "_nd": F.coalesce("_nd", F.lit(0))})
    narrowed = F.col("_nd") > 0
    with_name = F.when(narrowed, F.col("_name_date")).otherwise(F.col("_name"))
    only = F.when(narrowed & (F.col("_nd") == 1), F.col("_on_date")).when(
        ~narrowed & (F.col("_n") == 1), F.col("_any"))
    pick = F.when(F.col("_core") != "", with_name).otherwise(only)
    return seen.withColumn("_pick", pick).select(
        "target_id", "number", F.col("_pick.url").alias("url"), F.col("_pick.title").alias("matched_title"),
        F.when(F.col("_pick").isNull(), "none").when(F.col("_core") != "", "high").otherwise("mid").alias("confidence"),
    )


def resolve_store(store: DataFrame, context: DataFrame) -> DataFrame:
    """Store entries mapped to context zones.

    ``store``: zone_id, zone_name; ``context``: zone_id, title. Equal ids are
    'high'; else a name that is equal after normalising and unique in the
    district is 'mid'; otherwise the reason is kept.
    """
    s = store.select(F.col("zone_id").alias("store_id"), "zone_name",
                     district_of(F.col("zone_id")).alias("_gu"),
                     N.norm_zone_name(F.col("zone_name")).alias("_name"))
    direct = context.select(F.col("zone_id").alias("store_id"), F.col("zone_id").alias("_direct")).distinct()
    named = (
        context.select(
            district_of(F.col("zone_id")).alias("_gu"),
            N.norm_zone_name(N.zone_name_in_title(F.col("title"))).alias("_name"), "zone_id")
        .where(F.col("_name") != "").distinct()
        .groupBy("_gu", "_name").agg(F.count(F.lit(1)).alias("_n"), F.min("zone_id").alias("_cand"))
    )
    joined = s.join(direct, "store_id", "left").join(named, ["_gu", "_name"], "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    high, mid = F.col("_direct").isNotNull(), n == 1
    return joined.select(
        "store_id", "zone_name",
        F.when(high, F.col("_direct")).when(mid, F.col("_cand")).alias("zone_id"),
        F.when(high, "high").when(mid, "mid").otherwise("none").alias("confidence"),
        F.when(high | mid, F.lit(None).cast("string")).when(n > 1, "several").otherwise("no_match").alias("reason"),
        F.when(high, F.lit(1)).otherwise(n).cast("long").alias("n_candidates"),
    )


def dong_districts(parcels: DataFrame) -> DataFrame:
    """(base, sigungu): districts in which a dong name occurs, one row per pair."""
    return parcels.select(N.dong_base(F.col("dong_addr")).alias("base"), "sigungu").where(
        F.col("base").isNotNull()).distinct()


def title_events(notices: DataFrame, districts: DataFrame) -> DataFrame:
    """Decision notices as (sigungu, token, date, title, designates, done) rows."""
    d = notices.where(F.col("kind").contains("결정")).select(
        "title", F.substring("date", 1, 10).alias("date"),
        N.is_designation_title(F.col("title")).alias("designates"),
        N.is_cycle_done(F.col("title")).alias("done"),
        F.explode(N.zone_tokens(F.col("title"))).alias("token"),
    ).where(F.col("designates") | F.col("done"))
    return d.withColumn("base", N.region_of(F.col("token"))).join(districts, "base").drop("base")


def first_decisions(events: DataFrame) -> DataFrame:
    """(sigungu, token, date, title): first designation after the last finished cycle."""
    keys = ["sigungu", "token"]
    last = events.groupBy(*keys).agg(F.max(F.when(F.col("done"), F.col("date"))).alias("_done"))
    live = events.where("designates").join(last, keys).where(
        F.col("_done").isNull() | (F.col("date") > F.col("_done")))
    first = live.groupBy(*keys).agg(F.min(F.struct("date", "title")).alias("_f"))
    return first.select(*keys, "_f.date", "_f.title")


def promotion_dates(notices: DataFrame) -> DataFrame:
    """(parent, date, title): first promotion decision of each parent district."""
    s = N.clean_title(F.col("title"))
    hits = F.filter(F.array(*[F.lit(p) for p in S.PROMOTION_PARENTS]), lambda p: F.contains(s, p))
    rows = notices.where(
        F.col("kind").contains("결정") & N.is_designation_title(F.col("title")) & s.contains(S.PROMOTION_WORD)
    ).select(F.explode(hits).alias("parent"), F.substring("date", 1, 10).alias("date"), "title")
    return rows.groupBy("parent").agg(F.min(F.struct("date", "title")).alias("_f")).select(
        "parent", "_f.date", "_f.title")


def contained_names(zones: DataFrame, names: DataFrame) -> DataFrame:
    """(zone_id, date) where a listed name of the same district occurs in the zone title.

    Joined on the first letters of the name against the letter runs of the
    title, so a district's names are not compared with all its titles.
    """
    n = names.select(
        "sigungu", F.replace(F.col("name"), F.lit("일대"), F.lit("")).alias("_name"), "date"
    ).where(F.col("_name") != "").withColumn("_gram", F.substring("_name", 1, 3))
    t = zones.select("zone_id", "sigungu", F.regexp_replace(N.clean_title(F.col("title")), " ", "").alias("_t"))
    length = F.length("_t")
    grams = F.array_distinct(F.flatten(F.transform(
        F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>")),
        lambda i: F.array(*[F.substring(F.col("_t"), i, F.lit(k)) for k in (1, 2, 3)]))))
    return (
        t.withColumn("_gram", F.explode(grams)).join(n, ["sigungu", "_gram"])
        .where(F.contains(F.col("_t"), F.col("_name"))).select("zone_id", "date").distinct()
    )


def resolve_zone_dates(zones: DataFrame, decisions: DataFrame, parents: DataFrame, first_notices: DataFrame,
                       selections: DataFrame, public: DataFrame) -> DataFrame:
    """Earliest designation date of each zone part from six sources.

    ``zones``: zone_id, title, sigungu, notice_date. The chosen date's source
    is kept and other dates go to ``t_alt``; zones without any date are held
    back (all null).
    """
    tokens = zones.select("zone_id", "sigungu", F.explode(N.zone_tokens(F.col("title"))).alias("token"))

    def by_token(dates: DataFrame, source: str, rank: int) -> DataFrame:
        hit = tokens.join(dates.select("sigungu", "token", "date"), ["sigungu", "token"])
        return hit.select("zone_id", "date", F.lit(source).alias("source"), F.lit(rank).alias("rank"))

    direct = F.col("title").contains("지정") & ~F.col("title").contains("변경")
    promoted = zones.withColumn("parent", N.promotion_parent(F.col("title"))).join(
        parents.select("parent", "date"), "parent")
    cands = (
        by_token(decisions, "oa_first_decision", 0)
        .unionByName(promoted.select("zone_id", "date", F.lit("promotion_parent").alias("source"), F.lit(1).alias("rank")))
        .unionByName(zones.where(direct).select(
            "zone_id", F.col("notice_date").alias("date"), F.lit("ntfc_direct").alias("source"), F.lit(2).alias("rank")))
        .unionByName(by_token(first_notices, "first_designation_gosi", 3))
        .unionByName(by_token(selections, "shintong_select", 4))
        .unionByName(contained_names(zones, public).select(
            "zone_id", "date", F.lit("public_redev").alias("source"), F.lit(5).alias("rank")))
    ).where(F.col("date").isNotNull()).withColumn("nd", N.sortable_date(F.col("date")))
    picked = cands.groupBy("zone_id").agg(
        F.min(F.struct("nd", "rank", "date", "source")).alias("_c"),
        F.collect_set(F.struct("nd", "date")).alias("_all"),
    )
    alt = F.array_sort(F.array_distinct(F.transform(
        F.filter(F.col("_all"), lambda a: a["nd"] != F.col("_c.nd")), lambda a: a["date"])))
    out = picked.select(
        "zone_id",
        F.substring("_c.date", 1, 4).try_cast("int").alias("t"),
        F.substring("_c.date", 1, 10).alias("t_date"),
        F.col("_c.source").alias("t_source"),
        F.when(F.size(alt) > 0, F.array_join(alt, ";")).alias("t_alt"),
    )
    return zones.select("zone_id").distinct().join(out, "zone_id", "left")

