"""Entity resolution: find, scan, route, merge and review duplicate companies.

Pairs are only ever formed inside one block (same city, NULL equal to NULL) and
four things keep that cheap at scale:

1. *Profiles.*  Rows that agree on all four comparison keys are one profile; a
   block full of copies is compared once.  A row needs at most ``k`` candidates,
   so the ``k + 1`` lowest ids of a profile stand for all its rows exactly.
2. *Tiles.*  A block with more profiles than ``tile_rows`` is split into a grid of
   tiles, so no task ever holds a whole hot block.
3. *Signatures.*  At a threshold of 80 a pair that lacks a field has to agree in the
   other three, so profiles with a missing field are joined on those three values
   and never compared with a whole block.
4. *Bounds.*  The weighted score can only reach the threshold if upper bounds of the
   four ratios do.  A tile's pairs are bounded by one matrix product per field (``tiles``); only
   pairs that can qualify are compared letter by letter, and only hits leave the task.

No signature of a single field is both exact and selective at 80: a pair may differ in a fifth of
every field, which leaves no q-gram or segment that unrelated names, addresses or phones of
one city don't share as well.  Complete profiles of a block therefore stay a grid.

All bounds are proven upper bounds, so the result equals the unpruned one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions.normalize import phone_key
from kontor.functions.similarity import ratio, token_sort_key
from kontor.functions.text import filled
from kontor.operators import tiles
from kontor.session import checkpoint_cut

# Weights and default thresholds of the similarity model.
WEIGHTS = {"name": 0.4, "address": 0.2, "phone": 0.2, "website": 0.2}
NAME_THRESHOLD = 85
ADDRESS_THRESHOLD = 80
PHONE_THRESHOLD = 90
WEBSITE_THRESHOLD = 95
OVERALL_THRESHOLD = 80
AUTO_MERGE_THRESHOLD = 95

FIELDS = list(WEIGHTS)
TILE_ROWS = 32_000
#: Below all ids.
LOWEST = -(1 << 63)


def comparison_keys(df: DataFrame) -> DataFrame:
    """Add one key per compared field; NULL means the field does not take part."""
    return df.withColumns(
        {
            "name_key": token_sort_key(F.lower("company_name")),
            "address_key": F.when(filled(F.col("address")), token_sort_key(F.lower("address"))),
            "phone_key": phone_key(F.col("phone")),
            "website_key": F.when(filled(F.col("website")), F.lower("website")),
        }
    )


def overall(name: Column, address: Column, phone: Column, website: Column) -> Column:
    w = WEIGHTS
    return (
        F.lit(w["name"]) * name
        + F.lit(w["address"]) * address
        + F.lit(w["phone"]) * phone
        + F.lit(w["website"]) * website
    )


def pair_similarity(pairs: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame:
    """Exact similarities of given pairs with key columns prefixed ``a`` and ``b``."""
    sims = {
        f"{f}_sim": F.coalesce(ratio(F.col(f"{a}{f}_key"), F.col(f"{b}{f}_key")), F.lit(0)) for f in FIELDS
    }
    scored = pairs.withColumns(sims)
    return scored.withColumn("overall", overall(*[F.col(f"{f}_sim") for f in FIELDS]))


def is_duplicate(
    name: Column, address: Column, phone: Column, website: Column, score: Column
) -> Column:
    return (name >= NAME_THRESHOLD) & (
        (address >= ADDRESS_THRESHOLD)
        | (phone >= PHONE_THRESHOLD)
        | (website >= WEBSITE_THRESHOLD)
        | (score >= OVERALL_THRESHOLD)
    )


def _block_key(block: list[str]) -> Column:
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in block]
    return F.concat_ws("\u0001", *parts)


def _profile_key() -> Column:
    keys = [F.coalesce(F.concat(F.lit("="), F.col(f"{f}_key")), F.lit("~")) for f in FIELDS]
    return F.unhex(F.md5(F.concat_ws("\u0001", F.col("block"), *keys)))


#: Two values of which one is shorter are rounded to 100 only if they are equal: one edit in fewer than 200 characters is more than half a point.
SHORTEST_INEXACT = 100


def _grid(profiles: DataFrame, tile_rows: int) -> DataFrame:
    """Cells of the rows that ask and of the others, in blocks above one tile; there are at most rows / tile_rows of them."""
    cells = [F.ceil(F.count_if(c) / F.lit(tile_rows)).cast("int").alias(name) for c, name in ((F.col("probe"), "asking"), (~F.col("probe"), "others"))]
    return profiles.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *cells).filter(F.col("n") > tile_rows).drop("n")


def profile_pairs(
    profiles: DataFrame, threshold: float, best: int, tile_rows: int = TILE_ROWS, earlier: bool = False
) -> DataFrame:
    """Links (``src``, ``dst``, similarities, ``overall >= threshold``) of every probe to the ``best`` others: score first, then ``least``.

    ``profiles``: block, pkey, probe, the keys, ``least`` (the lowest id that the profile offers as a candidate), ``offers``
    (whether it has one), ``first`` and ``last`` (its lowest and highest id that asks).  Each of the ``best`` profiles offers a candidate,
    so what comes after them is no candidate of ``src`` among the ``best`` first.  With ``earlier`` a candidate needs a lower id
    than the row that asks: partners with ``least`` below ``first`` are counted, those that only some rows may have come on top.
    Each pair of probes is met once for both; probes meet the other profiles of their block, and those don't meet each other.
    """
    present = sum((F.col(f"{f}_key").isNotNull().cast("int") for f in FIELDS[1:]), F.lit(0))
    most = F.lit(100 * WEIGHTS["name"]) + present * F.lit(100 * WEIGHTS["phone"])
    keys = [f"{f}_key" for f in FIELDS]
    more = ["probe", "least", "offers", "first", "last"]
    rows = checkpoint_cut(profiles.filter(most >= threshold).select("block", "pkey", *more, *keys))
    strict = _strict(threshold)
    # where a missing field leaves no room, only complete rows are compared with their block
    whole = rows.filter(" and ".join(f"{k} is not null" for k in keys)) if strict else rows

    # cells of probes come before those of others.  Tile (i, j) with i < j: rows of cell i against rows of cell j; (i, i): its rows against
    # each other.  Blocks of a single tile are cell 0 as a whole.
    asking, others = F.coalesce("asking", F.lit(1)), F.coalesce("others", F.lit(0))
    hashed = F.xxhash64("pkey")
    mine = F.when(F.col("asking").isNull(), 0).when(F.col("probe"), F.pmod(hashed, F.greatest(asking, F.lit(1)))).otherwise(asking + F.pmod(hashed, F.greatest(others, F.lit(1))))
    met = F.when(F.col("asking").isNull() | F.col("probe"), asking + others).otherwise(asking)
    near = whole.join(_grid(whole, tile_rows), "block", "left").withColumn("mine", mine.cast("int")).withColumn("met", met).filter("met > 0")
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("met") - 1)))
    side = F.when(F.col("other") == F.col("mine"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    spots = near.select("block", F.least("mine", "other").alias("ti"), F.greatest("mine", "other").alias("tj"), side.cast("int").alias("side"), "pkey", *more, *keys)
    dealt = spots.repartition(int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "ti", "tj").sortWithinPartitions("block", "ti", "tj")
    sims = [f"{f}_sim" for f in FIELDS]
    run = tiles.compare(FIELDS, list(WEIGHTS.values()), threshold, best, earlier)
    linked = ["src", "dst", "least", *sims]
    links = dealt.mapInArrow(run, ", ".join(["src binary", "dst binary", "least bigint", *(f"{s} int" for s in sims)]))
    links = links.withColumn("overall", overall(*[F.col(s) for s in sims])).filter(F.col("overall") >= threshold)
    if strict:
        near = checkpoint_cut(pair_similarity(near_equal_pairs(rows)).select("a_pkey", "b_pkey", *sims, "overall").filter(F.col("overall") >= threshold))
        ways = [near.select(F.col(f"{x}_pkey").alias("src"), F.col(f"{y}_pkey").alias("dst"), *sims, "overall") for x, y in ("ab", "ba")]
        offered = rows.filter("offers").select(F.col("pkey").alias("dst"), "least")
        links = links.unionByName(ways[0].unionByName(ways[1]).join(offered, "dst").select(*linked, "overall"))
    if not earlier:
        ranked = Window.partitionBy("src").orderBy(F.desc("overall"), "least", "dst")
        links = links.withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= best)
    return links.select("src", "dst", *sims, "overall")


def _strict(threshold: float) -> bool:
    """Whether a pair that lacks a field has to agree (similarity 100) in all others."""
    return 100 * (1 - min(WEIGHTS.values())) - threshold < min(WEIGHTS.values())


def _signature(f: str) -> Column:
    """Equal for any two values of similarity 100: the value itself below the length where one edit rounds away."""
    key = F.col(f"{f}_key")
    return F.when(F.length(key) < SHORTEST_INEXACT, F.concat(F.lit("="), key)).otherwise(F.lit("~"))


def near_equal_pairs(profiles: DataFrame) -> DataFrame:
    """Unordered pairs of distinct profiles of a block in which a field is missing, that can reach a strict threshold.

    A missing field costs its whole weight, so the three others have to be near equal: a
    profile without field x meets those with the same signature of the other three.  Among
    short values only one profile without x has a given signature, so pairs grow with the
    rows and not with their square.  Two different missing fields never reach the threshold.
    """
    rows = profiles.withColumn("lacks", F.concat_ws(",", *[F.when(F.col(f"{f}_key").isNull(), F.lit(f)) for f in FIELDS]))
    out = None
    for missing in FIELDS[1:]:
        common = [f for f in FIELDS if f != missing]
        signed = rows.filter(F.col("lacks").isin("", missing)).withColumn(
            "signature", F.unhex(F.md5(F.concat_ws("\u0001", F.lit(missing), "block", *[_signature(f) for f in common])))
        )

        def side(prefix: str, part: DataFrame) -> DataFrame:
            cols = ["block", "pkey", "lacks", "probe", *[f"{f}_key" for f in FIELDS]]
            return part.select("signature", *[F.col(c).alias(f"{prefix}_{c}") for c in cols])

        left, right = side("a", signed.filter(F.col("lacks") == missing)), side("b", signed)
        once = (F.col("b_lacks") == "") | (F.col("a_pkey") < F.col("b_pkey"))
        met = left.join(right, "signature").filter((F.col("a_block") == F.col("b_block")) & once & (F.col("a_probe") | F.col("b_probe")))
        part = met.select("a_pkey", "b_pkey", *[f"{s}_{f}_key" for s in "ab" for f in FIELDS])
        out = part if out is None else out.unionByName(part)
    return out


def find_duplicates(
    probe: DataFrame,
    base: DataFrame | None = None,
    k: int = 10,
    threshold: float = OVERALL_THRESHOLD,
    block: list[str] | None = None,
    tile_rows: int = TILE_ROWS,
    earlier_only: bool = False,
) -> DataFrame:
    """Best ``k`` active candidates of every probe row, ranked by (score desc, id).

    Rows need id, company_name, city, address, phone, website, is_active.  With no
    ``base`` the active rows of ``probe`` are scanned against each other.
    ``earlier_only`` admits only candidates with a lower id (ingest order).
    """
    block = block or ["city"]
    flags = {"is_probe": F.lit(True), "is_base": F.lit(True)}
    if base is None:
        rows = probe.filter("is_active").withColumns(flags)
    else:
        # only blocks that are asked for are read on the base side
        here = probe.select(_block_key(block).alias("_b")).distinct()
        near = base.filter("is_active").withColumn("_b", _block_key(block)).join(here, "_b", "left_semi").drop("_b")
        cols = ["id", "company_name", "address", "phone", "website", *block]
        rows = (
            probe.select(cols)
            .withColumns({**flags, "is_base": F.lit(False)})
            .unionByName(near.select(cols).withColumns({**flags, "is_probe": F.lit(False)}))
        )
    # Keys and scored pairs are read several times below; writing them once is cheaper
    # than cleansing and comparing again for every use.
    keyed = checkpoint_cut(
        comparison_keys(rows)
        .withColumn("block", _block_key(block))
        .withColumn("pkey", _profile_key())
        .select("id", "block", "pkey", "is_probe", "is_base", *[f"{f}_key" for f in FIELDS])
    )
    lowest = Window.partitionBy("pkey").orderBy("id")
    stand_ins = checkpoint_cut(
        keyed.filter("is_base")
        .select("pkey", "id")
        .withColumn("nth", F.row_number().over(lowest))
        .filter(F.col("nth") <= k + 1)
        .select(F.col("pkey").alias("dst"), F.col("id").alias("cand_id"))
    )
    if earlier_only:
        # a row without an id is no candidate here
        offered = stand_ins.groupBy(F.col("dst").alias("pkey")).agg(F.min("cand_id").alias("least"))
    else:
        # rows without an id come first, as in the order of candidates below
        no_id = F.bool_or(F.col("cand_id").isNull())
        offered = stand_ins.groupBy(F.col("dst").alias("pkey")).agg(F.when(no_id, F.lit(LOWEST)).otherwise(F.min("cand_id")).alias("least"))
    asking = F.when(F.col("is_probe"), F.col("id"))
    profiles = keyed.groupBy("pkey").agg(
        F.any_value("block").alias("block"), *[F.any_value(f"{f}_key").alias(f"{f}_key") for f in FIELDS], F.bool_or("is_probe").alias("probe"),
        F.coalesce(F.min(asking), F.lit(LOWEST)).alias("first"), F.coalesce(F.max(asking), F.lit(LOWEST)).alias("last"),
    )
    profiles = profiles.join(offered, "pkey", "left").withColumn("offers", F.col("least").isNotNull())
    profiles = checkpoint_cut(profiles.withColumn("least", F.coalesce("least", F.lit(LOWEST))))
    pairs = checkpoint_cut(profile_pairs(profiles, threshold, k + 1, tile_rows, earlier_only))

    sims = [f"{f}_sim" for f in FIELDS]
    same = [
        (F.lit(100) if f == "name" else F.when(F.col(f"{f}_key").isNotNull(), 100).otherwise(0)).alias(f"{f}_sim")
        for f in FIELDS
    ]
    itself = (
        profiles.select(F.col("pkey").alias("src"), F.col("pkey").alias("dst"), *same)
        .withColumn("overall", overall(*[F.col(s) for s in sims]))
        .filter(F.col("overall") >= threshold)
    )
    links = pairs.unionByName(itself)
    asked = keyed.filter("is_probe").select("id", F.col("pkey").alias("src"))
    if earlier_only:
        # which candidates count depends on the row, so the cut is made per row
        per_row = Window.partitionBy("id").orderBy(F.desc("overall"), "cand_id")
        return (
            asked.join(links.join(stand_ins, "dst"), "src")
            .filter("cand_id < id")
            .withColumn("rank", F.row_number().over(per_row))
            .filter(F.col("rank") <= k)
            .select("id", "cand_id", "rank", *sims, "overall")
        )
    by_score = Window.partitionBy("src").orderBy(F.desc("overall"), "cand_id")
    shortlist = (
        links.join(stand_ins, "dst")
        .withColumn("pos", F.row_number().over(by_score))
        .filter(F.col("pos") <= k + 1)
        .groupBy("src")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "cand_id", *sims, "overall"))).alias("cands"))
    )
    own = F.slice(F.filter("cands", lambda c: c["cand_id"] != F.col("id")), 1, k)
    return (
        asked.join(shortlist, "src")
        .select("id", F.posexplode(own).alias("pos", "c"))
        .select("id", "c.cand_id", (F.col("pos") + 1).alias("rank"), *[f"c.{s}" for s in sims], "c.overall")
    )


def scan(
    companies: DataFrame,
    existing: DataFrame | None = None,
    threshold: float = OVERALL_THRESHOLD,
    k: int = 5,
    **options,
) -> DataFrame:
    """New duplicate candidates: every unordered pair once, scanned side first."""
    hits = find_duplicates(companies, k=k, threshold=threshold, **options)
    sims = [f"{f}_sim" for f in FIELDS]
    lo, hi = F.least("id", "cand_id"), F.greatest("id", "cand_id")
    pairs = (
        hits.withColumns({"lo": lo, "hi": hi})
        .groupBy("lo", "hi")
        .agg(
            F.bool_or(F.col("id") == F.col("lo")).alias("lo_first"),
            *[F.any_value(s).alias(s) for s in sims],
            F.any_value("overall").alias("overall"),
        )
    )
    if existing is not None:
        known = existing.select(
            F.least("company_a_id", "company_b_id").alias("lo"),
            F.greatest("company_a_id", "company_b_id").alias("hi"),
        ).distinct()
        pairs = pairs.join(known, ["lo", "hi"], "left_anti")
    first = F.when(F.col("lo_first"), F.col("lo")).otherwise(F.col("hi"))
    second = F.when(F.col("lo_first"), F.col("hi")).otherwise(F.col("lo"))
    return pairs.select(
        first.alias("company_a_id"),
        second.alias("company_b_id"),
        *[(F.col(f"{f}_sim") / 100.0).alias(f"{f}_similarity") for f in FIELDS],
        (F.col("overall") / 100.0).alias("overall_similarity"),
        F.lit("pending").alias("status"),
    )


def scan_summary(companies: DataFrame, hits: DataFrame, threshold: float = OVERALL_THRESHOLD) -> DataFrame:
    """Scanned rows and directed hits (already known pairs count again)."""
    scanned = companies.filter("is_active").agg(F.count(F.lit(1)).alias("scanned_companies"))
    found = hits.agg(F.count(F.lit(1))).scalar()
    return scanned.select("scanned_companies", found.alias("candidates_created"), F.lit(float(threshold)).alias("threshold"))


def scan_report(companies: DataFrame, hits: DataFrame) -> DataFrame:
    """Directed hits with both names; nothing is written."""
    names = companies.select("id", "company_name")
    return (
        hits.join(names, "id")
        .join(names.select(F.col("id").alias("cand_id"), F.col("company_name").alias("cand_name")), "cand_id")
        .select("id", "company_name", "cand_id", "cand_name", "rank", "overall")
    )


def route(
    hits: DataFrame, auto_merge: float = 0.95, candidate: float = 0.80
) -> DataFrame:
    """Decision per ranked hit: ``merge`` into the best candidate, or ``candidate``.

    Hits arrive best first, so a row whose best hit reaches the merge threshold
    merges once and produces no candidates.
    """
    merge_at, keep_at = auto_merge * 100, candidate * 100
    best = F.max("overall").over(Window.partitionBy("id"))
    decision = F.when((F.col("rank") == 1) & (F.col("overall") >= merge_at), "merge").when(
        (F.col("best") < merge_at) & (F.col("overall") >= keep_at), "candidate"
    )
    return hits.withColumn("best", best).withColumn("decision", decision).filter("decision is not null").drop("best")


def merge_companies(companies: DataFrame, merges: DataFrame, sources: DataFrame | None = None):
    """Fold duplicates into their primaries.

    ``merges`` has primary_id, duplicate_id.  Returns (companies, provenance): the
    updated rows, and the provenance in long form (company_id, ordinal, origin_id,
    source columns) so a primary with very many duplicates never becomes one huge
    array.  ``sources`` (company_id, ordinal, ...) is optional.  A duplicate that is
    named more than once is merged once: by the merge with the lowest ``seq`` where
    ``merges`` has one, else into the lowest primary.
    """
    rank = F.struct(*(["seq"] if "seq" in merges.columns else []), "primary_id")
    merges = merges.groupBy("duplicate_id").agg(F.min(rank).getField("primary_id").alias("primary_id"))
    # The fields a primary takes over when its own are empty.
    text = ["email", "phone", "website", "address", "description", "legal_form", "industry"]
    lists = ["directors", "services", "technologies"]
    text = [c for c in text if c in companies.columns]
    lists = [c for c in lists if c in companies.columns]

    def usable(c: str) -> Column:
        return F.size(c) > 0 if c in lists else filled(F.col(c))

    donors = merges.join(companies.withColumnRenamed("id", "duplicate_id"), "duplicate_id")
    offered = donors.groupBy(F.col("primary_id").alias("id")).agg(
        *[F.min_by(c, F.when(usable(c), F.col("duplicate_id"))).alias(f"new_{c}") for c in text + lists]
    )
    taken = [F.when(usable(c), F.col(c)).otherwise(F.coalesce(f"new_{c}", c)).alias(c) for c in text + lists]
    gone = merges.select(F.col("duplicate_id").alias("id"), F.col("primary_id").alias("merged_into"))
    was_merged = F.col("merged_into").isNotNull()
    changed = {
        "is_active": F.col("is_active") & ~was_merged,
        "is_duplicate": F.coalesce("is_duplicate", F.lit(False)) | was_merged,
        "duplicate_of_id": F.coalesce("merged_into", "duplicate_of_id"),
    }
    base = companies
    if "is_duplicate" not in base.columns:
        base = base.withColumn("is_duplicate", F.lit(False))
    if "duplicate_of_id" not in base.columns:
        base = base.withColumn("duplicate_of_id", F.lit(None).cast("bigint"))
    plain = [c for c in base.columns if c not in text + lists and c not in changed]
    merged = (
        base.join(offered, "id", "left")
        .join(gone, "id", "left")
        .select(*plain, *taken, *[col.alias(name) for name, col in changed.items()])
    )
    if sources is None:
        return merged, None
    moved = sources.join(gone.withColumnRenamed("id", "company_id"), "company_id").withColumns(
        {"origin_id": F.col("company_id"), "company_id": F.col("merged_into")}
    ).drop("merged_into")
    provenance = sources.withColumn("origin_id", F.lit(None).cast("bigint")).unionByName(moved)
    return merged, provenance


def resolve_roots(parents: DataFrame) -> DataFrame:
    """Root of every node of a merge forest: columns id, parent (NULL for roots).

    Pointer jumping: each round replaces every unfinished node's link by its target's
    link, so depth d takes log2(d) rounds.  A node is final once it points at a root;
    final nodes stay as targets but are not looked up again.  In a forest every round
    finishes some node; a round that finishes none means a cycle.
    """
    roots = parents.filter("parent is null").select("id", F.col("id").alias("root"))
    state = checkpoint_cut(
        parents.filter("parent is not null").select("id", F.col("parent").alias("up"), F.lit(False).alias("final"))
    )
    left = None
    while True:
        open_links = state.filter("not final")
        before, left = left, open_links.count()
        if left == 0:
            return roots.unionByName(state.select("id", F.col("up").alias("root")))
        if left == before:
            raise ValueError("the parent links contain a cycle")
        target = state.select(F.col("id").alias("up"), F.col("up").alias("above"), F.col("final").alias("above_final"))
        moved = open_links.select("id", "up").join(target, "up", "left").select(
            "id",
            F.coalesce("above", "up").alias("up"),
            F.coalesce("above_final", F.lit(True)).alias("final"),
        )
        state = checkpoint_cut(state.filter("final").unionByName(moved))


def settle_merges(merges: DataFrame) -> DataFrame:
    """Which merges are carried out if they are taken one after the other: (company, done, n).

    ``merges`` has primary_id, duplicate_id and ``at``, a position that no other merge has; copies of a merge count as one.  A merge is
    carried out unless its primary or its duplicate was merged away before.  In a round every open merge looks at the
    merge by which its primary went in the round before, and at the earliest one that is still open for it:
    it is dropped if one was carried out before it, and carried out if it is the first open one
    of its duplicate and none is open before it for its primary; the others of its duplicate are dropped then.  A merge that is still open
    has come through the looks at all earlier rounds, so what was carried out then is not read again.  The earliest open merge always settles, so rounds end; independent
    merges settle together, so there are as many rounds as the longest chain of merges that wait for each other.
    ``done`` is the position of the merge by which the company went, ``n`` the rows that tell of it: copies of
    the merge, times those by which its primary goes later, for every round in which it waits after that.
    """
    turns = Window.partitionBy("duplicate_id").orderBy(F.desc("wins"), "at")
    one = F.lit(1).cast("bigint")
    # dealt by duplicate once, for the copies and for the first of every duplicate
    judged = merges.select("primary_id", "duplicate_id", "at").repartition("duplicate_id").groupBy("primary_id", "duplicate_id", "at")
    judged = judged.agg(F.count(F.lit(1)).alias("n")).withColumns({"times": one, "wins": F.lit(False)})
    done = None
    while True:
        placed = judged.withColumns({"head": F.row_number().over(turns) == 1, "went": F.first("wins").over(turns)})
        placed = checkpoint_cut(placed.filter("head or not went").drop("went"))
        won = placed.filter("wins").select(F.col("duplicate_id").alias("company"), F.col("at").alias("done"), "n")
        done = won if done is None else done.unionByName(won)
        open_ = placed.filter("not wins")
        if open_.isEmpty():
            return done
        place = {"waits": F.when(~F.col("wins"), F.col("at")), "done": F.when(F.col("wins"), F.col("at")), "m": F.when(F.col("wins"), F.col("n"))}
        marks = placed.filter("head").select(F.col("duplicate_id").alias("primary_id"), *[c.alias(name) for name, c in place.items()])
        lost = F.coalesce(F.col("done") < F.col("at"), F.lit(False))
        wins = F.col("head") & F.coalesce(F.col("at") < F.col("waits"), F.lit(True))
        times = F.coalesce("m", "times")
        seen = open_.drop("wins").join(marks, "primary_id", "left").filter(~lost)
        judged = seen.select("primary_id", "duplicate_id", "at", (F.col("n") * times).alias("n"), times.alias("times"), wins.alias("wins"))


def apply_reviews(candidates: DataFrame, companies: DataFrame, decisions: DataFrame):
    """Manual review, one decision after the other.  Returns (candidates, accepted merges, errors).

    ``decisions``: candidate_id, action (merge/reject), primary_id, duplicate_id, reviewer, decided_at, reason, seq.
    They count in the order of ``seq`` (equal ones by candidate and companies; the rest is as good as the same): each is judged
    against the companies as the accepted merges before it have left them, and changes its candidate if it is accepted.
    What reviewers wrote stays in the numbered decisions, and is looked up for those that count in the end.
    """
    is_merge = F.col("action") == "merge"
    # within a candidate the numbers follow the order of seq and companies
    dealt = decisions.repartition("candidate_id").sortWithinPartitions("seq", "candidate_id", "primary_id", "duplicate_id")
    known = candidates.groupBy(F.col("id").alias("candidate_id")).agg(F.count(F.lit(1)).alias("known"))
    ranked = checkpoint_cut(dealt.withColumn("row", F.monotonically_increasing_id()).join(known, "candidate_id", "left"))
    # a merge keeps the old note unless a reason is given; a rejection always replaces it
    noted = F.coalesce(~is_merge | filled(F.col("reason")), F.lit(False))
    slim = ranked.select("candidate_id", "action", "primary_id", "duplicate_id", "seq", "row", noted.alias("noted"), "known")
    # companies say nothing about the rejection of a known candidate
    plain = F.coalesce(F.col("known").isNotNull() & ~is_merge, F.lit(False))
    asks = slim.filter(~plain).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.coalesce("known", F.lit(1)).cast("int")))).drop("copy")
    state = companies.select("id", "is_active", F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"))
    checked = (
        asks.join(state.select(F.col("id").alias("primary_id"), F.col("is_active").alias("primary_active")), "primary_id", "left")
        .join(state.select(F.col("id").alias("duplicate_id"), F.col("is_duplicate").alias("already")), "duplicate_id", "left")
    )
    fixed = (
        F.when(F.col("known").isNull(), "candidate not found")
        .when(is_merge & (F.col("primary_active").isNull() | F.col("already").isNull()), "company not found")
        .when(is_merge & (F.col("primary_id") == F.col("duplicate_id")), "self merge")
        .when(is_merge & ~F.col("primary_active"), "primary inactive")
    )
    checked = checkpoint_cut(checked.withColumn("error", fixed).drop("known", "primary_active"))
    at = F.struct("seq", "candidate_id", "row")
    gone = settle_merges(checked.filter(is_merge & F.col("error").isNull() & ~F.col("already")).select("primary_id", "duplicate_id", at.alias("at")))
    told = F.coalesce(F.col("error").isNotNull() | ~is_merge, F.lit(False))
    if not gone.filter("n > 1").isEmpty():
        # companies that share an id: every decision on them is told as often as they went
        gone = gone.withColumn("n", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
        told = F.lit(False)
    judged = (
        checked.filter(~told)
        .join(gone.select(F.col("company").alias("primary_id"), F.col("done").alias("primary_gone")), "primary_id", "left")
        .join(gone.select(F.col("company").alias("duplicate_id"), F.col("done").alias("own")), "duplicate_id", "left")
        .withColumn(
            "error",
            F.when(F.col("error").isNotNull() | ~is_merge, F.col("error"))
            .when(F.col("primary_gone") < at, "primary inactive")
            .when(F.col("already") | (F.col("own") < at), "already duplicate"),
        )
    )
    shown = ["candidate_id", "action", "primary_id", "duplicate_id", "seq"]
    judged = judged.select(*shown, "row", "noted", "error").unionByName(checked.filter(told).select(*shown, "row", "noted", "error"))
    errors = judged.filter("error is not null").select(*shown, "error")
    good = judged.filter("error is null")
    counted = good.select("candidate_id", "seq", "row", "noted").unionByName(slim.filter(plain).select("candidate_id", "seq", "row", "noted"))
    place = F.struct("seq", "row")
    chosen = counted.groupBy("candidate_id").agg(F.max(place)["row"].alias("last_row"), F.max(F.when(F.col("noted"), place))["row"].alias("note_row"))
    written = ranked.select("candidate_id", "row", "action", "reviewer", "decided_at", "reason").join(chosen, "candidate_id")
    status = F.when(is_merge, "confirmed").otherwise("rejected").alias("status")
    verdict = written.filter("row = last_row or row = note_row").groupBy(F.col("candidate_id").alias("id")).agg(
        F.first(F.when(F.col("row") == F.col("last_row"), F.struct(status, "reviewer", "decided_at")), ignorenulls=True).alias("last"),
        F.first(F.when(F.col("row") == F.col("note_row"), F.struct("reason")), ignorenulls=True).alias("note"),
    )
    updated = (
        candidates.join(verdict, "id", "left")
        .withColumns(
            {
                "status": F.coalesce("last.status", "status"),
                "reviewed_by": F.when(F.col("last").isNull(), F.col("reviewed_by")).otherwise(F.col("last.reviewer")),
                "reviewed_at": F.when(F.col("last").isNull(), F.col("reviewed_at")).otherwise(F.col("last.decided_at")),
                "notes": F.when(F.col("note").isNull(), F.col("notes")).otherwise(F.col("note.reason")),
            }
        )
        .select(candidates.columns)
    )
    merges = good.filter(is_merge).select("candidate_id", "primary_id", "duplicate_id", "seq")
    return updated, merges, errors


def list_candidates(
    candidates: DataFrame,
    companies: DataFrame,
    status: str | None = "pending",
    min_similarity: float = 0.0,
    skip: int = 0,
    limit: int = 50,
) -> DataFrame:
    """One page of candidates with a brief of both companies, most similar first."""
    rows = candidates
    if status:
        rows = rows.filter(F.col("status") == status)
    if min_similarity > 0:
        rows = rows.filter(F.col("overall_similarity") >= min_similarity)
    page = rows.orderBy(F.desc("overall_similarity"), "company_a_id", "company_b_id").offset(skip).limit(limit)
    brief = ["company_name", "address", "city", "phone", "website"]

    def side(s: str) -> DataFrame:
        return companies.select(
            F.col("id").alias(f"company_{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in brief]
        )

    return page.join(side("a"), "company_a_id").join(side("b"), "company_b_id")


def candidate_detail(candidates: DataFrame, companies: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates asked for by id with a brief of both companies and all five similarities, ids that don't exist)."""
    wanted = ids.select("id").distinct()
    brief = ["id", "company_name", "address", "city", "phone", "website"]
    shown = ["id", *[f"{f}_similarity" for f in FIELDS], "overall_similarity", "status", "reviewed_by", "reviewed_at", "notes", "created_at"]

    def side(s: str) -> DataFrame:
        return companies.select(F.col("id").alias(f"company_{s}_id"), F.struct(*brief).alias(f"company_{s}"))

    asked = candidates.join(wanted, "id", "left_semi")
    # a candidate is shown even if one of its companies is gone
    full = asked.join(side("a"), "company_a_id", "left").join(side("b"), "company_b_id", "left")
    return full.select(*shown, "company_a", "company_b"), wanted.join(candidates.select("id"), "id", "left_anti")


def candidate_stats(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts by status plus auto-merges of the latest 100 jobs that have stats.

    ``jobs``: id, created_at, stats (JSON text, may be NULL).
    """
    counts = candidates.agg(
        F.count(F.lit(1)).alias("total_candidates"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "confirmed", "rejected")],
    )
    merged = F.get_json_object("stats", "$.auto_merged_duplicates").try_cast("bigint")
    recent = jobs.filter("stats is not null").orderBy(F.desc("created_at"), F.desc("id")).limit(100)
    total = recent.agg(F.coalesce(F.sum(merged), F.lit(0)).alias("n"))
    return counts.withColumn("auto_merged", total.select(F.when(F.col("n") > 0, F.col("n"))).scalar())


def expire_candidates(
    candidates: DataFrame, now: Column, days: int = 90, delete_confirmed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(kept, expired): reviewed candidates older than ``days`` are expired."""
    statuses = ["rejected", "confirmed"] if delete_confirmed else ["rejected"]
    old = F.col("created_at") < now - F.make_dt_interval(F.lit(days))
    stale = F.coalesce(F.col("status").isin(statuses) & old, F.lit(False))
    return candidates.filter(~stale), candidates.filter(stale)
