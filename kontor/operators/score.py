"""Lead scoring over company rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions import scoring as S
from kontor.functions.normalize import format_address
from kontor.functions.text import filled, let
from kontor.operators.select import parse_choice
from kontor.schemas import LEAD_QUALITY, LEAD_STATUS

_PARTS = ["contact_data", "website", "industry", "company_size", "technologies", "data_quality"]


def score(df: DataFrame) -> DataFrame:
    """Add score, quality, breakdown and recommendations to company rows.

    The address that counts is put together from street, postal code and city.  The
    whole rule set is one projection, so it runs inside the scan stage.
    """
    error = F.col("error") if "error" in df.columns else None

    size = F.col("team_size")
    if dict(df.dtypes)["team_size"] != "string":
        size = F.nullif(size, F.lit(0))  # a number counts as given unless it is zero

    def contact(mine: str) -> Column:  # another contact's value counts where the company has none
        other = f"contact_{mine}"
        return F.when(filled(F.col(mine)), F.col(mine)).otherwise(F.col(other)) if other in df.columns else F.col(mine)

    def rules(address: Column) -> Column:
        return F.struct(
            S.contact_score(contact("email"), contact("phone"), address, F.col("directors")).alias("contact_data"),
            S.website_score(F.col("website")).alias("website"),
            S.industry_score(F.col("industry")).alias("industry"),
            S.size_score(F.col("team_size")).alias("company_size"),
            S.tech_score(F.col("technologies")).alias("technologies"),
            S.quality_score(
                F.col("company_name"),
                [*map(F.col, ["company_name", "email", "phone", "website"]), address, F.col("city"), F.col("industry"), size],
                [F.col("technologies"), F.col("directors")],
                error,
            ).alias("data_quality"),
        )

    parts = let(format_address(F.col("street"), F.col("postal_code"), F.col("city")), rules)

    def rate(b: Column) -> Column:
        total = b[_PARTS[0]]["points"]
        for p in _PARTS[1:]:
            total = total + b[p]["points"]
        advice = F.array_compact(
            F.array(
                F.when(b["contact_data"]["points"] < 20, F.lit(S.ADVICE_CONTACT)),
                F.when(b["website"]["points"] < 10, F.lit(S.ADVICE_WEBSITE)),
                F.when(b["data_quality"]["points"] < 5, F.lit(S.ADVICE_QUALITY)),
            )
        )
        return F.struct(b.alias("breakdown"), total.alias("score"), S.category(total).alias("quality"), advice.alias("recommendations"))

    # every rule is evaluated once; the total, the category and the advice read its result
    rated = df.withColumn("_rated", let(parts, rate))
    return rated.select(*df.columns, "_rated.*")


def write_back(scored: DataFrame) -> DataFrame:
    """Store score and grade in the company columns."""
    return scored.withColumns(
        {"lead_score": F.col("score").cast("double"), "lead_quality": S.quality_enum(F.col("quality"))}
    ).drop("breakdown", "score", "quality", "recommendations")


def distribution(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total_scored"),
        F.count_if(F.col("quality") == "hot").alias("hot_leads"),
        F.count_if(F.col("quality") == "warm").alias("warm_leads"),
        F.count_if(F.col("quality") == "cold").alias("cold_leads"),
        F.count_if(F.col("quality") == "low_quality").alias("low_quality"),
    )


def bulk_score(
    df: DataFrame,
    ids: DataFrame | None = None,
    status: str | None = None,
    quality: str | None = None,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scored rows, distribution) for an id set, or for filters and, where one is given, a limit."""
    if ids is not None:
        chosen = df.join(ids.select("id").distinct(), "id", "left_semi")
    else:
        chosen = df
        if status:
            chosen = chosen.filter(F.col("lead_status") == parse_choice(status, LEAD_STATUS, by="name"))
        if quality:
            chosen = chosen.filter(F.col("lead_quality") == parse_choice(quality, LEAD_QUALITY, by="name"))
        if limit is not None:
            chosen = chosen.orderBy("id").limit(limit)
    scored = score(chosen)
    return scored, distribution(scored)
