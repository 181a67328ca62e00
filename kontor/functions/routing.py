"""Which extraction model a text is sent to, and which settings a measured model gets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model per priority.
MODELS = {
    "speed": "llama3.2:1b",
    "accuracy": "llama3.2",
    "balanced": "mistral",
    "resource_efficient": "qwen2.5",
}
DEFAULT_MODEL = "llama3.2"

# Priority per use case when the caller states none.
USE_CASE_PRIORITY = {
    "company_basic": "speed",
    "company_detailed": "accuracy",
    "employees": "balanced",
    "services": "speed",
    "contact_info": "balanced",
}


def route_model(length: Column, complexity: Column, priority: Column) -> Column:
    level = F.coalesce(F.nullif(F.lower(complexity), F.lit("")), F.lit("medium"))
    wish = F.coalesce(F.nullif(F.lower(priority), F.lit("")), F.lit("balanced"))
    simple = (length < 1000) & (level == "simple")
    heavy = (length > 5000) | (level == "complex")
    pick = (
        F.when(simple, F.when(wish == "accuracy", "accuracy").otherwise("speed"))
        .when(heavy, F.when(wish == "speed", "balanced").otherwise("accuracy"))
        .when(wish.isin("speed", "accuracy", "resource_efficient"), wish)
        .otherwise("balanced")
    )
    return _model(pick)


def model_for_use_case(use_case: Column, priority: Column) -> Column:
    wish = F.coalesce(F.nullif(F.lower(priority), F.lit("")), F.lit("balanced"))
    case = F.coalesce(F.nullif(use_case, F.lit("")), F.lit("company_basic"))
    table = F.create_map(*[F.lit(x) for pair in USE_CASE_PRIORITY.items() for x in pair])
    usual = F.coalesce(F.try_element_at(table, case), F.lit("balanced"))
    return F.coalesce(_model(F.when(wish != "balanced", wish).otherwise(usual)), F.lit(DEFAULT_MODEL))


def _model(priority: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MODELS.items() for x in pair])
    return F.try_element_at(table, priority)


def recommended_config(hallucination: Column, completeness: Column, p95: Column, f1: Column) -> dict[str, Column]:
    """Settings as columns; each rule only moves the values it names."""
    wild = hallucination > 0.15
    thin = completeness < 0.55
    slow = p95 > 12
    quick = (p95 < 6) & (f1 > 0.65)
    temperature = F.when(wild, F.lit(0.05)).otherwise(F.lit(0.1))
    top_p = F.when(wild, F.lit(0.85)).otherwise(F.lit(0.9))
    predict = F.when(thin, F.lit(1536)).otherwise(F.lit(1024))
    return {
        "temperature": F.when(quick, F.least(temperature + 0.05, F.lit(0.25))).otherwise(temperature),
        "top_p": F.when(slow, F.least(top_p, F.lit(0.88))).otherwise(top_p),
        "num_predict": F.when(slow, F.least(predict, F.lit(1024))).otherwise(predict),
        "repeat_penalty": F.when(wild, F.lit(1.15)).otherwise(F.lit(1.05)),
        "top_k": F.when(thin, F.lit(60)),
    }
