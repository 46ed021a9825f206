"""The registry's helpers for SQL: temporary functions whose bodies are SQL, so Catalyst inlines them and no Python runs.

``register(spark)`` makes the scalar functions, ``register_cards`` and ``register_residents`` table functions over a session's tables. They last as long as the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark import schemas
from hearthspark.operators.household_text import parse_households

_MEMBER = ["nama", "nik", "gender", "birth_place", "birth_date", "religion", "education", "occupation", "marital_status", "family_relation"]


def _label(codes: dict[str, str]) -> str:
    return "case code " + " ".join(f"when '{k}' then '{v}'" for k, v in codes.items()) + " else '-' end"


def _preset() -> str:
    within = lambda low, high: f"age >= {low}" if high is None else f"age between {low} and {high}"
    return "case " + " ".join(f"when {within(*ends)} then '{name}'" for name, ends in schemas.AGE_PRESETS.items()) + " end"


#: Name: (parameters, type, body).
SCALARS = {
    "registry_age": ("born date, as_of date", "int", "year(as_of) - year(born) - cast(month(born) * 100 + day(born) > month(as_of) * 100 + day(as_of) as int)"),
    "registry_age_preset": ("age int", "string", _preset()),
    "registry_gender": ("code string", "string", _label(schemas.GENDER)),
    "registry_status": ("code string", "string", _label(schemas.RESIDENT_STATUS)),
    "registry_marital_status": ("code string", "string", _label(schemas.MARITAL_STATUS)),
    "registry_relation": ("code string", "string", _label(schemas.FAMILY_RELATION)),
    "registry_count": ("n bigint", "string", "translate(format_number(n, 0), ',', '.')"),
    "registry_digits": ("value string", "string", "regexp_replace(value, '[^0-9]', '')"),
    "registry_slug": ("value string", "string", "lower(regexp_replace(value, '[^A-Za-z0-9]+', '-'))"),
    "registry_rt_label": ("area string, number string", "string", "nullif(concat_ws(' / ', area, concat('RT ', number)), '')"),
    "registry_confidence": ("value double, least double", "string", "case when value >= least then 'SUCCESS' else 'LOW_CONFIDENCE' end"),
}


def register(spark: SparkSession) -> None:
    """The scalar functions. Null arguments give what the column helpers of the same names give."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")


def register_cards(spark: SparkSession, cards: DataFrame, newest_year: int = 2100) -> None:
    """``card_members()`` and ``card_headers()``: what the parser reads on ``cards`` (id: bigint, raw_text, confidence), to be filtered or joined by ``card``, the card's id.

    They take no id: a lateral join would refuse the parser's plan as not deterministic. A card without members has no rows in the first.
    """
    parsed = parse_households(cards, newest_year)
    parsed.select("id", "kk_number", "address", "rt", "rw").createOrReplaceTempView("registry_card_headers")
    rows = parsed.select("id", F.posexplode("members").alias("i", "m"))
    rows.select("id", (F.col("i") + 1).alias("ordinal"), *[F.col(f"m.{x}") for x in _MEMBER]).createOrReplaceTempView("registry_card_members")
    kinds = ", ".join(f"{x} string" for x in _MEMBER)
    spark.sql(f"create or replace temporary function card_members() returns table(card bigint, ordinal int, {kinds}) return select id, ordinal, {', '.join(_MEMBER)} from registry_card_members")
    spark.sql("create or replace temporary function card_headers() returns table(card bigint, kk_number string, address string, rt string, rw string) return select id, kk_number, address, rt, rw from registry_card_headers")


def register_residents(spark: SparkSession, residents: DataFrame) -> None:
    """``residents_aged(low, high, as_of)``: ids of ``residents`` (id: bigint, birth_date) of ages from ``low`` to ``high`` (null: open), as a range of birth dates that scans prune by."""
    residents.select("id", "birth_date").createOrReplaceTempView("registry_residents")
    spark.sql(
        "create or replace temporary function residents_aged(low int, high int, as_of date) returns table(id bigint, birth_date date) return select id, birth_date from registry_residents "
        "where birth_date <= coalesce(add_months(as_of, -12 * low), date'9999-12-31') and birth_date > coalesce(add_months(as_of, -12 * (high + 1)), date'0001-01-01')"
    )
