"""Account import, merging, discovery, versioned dimensions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import amount, fold, normalize_domain
from .verify import indel_ratio, token_sort_ratio

# Headers that name each field, in lower case without punctuation.
HEADERS = {
    "name": ["name", "company", "company name", "organization name", "account name"],
    "domain": ["domain", "website", "homepage url", "company domain name"],
    "country_code": ["country code", "country", "headquarters location"],
    "industry": ["industry ids", "industry", "industries"],
    "employees": ["employees", "number of employees", "employee count"],
    "revenue_eur": ["revenue eur", "revenue", "estimated revenue range", "annual revenue"],
    "tags": ["tags"],
}


def header_key(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", header.lower()).strip()


def map_headers(df: DataFrame, custom: dict[str, str] | None = None) -> DataFrame:
    """Columns by field; custom maps a field to its header. Fields without a column are null."""
    by_key = {header_key(c): c for c in reversed(df.columns)}
    out = []
    for f, names in HEADERS.items():
        wanted = [header_key(custom[f])] if custom and f in custom else names
        found = next((by_key[n] for n in wanted if n in by_key), None)
        out.append((F.col(f"`{found}`") if found else F.lit(None)).cast("string").alias(f))
    return df.select(*[c for c in ("row",) if c in df.columns], *out)


def read_accounts(spark: SparkSession, path: str, sep: str = ",", custom: dict[str, str] | None = None) -> DataFrame:
    """Rows of CSV files by field; ill-formed lines come as far as they go."""
    return map_headers(spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE"), custom)


def country_match(df: DataFrame, countries: DataFrame, column: str = "country_code") -> DataFrame:
    """Code of a code, label or alias; of "City, Region, Country" by the last part. countries: key (upper case), code."""
    key = F.upper(F.trim(F.element_at(F.split(column, ","), -1)))
    return df.withColumn("_key", key).join(F.broadcast(countries.select(F.col("key").alias("_key"), F.col("code").alias("_code"))), "_key", "left").withColumn(column, F.col("_code")).drop("_key", "_code")


def industry_match(df: DataFrame, industries: DataFrame, column: str = "industry", least: float = 85.0) -> DataFrame:
    """Id of an exact id, label or alias, else of the label most alike, from a ratio of ``least`` on. industries: key (folded), id.

    Each different unknown value meets the keys of lengths that allow the ratio, and the
    best one is kept; neither table passes through the driver.
    """

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([max(token_sort_ratio(x, y), indel_ratio(x, y)) for x, y in zip(a, b, strict=True)], dtype=float)

    key = F.trim(fold(F.col(column)))
    exact = df.withColumn("_key", key).join(F.broadcast(industries.select(F.col("key").alias("_key"), F.col("id").alias("_id")).dropDuplicates(["_key"])), "_key", "left")
    done = exact.where("_id is not null or _key is null").withColumn("industry_id", F.col("_id"))
    rest = exact.where("_id is null and _key is not null")
    unknown = rest.select("_key", F.length("_key").alias("_n")).distinct()
    # lengths n, m allow a ratio r only if 200 * min(n, m) / (n + m) >= r
    low, high = F.ceil(F.col("_n") * least / (200 - least)), F.floor(F.col("_n") * (200 - least) / least)
    by_length = unknown.withColumn("_m", F.explode(F.sequence(low, F.greatest(low, high))))
    labels = industries.where("key is not null").select(F.col("key").alias("_label"), F.length("key").cast("long").alias("_m"), F.col("id").alias("_other"))
    close = by_length.join(labels, "_m").withColumn("_r", likeness("_key", "_label")).where(F.col("_r") >= least)
    best = close.groupBy("_key").agg(F.max_by("_other", F.struct("_r", F.length("_label").alias("l"), "_label")).alias("industry_id"))
    return done.unionByName(rest.join(best, "_key", "left")).drop("_key", "_id")


def validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows with normalised fields, rejected rows with their problems)."""
    domain = normalize_domain(F.col("domain"))
    problems = F.filter(
        F.array(
            F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.lit("no name")),
            F.when(F.coalesce(F.trim("domain"), F.lit("")) == "", F.lit("no domain")).when(domain.isNull(), F.lit("bad domain")),
        ),
        lambda x: x.isNotNull(),
    )
    warnings = F.filter(F.array(F.when(F.col("employees").isNotNull() & amount(F.col("employees")).isNull(), F.lit("bad employees"))), lambda x: x.isNotNull())
    out = rows.withColumn("problems", problems).withColumn("warnings", warnings)
    good = out.where(F.size("problems") == 0).drop("problems")
    good = good.withColumn("name", F.trim("name")).withColumn("domain", domain).withColumn("employees", amount(F.col("employees")).cast("bigint"))
    good = good.withColumn("revenue_eur", amount(F.col("revenue_eur")).cast("bigint")).withColumn("tags", F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ";"), F.trim), lambda t: t != ""))
    return good, out.where(F.size("problems") > 0)


def merge_duplicates(rows: DataFrame, mode: str = "merge", order: str = "row") -> DataFrame:
    """Of rows of a domain the first; merge fills its missing fields from the ones after it.

    Each field is the one of least order among those that are set, an aggregate, so a
    domain of any size is merged before it is dealt.
    """
    # The place is held in a struct, so that a row without one comes first, as in an ascending order.
    at, fields = F.struct(order), [c for c in rows.columns if c not in ("domain", order)]
    first = F.min_by(F.struct(*[c for c in rows.columns if c != "domain"]), at).alias("_first")
    filled = [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_f_{c}") for c in fields] if mode == "merge" else []
    merged = rows.groupBy("domain").agg(first, *filled)
    value = lambda c: F.col("domain") if c == "domain" else F.col(f"_f_{c}") if mode == "merge" and c in fields else F.col("_first")[c]
    return merged.select(*[value(c).alias(c) for c in rows.columns])


def upsert_companies(existing: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """Companies with what is missing filled from the rows, and new ones; action says created, updated or skipped."""
    e = existing.select("domain", *[F.col(f).alias(f"_e_{f}") for f in fields]).withColumn("_e", F.lit(True))
    r = rows.select("domain", *[F.col(f).alias(f"_r_{f}") for f in fields]).withColumn("_r", F.lit(True))
    both = e.join(r, "domain", "full")
    filled = F.lit(False)
    for f in fields:
        filled = filled | (F.col(f"_e_{f}").isNull() & F.col(f"_r_{f}").isNotNull())
    action = F.when(F.col("_e").isNull(), "created").when(F.col("_r").isNull(), "untouched").when(filled, "updated").otherwise("skipped")
    return both.select("domain", *[F.coalesce(f"_e_{f}", f"_r_{f}").alias(f) for f in fields], action.alias("action"))


def apply_resolved(companies: DataFrame, resolved: DataFrame, fields: list[str]) -> DataFrame:
    """What is known wins; own domains are united."""
    r = resolved.select("company_id", F.col("own_domains").alias("_own"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    out = companies.join(r, "company_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("own_domains", F.array_sort(F.array_union(F.coalesce("own_domains", none), F.coalesce("_own", none))))
    for f in fields:
        out = out.withColumn(f, F.coalesce(f, f"_r_{f}"))
    return out.drop("_own", *[f"_r_{f}" for f in fields])


def merge_candidates(rows: DataFrame) -> DataFrame:
    """A row an entity: most employees, all industries, the first of other fields."""
    return rows.groupBy("entity_id").agg(F.max("employees").alias("employees"), F.array_sort(F.collect_set("industry_id")).alias("industry_ids"), F.min_by("name", "position").alias("name"), F.min_by("domain", "position").alias("domain"), F.min_by("country_code", "position").alias("country_code"))


def filter_candidates(rows: DataFrame, excluded: DataFrame, low: int | None, high: int | None, most: int) -> DataFrame:
    """Within bounds (unknown sizes stay), not excluded, one a domain, the largest first."""
    kept = rows.where(F.col("employees").isNull() | F.col("employees").between(low if low is not None else 0, high if high is not None else 2**62))
    kept = kept.join(excluded.select("domain"), "domain", "left_anti")
    order = Window.partitionBy("domain").orderBy(F.col("employees").desc_nulls_last(), "entity_id")
    one = kept.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    return one.orderBy(F.col("employees").desc_nulls_last(), "entity_id").limit(most)


def rank_candidates(fitted: DataFrame, tracked: DataFrame) -> DataFrame:
    """By fit, size, name; already tracked ones are marked. fitted: from scoring.fit with a floor of 0."""
    t = tracked.select("domain").distinct().withColumn("already_tracked", F.lit(True))
    out = fitted.join(t, "domain", "left").fillna(False, ["already_tracked"])
    return out.orderBy(F.desc("fit"), F.col("employees").desc_nulls_last(), F.lower("name"))


MEANING = ["text", "polarity", "category", "source_types", "keywords"]


def version_questions(old: DataFrame, new: DataFrame) -> DataFrame:
    """New questions with their version (one more where the meaning changed) and whether to score again."""
    o = old.select("question_id", F.col("version").alias("_v"), F.col("weight").alias("_w"), F.col("is_active").alias("_a"), F.to_json(F.struct(*[c for c in MEANING if c in old.columns])).alias("_m"))
    out = new.drop("version").join(o, "question_id", "left")
    same = F.to_json(F.struct(*[c for c in MEANING if c in old.columns])).eqNullSafe(F.col("_m"))
    version = F.when(F.col("_v").isNull(), 1).when(same, F.col("_v")).otherwise(F.col("_v") + 1)
    again = F.col("_v").isNotNull() & (~F.col("weight").eqNullSafe(F.col("_w")) | ~F.col("is_active").eqNullSafe(F.col("_a")) | ~same)
    return out.withColumn("version", version).withColumn("rescore", again).drop("_v", "_w", "_a", "_m")


def new_profile_version(profiles: DataFrame, fresh: DataFrame) -> DataFrame:
    """The fresh profile of a service becomes its current one, with the next version."""
    last = profiles.groupBy("service_id").agg(F.max("version").alias("_last"))
    new = fresh.join(last, "service_id", "left").withColumn("version", F.coalesce("_last", F.lit(0)) + 1).withColumn("is_current", F.lit(True)).drop("_last")
    old = profiles.join(fresh.select("service_id").distinct().withColumn("_f", F.lit(True)), "service_id", "left").withColumn("is_current", F.col("is_current") & F.col("_f").isNull()).drop("_f")
    return old.unionByName(new, allowMissingColumns=True)


def industry_labels(answers: Column, known: list[str], most: int = 3) -> Column:
    """Ids of the taxonomy alone, in order, once each."""
    return F.slice(F.array_distinct(F.filter(answers, lambda i: i.isin(known))), 1, most)
