"""Scores as CASE arithmetic over candidate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalode.functions import constants as K
from stratalode.functions.text import contains_any, stem


def steps(*cases: tuple[Column, float]) -> Column:
    """The value of the first case that holds, else 0."""
    out = F.when(cases[0][0], F.lit(float(cases[0][1])))
    for test, value in cases[1:]:
        out = out.when(test, F.lit(float(value)))
    return out.otherwise(0.0)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(c, F.lit(10.0)))


def large_file_penalty(loc: Column) -> Column:
    """0 up to 500 lines, then -0.1 for each 150 begun, -1 at most."""
    return F.when(loc <= 500, 0.0).otherwise(-F.least(F.lit(1.0), F.floor((loc - 500 + 149) / 150) * 0.1))


def code_quality(c=F.col) -> Column:
    cc, fan, tests, doc = c("complexity"), c("fan_in"), c("has_tests"), c("has_docstring")
    score = steps((tests, 2.5)) + steps((doc, 1.5)) + steps((c("internal_imports") == 0, 1.5), (c("internal_imports") == 1, 0.5))
    score = score + steps((c("external_imports") <= 3, 1.5), (c("external_imports") <= 5, 0.5)) + steps((c("filename_score") > 0, 0.5))
    score = score + steps((fan == 0, 0.5), (fan > 50, -2.5), (fan > 20, -1.5), (fan > 10, -0.5))
    score = score + steps((alone(c), 1.0), (c("extraction_type") == "multi", -1.0)) + steps((cc > 20, -3.0), (cc > 10, -1.5), (cc > 5, -0.5))
    score = score + steps((c("in_cycle"), -2.0)) + steps((~doc & ~tests, -1.5)) + steps((tests & doc & (cc > 0) & (cc <= 5), 1.0))
    return clamp(score - large_file_penalty(c("loc")))  # the penalty is negative: large files gain here


def alone(c=F.col) -> Column:
    return (c("extraction_type") == "single") & (F.size(c("relative_imports")) == 0)


def relevance(c=F.col) -> Column:
    weight, api, loc, fan = c("dependency_weight"), c("api_surface_count"), c("loc"), c("fan_in")
    score = F.lit(4.0) + steps((alone(c), 2.5), (c("extraction_type") == "multi", -1.5)) + steps((weight == 0, 2.0), (weight == 1, 0.5), (weight == 3, -2.5))
    score = score + steps((api >= 3, 1.5), (api == 2, 0.5), (api == 1, -1.0), (api == 0, -2.5)) + steps((c("has_project_specific_refs"), -2.0))
    score = score + steps((loc.between(50, 200), 0.5), (loc < 20, -1.5), (loc > 400, -0.5)) + steps((c("has_tests"), 0.5)) + steps((c("has_docstring"), 0.5))
    score = score + steps((c("internal_imports") == 0, 0.5)) + steps((fan > 50, -2.5), (fan > 20, -1.5), (fan > 10, -0.5))
    return clamp(score + steps((~c("source_has_license"), -1.0)))


def usefulness(c=F.col) -> Column:
    loc, api, names = c("loc"), c("api_surface_count"), c("function_names")
    generic = F.exists(names, lambda n: contains_any(F.lower(n), K.GENERIC_FUNCTIONS))
    clumsy = F.exists(names, lambda n: (F.length(n) > 25) | (F.length(n) - F.length(F.replace(n, F.lit("_"), F.lit(""))) > 3))
    score = F.lit(4.0) + steps((generic, 1.5), (clumsy, -1.0)) + steps((F.lower(stem(c("path"))).isin(K.USEFUL_STEMS), 1.0))
    score = score + steps((loc.between(50, 300), 1.0), (loc < 20, -1.5)) + steps((c("has_tests"), 0.5)) + steps((api >= 3, 1.0), (api == 1, -0.5))
    return clamp(score + steps((c("is_stdlib_only"), 0.5)) + steps((api == 0, -1.0)))


def maintainability(c=F.col) -> Column:
    ratio, cc, loc = c("comment_ratio"), c("complexity"), c("loc")
    score = F.lit(4.0) + steps((ratio >= 0.15, 2.0), (ratio >= 0.05, 1.0), ((ratio == 0) & (loc > 30), -1.5)) + steps((c("has_docstring"), 1.0))
    score = score + steps((cc <= 0, 0.0), (cc <= 5, 1.5), (cc <= 10, 0.5), (cc > 20, -2.0), (cc > 15, -1.0))
    score = score + steps((loc.between(50, 200), 1.0), (loc > 400, -0.5)) + large_file_penalty(loc)
    return clamp(score + steps((c("has_tests"), 0.5)))


def uniqueness(n_similar: Column) -> Column:
    """Of a negative number, which stands for unknown, 5."""
    return F.when(n_similar < 0, 5.0).when(n_similar == 0, 8.0).when(n_similar <= 2, 6.0).when(n_similar <= 5, 4.0).otherwise(2.0)


def project_demand(stars: Column, forks: Column, issues: Column) -> Column:
    """What one similar project says about demand."""
    ratio = stars / forks
    score = steps_of(stars > 0, F.least(F.lit(10.0), stars / 100.0)) + steps_of(forks > 0, F.least(F.lit(5.0), forks / 50.0)) + steps_of(issues > 0, F.least(F.lit(3.0), issues / 10.0))
    return score + F.when((stars > 0) & (forks > 0), F.when(ratio > 50, 0.0).when(ratio < 5, 1.5).otherwise(0.5)).otherwise(0.0)


def steps_of(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(0.0)


def demand(similar: Column) -> Column:
    """From an array of projects, best first: their mean weighted by 1 / rank; 5 for none."""
    weighed = F.transform(similar, lambda p, i: project_demand(p["stars"], p["forks"], p["open_issues"]) / (i + 1))
    total = F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x)
    weights = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(similar), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / i)
    return F.when(F.coalesce(F.size(similar), F.lit(0)) <= 0, 5.0).otherwise(F.least(F.lit(10.0), total / weights / 1.8))


def ship_effort(loc: Column) -> Column:
    out = F.when(loc < K.SHIP_EFFORT[0][0], K.SHIP_EFFORT[0][1])
    for most, hours in K.SHIP_EFFORT[1:]:
        out = out.when(loc < most, hours)
    return out.otherwise(K.SHIP_EFFORT[-1][1])


def combined(c=F.col) -> Column:
    out = None
    for dimension, weight in K.WEIGHTS.items():  # in this order, so that sums of doubles are the same
        out = weight * c(dimension) if out is None else out + weight * c(dimension)
    return clamp(F.when(c("relevance") < 3.0, out * 0.5).otherwise(out))


def score(candidates: DataFrame) -> DataFrame:
    """Adds the six dimensions, ship_effort_hours and combined_score. Columns similar_count
    (-1: unknown) and similar_projects are optional."""
    if "similar_count" not in candidates.columns:
        candidates = candidates.withColumn("similar_count", F.lit(-1))
    demand_signal = demand(F.col("similar_projects")) if "similar_projects" in candidates.columns else F.lit(5.0)
    scored = candidates.withColumns({
        "code_quality": code_quality(), "uniqueness": uniqueness(F.col("similar_count")), "demand_signal": demand_signal,
        "relevance": relevance(), "usefulness": usefulness(), "maintainability": maintainability(), "ship_effort_hours": ship_effort(F.col("loc")),
    })
    return scored.withColumn("combined_score", combined())
