"""Similar projects: parsed responses, the best few for each candidate, what sets it apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECT = "full_name string, html_url string, stars long, description string, pushed_at string, license string, open_issues long, forks long, language string"
_ITEM = "full_name string, html_url string, stargazers_count long, description string, pushed_at string, license struct<spdx_id:string>, open_issues_count long, forks_count long, language string"


def parse_response(body: Column) -> Column:
    """array<struct<project>> of a search response; items without name, address or stars, and
    responses that are no objects, give nothing."""
    raw = F.coalesce(F.from_json(body, "items array<string>")["items"], F.array().cast("array<string>"))
    items = F.transform(raw, lambda i: F.from_json(i, _ITEM))  # one by one: a broken item spoils no other
    sound = F.filter(items, lambda i: i["full_name"].isNotNull() & i["html_url"].isNotNull() & i["stargazers_count"].isNotNull())
    return F.transform(sound, lambda i: F.struct(
        i["full_name"].alias("full_name"), i["html_url"].alias("html_url"), i["stargazers_count"].alias("stars"),
        F.trim(F.coalesce(i["description"], F.lit(""))).alias("description"), F.substring(F.coalesce(i["pushed_at"], F.lit("")), 1, 10).alias("pushed_at"),
        F.when(i["license"].isNull(), "?").otherwise(i["license"]["spdx_id"]).alias("license"), F.coalesce(i["open_issues_count"], F.lit(0)).alias("open_issues"),
        F.coalesce(i["forks_count"], F.lit(0)).alias("forks"), F.coalesce(i["language"], F.lit("")).alias("language"),
    ))


def similar_projects(candidates: DataFrame, projects: DataFrame, asof: str, min_stars: int = 5, limit: int = 5, days: int = 730) -> DataFrame:
    """candidates (repo, path, language, query), projects (those columns and tokens, an array)
    -> (repo, path, rank, project columns): of one language, sharing a word of the query,
    starred and pushed lately; most stars first, then by name."""
    words = candidates.select("repo", "path", "language", F.explode(F.array_distinct(F.split(F.lower("query"), "\\s+"))).alias("token"))
    since = F.date_sub(F.lit(asof).cast("date"), days).cast("string")
    live = projects.filter((F.col("stars") >= min_stars) & (F.col("pushed_at") >= since))
    offered = live.withColumn("token", F.explode(F.array_distinct("tokens"))).drop("tokens")
    best = [F.desc("stars"), F.col("full_name")]
    # only the first few of a word can be among a candidate's first few
    offered = offered.withColumn("place", F.row_number().over(Window.partitionBy("language", "token").orderBy(*best))).filter(F.col("place") <= limit).drop("place")
    met = words.join(offered, ["language", "token"]).drop("token").distinct()
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("repo", "path").orderBy(*best))).filter(F.col("rank") <= limit)


def with_similar(candidates: DataFrame, projects: DataFrame, asof: str, min_stars: int = 5, limited: DataFrame | None = None) -> DataFrame:
    """Candidates (with a query) and what was found for them: similar_projects (best first), similar_count
    and search_status. ``limited`` (repo, path) are those whose search was refused: their count is -1,
    which stands for unknown. Skipped candidates are not searched for."""
    asked = candidates.filter("NOT skipped").select("repo", "path", "language", "query")
    if limited is not None:
        asked = asked.join(limited.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    fields = ["full_name", "html_url", "stars", "description", "pushed_at", "license", "open_issues", "forks", "language"]
    top = similar_projects(asked, projects, asof, min_stars).select("repo", "path", F.struct("rank", *(fields)).alias("p"))
    listed = top.groupBy("repo", "path").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.dropFields("rank")).alias("similar_projects"))
    out = candidates.join(listed, ["repo", "path"], "left")
    if limited is not None:
        out = out.join(limited.select("repo", "path", F.lit(True).alias("_refused")).distinct(), ["repo", "path"], "left")
    else:
        out = out.withColumn("_refused", F.lit(None).cast("boolean"))
    status = F.when(F.col("skipped"), "none").when(F.col("_refused"), "rate_limited").otherwise("ok")
    count = F.when(status == "ok", F.coalesce(F.size("similar_projects"), F.lit(0))).otherwise(-1)
    return out.withColumns({"search_status": status, "similar_count": count.cast("int")}).drop("_refused")


def rate_limited(candidates: DataFrame) -> DataFrame:
    """(repo, rate_limited): candidates whose search was refused."""
    return candidates.groupBy("repo").agg(F.count_if(F.col("search_status") == "rate_limited").alias("rate_limited"))


def months_since(pushed_at: Column, asof: str) -> Column:
    """Whole months of 30 days; null if it is no date of the form 2024-01-31."""
    date = F.when(pushed_at.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(pushed_at, "yyyy-M-d"))
    return F.floor(F.datediff(F.lit(asof).cast("date"), date) / 30).cast("int")


def differentiators(language: Column, has_tests: Column, similar: Column, asof: str, limited: Column | None = None) -> Column:
    """What sets a candidate apart from similar projects, best first; ``limited``: the search was refused."""
    top, n = F.get(similar, F.lit(0)), F.coalesce(F.size(similar), F.lit(0))
    months = months_since(top["pushed_at"], asof)
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    stale = F.size(F.filter(similar, lambda p: F.coalesce(months_since(p["pushed_at"], asof) > 12, F.lit(False))))
    listed = F.filter(F.array(
        F.when(top["stars"] > 1000, text("Top result (", top["full_name"], ") has ", F.format_number(top["stars"], 0), " stars — need clear advantage"))
        .when(top["stars"] < 50, text("Closest match (", top["full_name"], ") has only ", top["stars"], " stars — underserved space")),
        F.when((language != "") & (top["language"] != "") & (language != top["language"]), text("Yours is ", language, ", top result is ", top["language"])),
        F.when(months > 12, text(top["full_name"], " hasn't been pushed in ", months, " months — maintenance gap"))
        .when(months < 3, text(top["full_name"], " actively maintained — study for differentiation")),
        F.when(has_tests & (top["open_issues"] > 20), text("Yours has tests, ", top["full_name"], " has ", top["open_issues"], " open issues — reliability advantage")),
        F.when((n >= 3) & (stale >= n * 0.6), text(stale, "/", n, " similar projects stale — clear opening")),
    ), lambda d: d.isNotNull())
    some = F.when(F.size(listed) > 0, listed).otherwise(F.array(text("Compare with ", top["full_name"], " (", top["stars"], " stars) for differentiation")))
    out = F.when(n == 0, F.array(F.lit("No similar projects found — potential first-mover opportunity"))).otherwise(some)
    return out if limited is None else F.when(limited, F.array(F.lit("Search rate-limited — uniqueness unknown (treated as neutral 5.0)"))).otherwise(out)
