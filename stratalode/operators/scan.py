"""Which files a scan keeps, and what holds for a whole repository.

Files are rows (repo, path, ext, size, content, loc); every operator keeps repositories
apart, so one job runs over any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalode.functions import constants as K
from stratalode.functions.languages import language
from stratalode.functions.text import any_part, contains_any, name, starts_any, stem, strings


def kept_path(path: Column, ext: Column) -> Column:
    """Not in a skipped folder, of no skipped kind, neither hidden nor generated."""
    hidden = name(path).startswith(".") & ~name(path).endswith(".example")
    return ~any_part(path, K.SKIP_DIRS) & ~F.lower(ext).isin(K.SKIP_EXTS) & ~hidden & ~contains_any(F.lower(path), K.GENERATED_PATTERNS)


def without_bom(content: Column) -> Column:
    return F.regexp_replace(content, "^\\x{feff}", "")


def generated_header(content: Column) -> Column:
    return F.substring(content, 1, 500).rlike(K.GENERATED_HEADER)


def scan_filter(files: DataFrame) -> DataFrame:
    """The rows a scan keeps; a leading byte-order mark goes."""
    return files.filter(kept_path(F.col("path"), F.col("ext"))).withColumn("content", without_bom(F.col("content"))).filter(~generated_header(F.col("content")))


def of_language(files: DataFrame, wanted: str) -> DataFrame:
    """Files of one language, before detection: other files become invisible to it."""
    return files.filter(F.lower(language(F.col("ext"))) == wanted.lower())


def loc_by_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language(F.col("ext"))).filter("language IS NOT NULL").groupBy("repo", "language").agg(F.sum("loc").cast("long").alias("loc"), F.count("*").alias("files"))


def primary_language(files: DataFrame) -> DataFrame:
    """(repo, language) with most lines; of equals the first by name; 'Unknown' without any."""
    best = loc_by_language(files).groupBy("repo").agg(F.min_by("language", F.struct(-F.col("loc"), F.col("language"))).alias("language"))
    return files.select("repo").distinct().join(best, "repo", "left").select("repo", F.coalesce("language", F.lit("Unknown")).alias("language"))


def is_license(path: Column) -> Column:
    low = F.lower(path)
    bare = F.regexp_replace(low, "\\.(md|txt|rst|less|lesser)$", "")
    named = low.isin(K.LICENSE_NAMES) | bare.isin(K.LICENSE_STEMS) | starts_any(low, ["license-", "license."])
    return ~path.contains("/") & ~path.contains("\\") & named


def licenses(files: DataFrame) -> DataFrame:
    """(repo, has_license): a file at the root is named like a licence."""
    return files.groupBy("repo").agg(F.coalesce(F.bool_or(is_license(F.col("path"))), F.lit(False)).alias("has_license"))


def hard_gate(path: Column, ext: Column) -> Column:
    """May be a candidate by its path: of a known language, no test, no special name, no route."""
    test = any_part(path, K.TEST_DIRS) | contains_any(F.lower(stem(path)), K.TEST_STEM_PARTS)
    return language(ext).isNotNull() & ~test & ~name(path).isin(K.NEVER_CANDIDATES) & ~framework_route(path)


def framework_route(path: Column) -> Column:
    return any_part(path, K.FRAMEWORK_DIRS) | name(path).isin(K.FRAMEWORK_SPECIAL_FILES)


def filename_score(path: Column) -> Column:
    low = F.lower(stem(path))
    # the stem is made once, not once for each pattern
    out = 0.5 * F.get(F.transform(F.array(low), lambda s: F.size(F.filter(strings(K.UTILITY_PATTERNS), lambda p: s.contains(p)))), F.lit(0))
    out = out - F.when(low.isin(K.FRAMEWORK_ENTRY_NAMES), 3.0).otherwise(0.0)
    return out - F.when(contains_any(low, ["test", "spec"]), 2.0).otherwise(0.0)


def parse_repo_arg(arg: Column) -> Column:
    """struct<owner, name, error>: owner/name, a web address or a git@ address of the one known host."""
    text = F.trim(arg)
    ssh, web = text.startswith("git@"), text.startswith("http")
    host = F.regexp_extract(text, "^[^:/?#]+://([^/?#]*)", 1)
    tail = (
        F.when(ssh, F.regexp_replace(F.replace(F.substring_index(text, ":", -1), F.lit(".git"), F.lit("")), "^/+|/+$", ""))
        .when(web, F.regexp_replace(F.regexp_replace(F.regexp_extract(text, "^[^:/?#]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", ""), "\\.git$", ""))
        .otherwise(F.regexp_replace(text, "\\.git$", ""))
    )
    cut = F.split(tail, "/")
    wrong_host = (ssh & ~text.contains("github.com")) | (web & ~ssh & ~host.isin("github.com", "www.github.com"))
    fits = (F.size(cut) == 2) & (F.get(cut, F.lit(0)) != "") & (F.get(cut, F.lit(1)) != "")
    error = F.when(F.coalesce(text, F.lit("")) == "", "empty").when(wrong_host, "host").when(~fits, "form")
    return F.struct(F.when(error.isNull(), cut[0]).alias("owner"), F.when(error.isNull(), F.get(cut, F.lit(1))).alias("name"), error.alias("error"))


def write_scopes(header: Column) -> Column:
    """The scopes of a comma-separated list that may write."""
    listed = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.filter(listed, lambda s: F.array_contains(strings(K.WRITE_SCOPES), s) | starts_any(s, K.WRITE_PREFIXES))


def scope_check(status: Column, header: Column, login: Column, failure: Column | None = None) -> Column:
    """struct<ok, user, error, warning, is_classic> of an answer to a token check: its status, scopes header
    and login, or ``failure``, the message of a request that got no answer. A token without a scopes
    header is fine-grained: what it may do can't be read from the answer, so it passes with a warning."""
    header = F.coalesce(header, F.lit(""))
    offending = write_scopes(header)
    error = (
        F.when(status == 401, "token is invalid or expired").when(status == 403, "token may not read the user")
        .when(status != 200, F.concat(F.lit("unexpected status: "), status.cast("string")))
        .when(F.size(offending) > 0, F.concat(F.lit("token may write: "), F.array_join(offending, ", ")))
    )
    if failure is not None:
        error = F.when(failure.isNotNull(), F.concat(F.lit("network error: "), failure)).otherwise(error)
    answered = F.coalesce(status == 200, F.lit(False)) & (F.lit(True) if failure is None else failure.isNull())
    classic = answered & (header != "")
    return F.struct(
        error.isNull().alias("ok"), F.when(error.isNull(), login).alias("user"), error.alias("error"),
        F.when(error.isNull() & ~classic, "fine-grained token: its scopes cannot be verified").alias("warning"), classic.alias("is_classic"),
    )


def redact(message: Column, token: Column) -> Column:
    """A message without the token in it."""
    return F.when(F.coalesce(token, F.lit("")) == "", message).otherwise(F.replace(message, token, F.lit("***")))
