"""Candidate detection: gates in order, signals of the files that pass them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalode.functions import constants as K
from stratalode.functions import languages as L
from stratalode.functions.text import contains_any, lines, matches, name, starts_any, strip
from stratalode.operators import graph, resolve, scan


def _share(array: Column, test) -> Column:
    return F.size(F.filter(array, test))


def documentation_lines(content: Column) -> Column:
    """Line ends inside triple-quoted texts that upper-case names of a Python file are set to."""
    found = matches(content, r"""(?smd)^\s*[A-Z][A-Z_]+\s*=\s*r?(?:\"\"\".*?\"\"\"|'''.*?''')""", 0)
    return F.aggregate(found, F.lit(0), lambda n, m: (n + F.length(m) - F.length(F.replace(m, F.lit("\n"), F.lit("")))).cast("int"))


def shape(ext: Column, content: Column, all_lines: Column, stripped: Column, loc: Column) -> Column:
    """What a content is made of, as far as it may be a reason to pass a file over."""
    total = F.size(all_lines)
    modifiers = "(public|private|protected|static|final|abstract|open|sealed|suspend|inline|override|async|synchronized|internal|fileprivate|companion)"
    function = rf"{L.UM}^\s*{modifiers}*\s*(def |func |fn |function |void |int |string |bool |var |let |const |public |private |protected )"
    classes = rf"{L.UM}^\s*(public|private|protected|static|final|abstract|open|sealed|internal|fileprivate|data|companion)*\s*(class |struct |interface |enum |trait |impl |object |protocol |record )"
    modules = _share(stripped, lambda s: starts_any(s, ["pub mod ", "pub(crate) mod "]))
    exports = _share(stripped, lambda s: starts_any(s, ["pub mod ", "pub use "]))
    constants = _share(all_lines, lambda x: x.rlike(L.U + r"^\s*[A-Z_][A-Z_0-9]*\s*="))
    legal = _share(F.slice(all_lines, 1, 30), lambda x: contains_any(F.lower(x), ["copyright", "licensed under", "apache license", "mit license", "permission is hereby granted"]))
    python, rust, documentation = ext == ".py", ext == ".rs", documentation_lines(content)
    return F.struct(
        (rust & (loc <= 30) & (modules >= loc * 0.5)).alias("modules"), (rust & (loc <= 30) & (exports >= loc * 0.5)).alias("exports"),
        ((loc < 20) & ~content.rlike(function) & ~content.rlike(classes)).alias("bare"), (python & (loc <= 50) & (constants >= loc * 0.6)).alias("constants"),
        # what costs most comes last: most contents are longer
        F.substring(content, 1, 500).contains("automatically generated by SWIG").alias("swig"), ((loc <= 15) & (total <= 40) & (legal >= total * 0.6)).alias("legal"),
        (python & (documentation > 0) & (documentation >= loc * 0.5) & (loc > 10)).alias("documentation"),
    )


# The texts of reasons, here and below.
def skip_reason(path: Column, shape: Column) -> Column:
    """Why a file is no real candidate, or null; the first rule that holds."""
    file = name(path)
    return (
        F.when(contains_any(F.lower(path), K.GENERATED_PATTERNS), "Generated/auto-generated file")
        .when((file == "mod.rs") & shape["modules"], "Rust mod.rs with only module declarations")
        .when((file == "lib.rs") & shape["exports"], "Rust lib.rs with only re-exports")
        .when(shape["bare"], "Under 20 LOC with no function/class definitions")
        .when(shape["constants"], "Mostly constant definitions")
        .when(path.endswith(".d.ts"), "TypeScript declaration file (.d.ts)")
        .when(shape["swig"], "SWIG auto-generated file")
        .when(shape["legal"], "Mostly copyright/license comments")
        .when(file.isin(K.CONFIG_NAMES), "Configuration file")
        .when(shape["documentation"], "Documentation-only file (string variables dominate)")
    )


def project_refs(content: Column) -> Column:
    """Any of the pieces, which hold nothing of a pattern but quoted dots: no pattern is tried at every character."""
    return reduce(or_, (content.contains(p.replace("\\.", ".")) for p in K.PROJECT_REFS))


def reasons(c=F.col) -> Column:
    """Why a candidate can be lifted out, in a fixed order."""
    loc, fan, cc, api, ext = c("loc"), c("fan_in"), c("complexity"), c("api_surface_count"), c("external_imports")
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    useful = F.get(F.filter(c("function_names"), lambda n: contains_any(F.lower(n), K.COMMON_PROBLEMS)), F.lit(0))
    siblings = F.array_join(F.transform(c("sibling_paths"), name), ", ")
    multi = c("extraction_type") == "multi"
    listed = F.array(
        F.when(c("has_tests"), "Has corresponding test file"),
        F.when(c("has_docstring"), "Has module-level documentation"),
        F.when(c("internal_imports") == 0, "Zero internal project imports — fully self-contained").when(c("internal_imports") == 1, "Only 1 internal import — loosely coupled"),
        F.when(ext <= 3, text("Small dependency footprint (", ext, " external import(s))")),
        F.when(loc < 50, text("Very small (", loc, " LOC)")).when(loc < 150, text("Manageable size (", loc, " LOC)")),
        F.when(c("filename_score") > 0, "Filename suggests a reusable utility"),
        F.when(fan == 0, "Zero fan-in (orphan) — nothing else depends on it").when(fan == 1, "Low fan-in (1 importer)"),
        F.when(c("in_cycle"), "⚠ Part of an import cycle — extraction requires breaking the cycle first"),
        F.when((cc > 0) & (cc <= 5), text("Low cyclomatic complexity (cc=", cc, ")")).when(cc > 15, text("⚠ High cyclomatic complexity (cc=", cc, ")")),
        F.when(c("is_stdlib_only"), "Stdlib-only — zero external dependencies, truly standalone").when(c("dependency_weight") >= 3, text("⚠ Heavy dependencies (weight=", c("dependency_weight"), ")")),
        F.when(api >= 3, text("Rich API surface (", api, " public functions/classes)")).when(api == 1, "⚠ Only 1 public function — snippet, not a full library"),
        F.when(c("has_project_specific_refs"), "⚠ References framework internals"),
        F.when(c("comment_ratio") >= 0.15, text("Well-commented (", F.bround(c("comment_ratio") * 100, 0).cast("int"), "% comment lines)")),
        F.when(useful.isNotNull(), text("Solves a common problem (function: ", useful, ")")),
        F.when((c("extraction_type") == "single") & (F.size(c("relative_imports")) == 0), "✓ Verified standalone — no relative imports, extractable as-is").when(multi, text("⚠ Multi-file extraction — also needs: ", siblings)),
        F.when(~c("source_has_license"), "⚠ Source repo has NO license file — extraction is legally risky"),
    )
    kept = F.filter(listed, lambda r: r.isNotNull())
    return F.when(F.size(kept) == 0, F.array(F.lit("Passed extractable heuristics"))).otherwise(kept)


def fenced(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that pass, whose columns are computed once each: a filter doesn't move below a
    column that is not deterministic, so what it reads is not written out again in it."""
    return df.withColumn("_fence", F.monotonically_increasing_id()).filter(condition & (F.col("_fence") >= 0)).drop("_fence")


def detect(files: DataFrame, has_license: DataFrame | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Candidates, active and skipped; see ``examine``."""
    return examine(files, has_license, whole)[0]


def file_keys(files: DataFrame) -> DataFrame:
    """(repo, path, ext, digest, gated) of files: the name of a content, and whether the path may be a candidate's."""
    return files.select("repo", "path", "ext", F.sha2("content", 256).alias("digest"), F.coalesce(scan.hard_gate(F.col("path"), F.col("ext")), F.lit(False)).alias("gated"))


def distinct_contents(files: DataFrame, keys: DataFrame) -> DataFrame:
    """(digest, ext, gated, content): each content once for an extension, whatever the number of its files. The
    first file of each is looked up among contents, which are dealt once and never sorted."""
    needed = keys.filter("gated OR ext = '.py'").groupBy("digest", "ext").agg(F.min(F.struct("repo", "path")).alias("at"), F.bool_or("gated").alias("gated"))
    firsts = needed.select("at.repo", "at.path", "digest", "gated")
    return files.select("repo", "path", "ext", "content").join(firsts.hint("shuffle_hash"), ["repo", "path"]).select("digest", "ext", "gated", "content")


def content_facts(contents: DataFrame) -> DataFrame:
    """All that detection takes from a content: (digest, ext, gated, content) -> digest, ext, gated, the names that
    a Python file imports and, where ``gated`` and of ten lines or more, its signals. Only contents that no rule
    of their own passes over go through a parser."""
    e = L.once("content_facts", _fact_expressions)
    base = contents.withColumns(e["family"]).withColumns(e["stripped"]).withColumns(e["loc"])
    base = fenced(fenced(base, F.lit(True)).withColumns(e["shape"]), F.lit(True)).withColumns(e["parsed"])
    return base.select("digest", "ext", "gated", *e["facts"])


def _fact_expressions() -> dict:
    """The columns of ``content_facts``, step by step."""
    col = F.col
    fam, gated = col("fam"), col("gated")
    worth = col("shape").isNotNull() & ~(col("shape.bare") | col("shape.constants") | col("shape.swig") | col("shape.legal") | col("shape.documentation"))
    signals = {
        "doc": L.told("doc", fam, col("parsed"), L.docstring(fam, col("lines"), col("stripped"))),
        "imports": L.external_imports(fam, col("lines")),
        "relative": L.told("relative", fam, col("parsed"), L.relative_imports(fam, col("content"))),
        "own_lines": L.internal_lines(fam, col("lines")), "roots": F.when(fam == "python", L.python_roots(col("lines"))).otherwise(F.array().cast("array<string>")),
        "function_names": L.told("names", fam, col("parsed"), L.public_api(fam, col("content"))),
        "cc": L.told("complexity", fam, col("parsed"), L.complexity(fam, col("content"))).cast("int"),
        "refs": project_refs(col("content")), "ratio": L.comment_ratio(fam, col("stripped")), "first_lines": F.array_join(F.slice("lines", 1, 30), "\n"),
    }
    names = F.when(col("ext") == ".py", graph.import_names(col("content"))).alias("names")
    return {
        "family": {"fam": L.family(col("ext")), "lines": F.when(gated, lines(col("content")))}, "stripped": {"stripped": F.transform("lines", strip)},
        "loc": {"loc": F.when(gated, L.logical_loc(fam, col("stripped")))},
        "shape": {"shape": F.when(col("loc") >= 10, shape(col("ext"), col("content"), col("lines"), col("stripped"), col("loc")))},
        "parsed": {"parsed": L.parsed(fam, F.when(worth & fam.isin(L.by_parser()), col("content")))},
        "facts": [names, col("loc"), col("shape"), col("parsed.err").alias("err"), *(F.when(worth, c).alias(n) for n, c in signals.items())],
    }


def examine(files: DataFrame, has_license: DataFrame | None = None, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates, active and skipped, one row per file that passes the hard gates; and the files that
    made a parser fail (repo, path, error), which are no candidates.

    ``has_license`` (repo, has_license) may come from a scan before a language filter;
    ``whole`` are the files that siblings, tests and the graph are looked for in. Each distinct content is
    looked at once, however many files have it, and everything else comes from narrow tables.
    """
    everything = files if whole is None else whole
    keys = graph.cut_lineage(file_keys(everything))
    facts = graph.cut_lineage(content_facts(distinct_contents(everything, keys)))
    wanted = keys if whole is None else keys.join(files.select("repo", "path"), ["repo", "path"], "left_semi")
    return judged(wanted, facts, keys, has_license)


#: Parts that a repository's rows are dealt into where something is told of the whole repository.
SALTS = 256


def told_by_repo(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``rows`` (repo, path, ...) with what ``told`` has for their repository, a row for each. A repository's
    rows are dealt by their path too, and what is told of it is sent to all parts."""
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
    parts = told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(parts, ["repo", "_salt"], "left").drop("_salt")


def judged(wanted: DataFrame, facts: DataFrame, keys: DataFrame, has_license: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``examine`` returns for the files ``wanted``, from keys of files and facts of contents alone;
    ``keys`` are all files of their repositories."""
    col = F.col
    fam, paths = col("fam"), keys
    told = wanted.filter("gated").join(facts.drop("gated", "names").filter("loc >= 10"), ["digest", "ext"])
    told = told.withColumns({"language": L.language(col("ext")), "fam": L.family(col("ext")), "skip_reason": skip_reason(col("path"), col("shape"))})
    told = graph.cut_lineage(told.drop("digest", "ext", "shape", "gated"))
    early = told.filter("skip_reason IS NOT NULL").select("repo", "path", "language", "loc", "skip_reason")
    errors = told.filter("skip_reason IS NULL AND err IS NOT NULL").select("repo", "path", col("err").alias("error"))
    live = told.filter("skip_reason IS NULL AND err IS NULL").drop("skip_reason", "err")
    named = keys.filter("ext = '.py'").select("repo", "path", "digest", "ext").join(facts.filter(F.size("names") > 0).select("digest", "ext", "names"), ["digest", "ext"])
    imports = graph.linked(named.select("repo", "path", "names"), paths)
    key = ["repo", "path"]
    inside = resolve.internal_of_python(live.select(*key, "roots"), resolve.project_modules(paths))
    joined = (
        live.join(inside, key, "left").join(resolve.tested(paths).withColumn("tested", F.lit(True)), key, "left")
        .join(graph.fan_in(paths, imports), key, "left").join(graph.import_cycles(imports).select(*key, F.lit(True).alias("cyclic")), key, "left")
        .join(resolve.resolve_siblings(live.select(*key, "fam", "relative"), paths), key, "left")
    )
    empty = F.array().cast("array<string>")
    row = joined.withColumns({
        "has_tests": F.coalesce("tested", F.lit(False)), "has_docstring": col("doc") != "",
        "internal_imports": (col("own_lines") + F.coalesce("internal", F.lit(0))).cast("int"), "external_imports": F.size("imports"),
        "filename_score": scan.filename_score(col("path")), "fan_in": F.coalesce("fan_in", F.lit(-1)),
        "missing_siblings": F.coalesce("missing", empty), "found": F.coalesce("sibling_paths", empty), "names": F.coalesce("names", empty),
    })
    gate = (
        F.when(col("internal_imports") >= 2, F.concat(col("internal_imports").cast("string"), F.lit(" internal imports — tightly coupled")))
        .when(col("fan_in") > 50, F.concat(F.lit("High inbound fan-in ("), col("fan_in").cast("string"), F.lit(" importers) — too tightly coupled")))
        .when(col("filename_score") < -0.5, "Filename is a framework entry point")
        .when(F.size("missing_siblings") > 0, F.concat(F.lit("References missing sibling(s): "), F.array_join("missing_siblings", ", ")))
    )
    # written: the gate's expressions are not repeated in every column that depends on it
    row = graph.cut_lineage(row.withColumn("skip_reason", gate).drop("roots", "own_lines", "tested", "missing", "relative"))
    active, blocked = col("skip_reason").isNull(), col("skip_reason").startswith("References missing")
    on = lambda value, otherwise: F.when(active, value).otherwise(otherwise)
    weight = L.once("weight of imports", lambda: L.dependency_weight(F.col("fam"), F.col("imports")))
    late = row.select(
        "repo", "path", "language", "loc", "has_tests", "has_docstring", "internal_imports", "external_imports", "filename_score",
        on(col("doc"), "").alias("docstring_snippet"), on(col("first_lines"), "").alias("first_lines"),
        on(col("cc"), 0).alias("complexity"), on(col("fan_in"), -1).alias("fan_in"), on(F.coalesce("cyclic", F.lit(False)), False).alias("in_cycle"),
        on(weight["weight"], 0).alias("dependency_weight"), on(F.size("function_names"), 0).alias("api_surface_count"),
        on(weight["stdlib_only"], False).alias("is_stdlib_only"), on(col("refs"), False).alias("has_project_specific_refs"),
        on(col("function_names"), empty).alias("function_names"), on(col("ratio"), 0.0).alias("comment_ratio"),
        F.when(active | blocked, col("names")).otherwise(empty).alias("relative_imports"), on(col("found"), empty).alias("sibling_paths"),
        F.when(blocked, col("missing_siblings")).otherwise(empty).alias("missing_siblings"),
        F.when(blocked, "blocked").when(active & (F.size("found") > 0), "multi").otherwise("single").alias("extraction_type"),
        (~active).alias("skipped"), F.coalesce("skip_reason", F.lit("")).alias("skip_reason"),
    )
    none = {"has_tests": F.lit(False), "has_docstring": F.lit(False), "internal_imports": F.lit(0), "external_imports": F.lit(0), "filename_score": F.lit(0.0),
            "docstring_snippet": F.lit(""), "first_lines": F.lit(""), "complexity": F.lit(0), "fan_in": F.lit(-1), "in_cycle": F.lit(False), "dependency_weight": F.lit(0),
            "api_surface_count": F.lit(0), "is_stdlib_only": F.lit(False), "has_project_specific_refs": F.lit(False), "function_names": empty, "comment_ratio": F.lit(0.0),
            "relative_imports": empty, "sibling_paths": empty, "missing_siblings": empty, "extraction_type": F.lit("single"), "skipped": F.lit(True)}
    everything = late.unionByName(early.withColumns(none))
    licenses = scan.licenses(paths) if has_license is None else has_license
    out = told_by_repo(everything, licenses).withColumn("source_has_license", F.coalesce("has_license", F.lit(False))).drop("has_license")
    return graph.cut_lineage(out).withColumn("why_extractable", F.when(col("skipped"), empty).otherwise(L.once("reasons", reasons))), errors
