"""Joins between files: siblings of relative imports, tests of sources, project modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalode.functions import constants as K
from stratalode.functions.languages import RULES
from stratalode.functions.text import ancestors, in_folder, name, parent, parts, stem, suffix
from stratalode.sources.tables import cut_lineage

def sibling_paths(path: Column, fam: Column, sibling: Column, level: Column) -> Column:
    """Paths a relative import may mean, first choice first; empty above the root."""
    cut = parts(path)
    depth = F.size(cut) - F.greatest(level, F.lit(1))
    folder = F.when(depth > 0, F.array_join(F.slice(cut, 1, F.greatest(depth, F.lit(0))), "/")).otherwise("")
    none = F.array().cast("array<string>")
    out = None
    for f, forms in ((f, rules.siblings) for f, rules in RULES.items() if rules.siblings):
        made = F.array(*(in_folder(folder, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in (sibling, form[2:])))) for form in forms))
        out = F.when(fam == f, made) if out is None else out.when(fam == f, made)
    return F.when((depth <= 0) & (level > F.size(cut)), none).otherwise(out.otherwise(none))


def resolve_siblings(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (repo, path, fam, relative array<struct<name, level>>) -> (repo, path, names,
    sibling_paths, missing): one row for each file that has a relative import."""
    one = imports.select("repo", "path", "fam", F.posexplode("relative").alias("pos", "item"))
    choice = one.select("repo", "path", "pos", F.col("item.name").alias("name"), F.posexplode_outer(sibling_paths(F.col("path"), F.col("fam"), F.col("item.name"), F.col("item.level"))).alias("rank", "target"))
    there = files.select("repo", F.col("path").alias("target"), F.lit(True).alias("there")).distinct()
    best = choice.join(there, ["repo", "target"], "left").groupBy("repo", "path", "pos").agg(
        F.first("name").alias("name"), F.min(F.when(F.col("there"), F.struct("rank", "target"))).alias("hit")
    )
    row = F.array_sort(F.collect_list(F.struct("pos", "name", F.col("hit.target").alias("target"))))
    listed = best.groupBy("repo", "path").agg(row.alias("found"))
    return listed.select(
        "repo", "path", F.transform("found", lambda x: x["name"]).alias("names"),
        F.transform(F.filter("found", lambda x: x["target"].isNotNull()), lambda x: x["target"]).alias("sibling_paths"),
        F.transform(F.filter("found", lambda x: x["target"].isNull()), lambda x: x["name"]).alias("missing"),
    )


def tested(files: DataFrame) -> DataFrame:
    """(repo, path) of files that have a test: one beside the file, or one in a test folder of the file's
    own folder or of one above it. Folder and name are join keys, so namesakes elsewhere never meet.

    A file's name says what it may be a test of, so a file travels once for itself and each folder above, not
    once for each name that a test of it may have. Paths are written once, dealt evenly: tasks of very different
    sizes would stay so in the joins."""
    path, folder = F.col("path"), F.col("at")
    files = cut_lineage(files.select("repo", "path").repartition("repo", "path"))
    above = F.array_distinct(F.concat(F.array(parent(path)), ancestors(path), F.array(F.lit(""))))
    beside = files.select("repo", "path", parent(path).alias("at"), name(path).alias("file")).filter("at != ''")
    own = files.select("repo", "path", name(path).alias("file"), F.explode(above).alias("at"))
    there = files.select("repo", parent(path).alias("at"), name(path).alias("file"))
    near = there.select("repo", "at", F.explode(tested_names(F.col("file"))).alias("file"))
    in_tests = there.filter(F.element_at(parts(folder), -1).isin(K.TEST_SUBDIRS))
    in_tests = in_tests.select("repo", parent(folder).alias("at"), F.explode(F.concat(tested_names(F.col("file")), F.array("file"))).alias("file"))
    keys = ["repo", "at", "file"]
    found = beside.join(near.distinct(), keys, "left_semi").select("repo", "path").unionByName(own.join(in_tests.distinct(), keys, "left_semi").select("repo", "path"))
    return found.distinct()


TEST_ENDS = ("_test", "Test", ".test", ".spec")


def _named_like(s: Column, e: Column) -> Column:
    """What a test of the file with stem and suffix may be called, beside it."""
    return F.array(F.concat(F.lit("test_"), s, e), *(F.concat(s, F.lit(end), e) for end in TEST_ENDS))


def tested_names(file: Column) -> Column:
    """The names of files that a file of this name may be a test of."""
    s, e = stem(file), suffix(file)
    made = [F.when(file.startswith("test_"), F.substring(file, 6, 1 << 30))]
    for end in TEST_ENDS:
        cut = lambda c, end=end: F.when(c.endswith(end), F.substr(c, F.lit(1), F.length(c) - len(end)))
        # the mark stands before the suffix, or at the very end of a file that has none
        made += [F.concat(cut(s), e), F.when(e != "", cut(file))]
    found = F.array_distinct(F.array_compact(F.array(*made)))
    return F.filter(found, lambda n: F.array_contains(_named_like(stem(n), suffix(n)), file))


def project_modules(files: DataFrame) -> DataFrame:
    """(repo, module): what a repository's Python files can be imported as, by their first name."""
    cut = parts(F.col("path"))
    root = F.size(cut) == 1
    of = F.when(root, F.array(stem(F.col("path")))).otherwise(F.array(cut[0], F.when(name(F.col("path")) == "__init__.py", F.get(cut, F.size(cut) - 2))))
    return files.filter("ext = '.py'").select("repo", F.explode(of).alias("module")).filter("module IS NOT NULL").distinct()


def internal_of_python(roots: DataFrame, modules: DataFrame) -> DataFrame:
    """roots (repo, path, roots: first names of import lines) -> (repo, path, internal): lines of the project's own modules."""
    one = roots.select("repo", "path", F.explode("roots").alias("module"))
    return one.join(modules, ["repo", "module"], "left_semi").groupBy("repo", "path").agg(F.count("*").cast("int").alias("internal"))
