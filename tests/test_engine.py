"""Exact values of language rules, joins, gates and scores."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratalode.functions import languages as L
from stratalode.functions.text import lines, parent, physical_loc, slug, stem, strip, suffix
from stratalode.operators import candidates, describe, extract, graph, naming, report, resolve, scan, scoring, search
from stratalode.sources.files import from_directory, from_table


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("x")).first()["x"]


def code(spark, ext, content, make):
    df = spark.createDataFrame([(ext, content)], "ext string, content string").withColumns({"fam": L.family(F.col("ext")), "lines": lines(F.col("content"))})
    return df.withColumn("stripped", F.transform("lines", strip)).select(make(F.col("fam"), F.col("content"), F.col("lines"), F.col("stripped")).alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k", "\n\n", "\r\n"])
def test_lines_as_python_has_them(spark, text):
    assert one(spark, text, lines) == text.splitlines()
    assert one(spark, text, physical_loc) == text.count("\n") + bool(text and not text.endswith("\n"))


def test_paths(spark):
    from pathlib import PurePosixPath as Path

    for p in ("a.py", "d/e/a.test.ts", ".env", "d/.env.example", "x", "a/b.tar.gz", "d/e"):
        assert (one(spark, p, stem), one(spark, p, suffix)) == (Path(p).stem, Path(p).suffix)
        assert one(spark, p, parent) == ("" if str(Path(p).parent) == "." else str(Path(p).parent))
    assert one(spark, "Foo_Bar--x.", slug) == "foo-bar-x"


@pytest.mark.parametrize(("ext", "content", "loc"), [
    (".py", "x = 1\n# note\n#\n\ny = 2\n", 3), (".cpp", "/* a\n b\n*/\n#include <x>\nint a;\nint b; /* open\nstill */\nint c;\n", 4), (".java", "/**\n * doc\n */\nint a;\n * stray\n", 1),
    (".py", "def f(*args):\n    *a, b = x\n", 2), (".rb", "# c\nx\n", 1), (".go", "a /* b */\n// c\n", 1), (".py", "s = '/*'\nlost = 1\nend = '*/'\nx = 1\n", 2),
])
def test_logical_loc(spark, ext, content, loc):
    assert code(spark, ext, content, lambda f, c, ls, s: L.logical_loc(f, s)) == loc


@pytest.mark.parametrize(("ext", "content", "expected"), [
    (".py", "import os, sys\nfrom a.b import c\nfrom . import d\nimport os\n", ["os", "a"]), (".ts", "import x from '@scope/pkg';\nimport y from './y';\nconst z = require(\"lodash\");\nimport q from 'lodash.get';\n", ["scope", "lodash"]),
    (".go", 'import "fmt"\n\t"net/http"\n\t"github.com/x/y"\n', ["net/http", "github.com/x/y"]), (".rs", "use std::fmt;\nuse crate::a;\nuse serde::Serialize;\n", ["std", "serde"]),
    (".java", "import java.util.List;\nimport static org.junit.Assert.*;\nimport com.foo.Bar;\n", ["com"]), (".kt", "import kotlin.math\nimport kotlinx.coroutines.Job\nimport a.B as C\n", ["kotlinx", "a"]),
    (".c", '#include <stdio.h>\n#include <boost/any.hpp>\n#include "dir/own.h"\n', ["boost", "dir"]), (".cs", "using System.IO;\nusing Microsoft.X;\nglobal using Foo.Bar;\nusing A = Baz.Q;\n", ["Foo", "Baz"]),
    (".rb", "require 'json/add'\nrequire_relative 'x'\n", ["json"]), (".php", "use \\Foo\\Bar;\nuse Baz\\Q;\n", ["Foo", "Baz"]), (".swift", "import UIKit\nimport Alamofire\n", ["Alamofire"]),
])
def test_external_imports(spark, ext, content, expected):
    assert code(spark, ext, content, lambda f, c, ls, s: L.external_imports(f, ls)) == expected


@pytest.mark.parametrize(("ext", "content", "expected"), [
    (".ts", "export default function a() {}\nexport const b = 1\nexport class a {}\nfunction c() {}\n", ["a", "b"]), (".go", "func Do() {}\nfunc do() {}\ntype Box struct {}\nfunc (r R) Skip() {}\n", ["Do", "Box"]),
    (".rs", "pub fn a() {}\nfn b() {}\npub struct C;\n", ["a", "C"]), (".java", "public class A {\n  public static int b(int c) {\n  private int d() {\n", ["A", "b"]), (".kt", "fun a() {}\nprivate fun b() {}\ndata class C(val x: Int)\n", ["a", "C"]),
    (".h", "int add(int a) {\n}\nstatic int own(int a) {\n}\nint sub(int b);\nint add(int a);\n", ["add", "sub"]), (".rb", "def self.a\nend\nmodule B\nend\n", ["a", "B"]), (".php", "public function a() {}\nprivate function b() {}\nfinal class C {}\n", ["a", "C"]),
    (".swift", "func a() {}\nfileprivate func b() {}\nstruct C {}\n", ["a", "C"]),
])
def test_public_api(spark, ext, content, expected):
    assert code(spark, ext, content, lambda f, c, ls, s: L.public_api(f, c)) == expected


def test_complexity(spark):
    made = lambda f, c, ls, s: L.complexity(f, c)
    assert code(spark, ".ts", "if (a) {}\nx ?? y", made) == 4 and code(spark, ".go", "if a && b {}\nfor x {}", made) == 4
    assert code(spark, ".rb", "if a\nelsif b\nend", made) == 3 and code(spark, ".rs", "loop { match x {} }", made) == 3 and code(spark, ".c", "int a;", made) == 1


def test_python_trees():
    assert L.python_tree("def a():\n    if x and y or z: pass\nclass B:\n    def c(self): return [i for i in x if i]\ndef _d(): pass\n") == (["a", "B", "c"], 6)
    assert L.python_tree("def (") == ([], 0)
    assert L.python_relative("from . import a, b as c\nfrom ..d.e import f\nfrom .g import (h,\n  i)\nx = 'from . import z'\nfrom . import (j, # k\n  l)\nfrom .g import m\nfrom . import *\n") == [("a", 1), ("b", 1), ("d", 2), ("g", 1), ("j", 1), ("l", 1)]


@pytest.mark.parametrize(("ext", "content", "expected"), [
    (".py", '#!/x\n# c\n"""Doc."""\n', '"""Doc."""'), (".py", "'''a\nb\n'''\nx\n", "'''a\nb\n'''"), (".py", "x = 1\n'''a'''\n", ""), (".js", "// x\n/** a\n * b */\nc\n", "/** a\n * b */"), (".js", "/* x */\n", ""),
    (".java", "package a;\n/* x */\nclass A {}\n", "/* x */"), (".rs", "use x;\n//! a\n//! b\nfn c() {}\n//! d\n", "//! a\n//! b"), (".rb", "# frozen_string_literal: true\n# a\n# b\nx\n# c\n", "# a\n# b"), (".rb", "x\n=begin\na\n=end\ny\n", "=begin\na\n=end"),
    (".cs", "using A;\nclass B {\n/// x\n/// y\n", "/// x\n/// y"), (".php", "<?php\nnamespace A;\n/** x */\n", "/** x */"),
])
def test_docstrings(spark, ext, content, expected):
    assert code(spark, ext, content, lambda f, c, ls, s: L.docstring(f, ls, s)) == expected


def test_go_docs():
    assert L.go_doc("// Package a does x.\n\npackage a\n") == "// Package a does x."
    assert L.go_doc("// Copyright me\npackage a\n\n// Do does.\n// More.\nfunc Do() {}\n") == "Do does.\nMore."
    assert L.go_doc("func Do() {}\n") == ""


def test_relative_imports_of_scripts(spark):
    made = lambda f, c, ls, s: F.transform(L.relative_imports(f, c), lambda x: F.concat_ws(":", x["name"], x["level"].cast("string")))
    assert code(spark, ".ts", "import a from './a.js'\nimport b from '../../d/b'\nimport c from './c/index'\nimport e from './index'\n", made) == ["a:1", "b:3", "c:1"]
    assert code(spark, ".rs", "use super::a::b;\nuse crate::c;\n", made) == ["a:2"] and code(spark, ".rs", "// x\nuse super::a;\n", made) == []


def files(spark, rows, repo="o/r"):
    return from_table(spark.createDataFrame([(repo, p, c) for p, c in rows], "repo string, path string, content string"))


def test_siblings_and_tests(spark):
    table = files(spark, [("p/a.py", ""), ("p/b/__init__.py", ""), ("c.py", ""), ("p/x.ts", ""), ("p/y/index.js", ""), ("tests/test_a.py", ""), ("p/q/r.py", ""), ("p/tests/r.py", ""), ("t.py", ""), ("test_t.py", ""), ("p/x.spec.ts", "")])
    rel = spark.createDataFrame([("o/r", "p/a.py", "python", [("b", 1), ("c", 2), ("zz", 1), ("c", 5)]), ("o/r", "p/x.ts", "js", [("y", 1)])], "repo string, path string, fam string, relative array<struct<name:string,level:int>>")
    got = {r["path"]: (r["sibling_paths"], r["missing"]) for r in resolve.resolve_siblings(rel, table).collect()}
    assert got == {"p/a.py": (["p/b/__init__.py", "c.py"], ["zz", "c"]), "p/x.ts": (["p/y/index.js"], [])}
    assert {r["path"] for r in resolve.tested(table).collect()} == {"p/a.py", "p/q/r.py", "p/x.ts", "p/tests/r.py", "tests/test_a.py"}


def test_graph(spark):
    table = files(spark, [("p/a.py", "from .b import x\n"), ("p/b.py", "from p import a\n"), ("c.py", "import p\nimport c\n"), ("d.py", "import e\n"), ("e.py", "import f\n"), ("f.py", "import d\nimport c\n"), ("g.py", "")])
    imports = graph.import_graph(table)
    edges = graph.import_edges(imports)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("p/a.py", "p/b.py"), ("p/b.py", "p/a.py"), ("c.py", "p/a.py"), ("c.py", "p/b.py"), ("d.py", "e.py"), ("e.py", "f.py"), ("f.py", "d.py"), ("f.py", "c.py")}
    assert {r["path"]: r["fan_in"] for r in graph.fan_in(table, imports).collect()} == {"p/a.py": 2, "p/b.py": 2, "c.py": 1, "d.py": 1, "e.py": 1, "f.py": 1, "g.py": 0}
    for most in (graph.IN_ONE_TASK, 1):
        assert {r["path"]: r["scc_id"] for r in graph.import_cycles(imports, most).collect()} == {"p/a.py": "p/a.py", "p/b.py": "p/a.py", "d.py": "d.py", "e.py": "d.py", "f.py": "d.py"}


SLUGIFY = '"""Turn text into slugs."""\nimport re\nimport unicodedata\n\ndef slugify(text):\n    text = text.lower()\n    text = re.sub("x", "y", text)\n    text = text.strip()\n    return text\n\ndef unslugify(text):\n    text = text.upper()\n    return text\n\ndef is_slug(text):\n    return text.islower()\n'


def test_candidates_end_to_end(spark):
    body = "".join(f"    x{i} = {i}\n" for i in range(12))
    table = files(spark, [("src/slugify.py", SLUGIFY), ("LICENSE", "MIT"), ("src/multi.py", f"from .slugify import slugify\ndef f():\n{body}"), ("src/blocked.py", f"from .gone import x\ndef f():\n{body}"), ("src/two.py", f"from .slugify import a\nfrom .multi import b\ndef f():\n{body}"), ("src/settings.py", f"def f():\n{body}{body}"), ("src/main.py", f"def f():\n{body}"), ("src/test_x.py", f"def f():\n{body}"), ("app/r.py", f"def f():\n{body}"), ("src/short.py", "x = 1\n"), ("src/__init__.py", "")])
    got = {r["path"]: r.asDict(recursive=True) for r in scoring.score(candidates.detect(scan.scan_filter(table)).withColumn("similar_count", F.lit(0))).collect()}
    assert {p: r["skip_reason"] for p, r in got.items()} == {"src/slugify.py": "", "src/multi.py": "", "src/blocked.py": "References missing sibling(s): gone", "src/two.py": "2 internal imports — tightly coupled", "src/settings.py": "Configuration file", "src/main.py": "Filename is a framework entry point"}
    s = got["src/slugify.py"]
    assert (s["loc"], s["external_imports"], s["dependency_weight"], s["api_surface_count"], s["complexity"], s["source_has_license"]) == (13, 2, 0, 3, 1, True)
    assert s["function_names"] == ["slugify", "unslugify", "is_slug"] and s["is_stdlib_only"] and s["extraction_type"] == "single" and s["fan_in"] == 2
    assert got["src/multi.py"]["extraction_type"] == "multi" and got["src/multi.py"]["sibling_paths"] == ["src/slugify.py"] and got["src/blocked.py"]["extraction_type"] == "blocked"
    assert "Solves a common problem (function: slugify)" in s["why_extractable"] and "✓ Verified standalone — no relative imports, extractable as-is" in s["why_extractable"]
    picked = scoring.score(candidates.detect(scan.scan_filter(table)).withColumn("similar_count", F.lit(0))).filter("path = 'src/slugify.py'").withColumns({"suggested_name": naming.suggest_name(F.col("path"), F.col("docstring_snippet"), F.col("function_names")), "suggested_tags": naming.suggest_tags(F.col("path"), F.col("language"), F.col("docstring_snippet")), "what_it_does": F.lit("Slugs.")})
    made = {r["rel_path"]: r["content"] for r in extract.package_files(picked, table).collect()}
    assert set(made) == {"slugify/slugify.py", "slugify/__init__.py", "pyproject.toml", "README.md", "LICENSE-REVIEW.md", "SOURCE-LICENSE"} and 'name = "slugify"' in made["pyproject.toml"]
    text = report.render(picked, "o/r", "Python", "now")
    assert "### 1. `slugify.py`" in text and "**Suggested name:** `slugify`" in text


def candidate(spark, **more):
    base = {"path": "p/slugify.py", "loc": 100, "complexity": 3, "fan_in": 0, "api_surface_count": 3, "dependency_weight": 0, "internal_imports": 0, "external_imports": 0, "filename_score": 0.0, "comment_ratio": 0.2, "has_tests": True, "has_docstring": True, "in_cycle": False, "has_project_specific_refs": False, "is_stdlib_only": True, "source_has_license": True, "extraction_type": "single", "similar_count": 0} | more
    df = spark.createDataFrame([tuple(base.values())], list(base))
    return scoring.score(df.withColumns({"relative_imports": F.array().cast("array<string>"), "function_names": F.array(F.lit("slugify"))})).first()


def test_scores(spark):
    c = candidate(spark)
    assert (c["code_quality"], c["relevance"], c["uniqueness"], c["demand_signal"], c["maintainability"]) == (9.5, 10.0, 8.0, 5.0, 10.0)
    assert candidate(spark, similar_count=-1)["uniqueness"] == 5.0
    for loc, penalty in ((500, 0), (501, -0.1), (650, -0.1), (651, -0.2), (2000, -1.0)):
        assert one(spark, loc, scoring.large_file_penalty, "int") == pytest.approx(penalty)
    assert candidate(spark, loc=2000)["code_quality"] == 10.0  # large files gain quality
    low = candidate(spark, dependency_weight=3, api_surface_count=0, has_project_specific_refs=True, source_has_license=False, extraction_type="multi")
    raw = 0.25 * low["code_quality"] + 0.15 * 8 + 0.1 * 5 + 0.15 * low["relevance"] + 0.2 * low["usefulness"] + 0.15 * low["maintainability"]
    assert low["relevance"] < 3 and low["combined_score"] == pytest.approx(raw / 2)
    demand = spark.sql("SELECT array(struct(1000L AS stars, 100L AS forks, 50L AS open_issues)) AS s").select(scoring.demand(F.col("s"))).first()[0]
    assert demand == pytest.approx(15.5 / 1.8)


def test_names_and_tags(spark):
    name = lambda p, d="", f=(): spark.createDataFrame([(p, d, list(f))], "p string, d string, f array<string>").select(naming.suggest_name(F.col("p"), F.col("d"), F.col("f"))).first()[0]
    assert [name("slugify.py"), name("lib/StringUtils.java"), name("src/network/mod.rs"), name("crates/mycrate/src/lib.rs"), name("utils.py"), name("foo.d.ts"), name("staff_data/models.py", f=["Data"]), name("billing/utils.py", f=["Invoice"])] == ["slugify", "string-utils", "network", "mycrate", "extracted-utility", "foo", "staff-data", "billing-invoice"]
    tags = spark.createDataFrame([("a/parse_util.py", "Python", "Fast parsing of numbers, safely.")], "p string, l string, d string").select(naming.suggest_tags(F.col("p"), F.col("l"), F.col("d"))).first()[0]
    assert tags == ["python", "utility", "parser", "library", "open-source"]
    query = spark.createDataFrame([("a/cache.py", "", ["do", "fetch_all", "Store"], "")], "p string, d string, f array<string>, x string").select(naming.search_query(F.col("p"), F.col("d"), F.col("f"), F.col("x"))).first()[0]
    assert query == "cache fetch_all store"


def test_search(spark):
    body = '{"items":[{"full_name":"a/b","html_url":"u","stargazers_count":7,"description":" d ","pushed_at":"2025-01-02T00:00:00Z","license":{"spdx_id":"MIT"},"forks_count":1},{"full_name":"c"},5,{"full_name":"e/f","html_url":"v","stargazers_count":1,"license":null}]}'
    got = one(spark, body, search.parse_response)
    assert [(p["full_name"], p["stars"], p["description"], p["pushed_at"], p["license"], p["forks"]) for p in got] == [("a/b", 7, "d", "2025-01-02", "MIT", 1), ("e/f", 1, "", "", "?", 0)]
    assert one(spark, "[1]", search.parse_response) == [] and one(spark, "2025-01-01", lambda c: search.months_since(c, "2025-06-30")) == 6 and one(spark, "soon", lambda c: search.months_since(c, "2025-06-30")) is None
    made = lambda s: spark.sql(f"SELECT {s} AS s").select(search.differentiators(F.lit("Python"), F.lit(True), F.col("s"), "2025-06-30")).first()[0]
    old = "struct('a/b' AS full_name, 2000L AS stars, '2020-01-01' AS pushed_at, 30L AS open_issues, 'Go' AS language)"
    assert made(f"array({old}, {old}, {old})")[-1] == "3/3 similar projects stale — clear opening" and made(f"array({old})")[0] == "Top result (a/b) has 2,000 stars — need clear advantage"


def test_text_safety(spark):
    assert one(spark, "ghp_" + "a" * 36 + " AKIA" + "B" * 16, report.redact_secrets) == "***REDACTED*** ***REDACTED***"
    assert one(spark, "```x<SCRIPT a>b" + "<" * 20000 + "</script>](JavaScript:y", report.sanitize_markdown) == "\\`\\`\\`x](disabled:y"
    head = one(spark, "// Copyright me\n// more\n\nfunc a\n", extract.strip_license_header)
    assert (head["content"], head["removed"]) == ("func a\n", 2)
    assert one(spark, "from .a import b\nx = 1\n", lambda c: extract.fix_relative_imports(c, F.lit(".py"))) == "# TODO: from .a import b — relative import, provide this module or install it\nx = 1"


def test_repo_arguments(spark):
    made = lambda a: tuple(one(spark, a, scan.parse_repo_arg))
    assert made("git@github.com:a/b.git") == ("a", "b", None) and made("https://example.org/a/b")[2] == "host" and made(" ")[2] == "empty" and made("a/b/c")[2] == "form"
    assert one(spark, "read:org, delete:x,repo", scan.write_scopes) == ["delete:x", "repo"]


def test_what_it_does(spark):
    rows = [
        ('"""Title of it\n=====\nDoes useful things.\n"""', "p", "", "Does useful things."), ("", "p", "func A(x) {}\ntype B struct\nfunc _c(x) {}\n", "Exports: A, B"),
        ("", "p", "package x\n", "Package 'x' — contains declarations"), ("", "p.c", "", "Source file at p.c"), (None, "q", None, "Source file at q"),
        ("@param x\n// Copyright 2020\n * Reads a file\'", "p", "", "Reads a file"), ("", "p", "".join(f"def f{i}(a):\n    pass\n" for i in range(7)), "Exports: f0, f1, f2, f3, f4 (+2 more)"),
        ("", "p", "import x\nrun all\n\n# no\nx = 1\nok\nlast one\n", "run all | x = 1 | last one"), ("", "p", "#ifdef _W\n", "Conditional compilation for _W"),
    ]
    df = spark.createDataFrame(rows, "doc string, path string, content string, told string")
    assert [r[0] for r in df.select(describe.described(F.col("doc"), F.col("path"), F.col("content"))).collect()] == [r[3] for r in rows]


def test_files_that_make_a_parser_fail_are_counted(spark):
    deep = "x = " + "(" * 150 + ")" * 150 + "\n"
    body = "def f():\n" + "    x = 1\n" * 30
    table = files(spark, [("a/deep.py", deep + body), ("a/nul.py", body + "y = '\0'\n"), ("a/bad.py", body + "def (:\n"), ("a/good.py", body), ("a/minus.py", "x = " + "-" * 200_000 + "1\n" + body)])
    found, errors = candidates.examine(table)
    assert {r["path"] for r in found.collect()} | {r["path"] for r in errors.collect()} == {"a/deep.py", "a/nul.py", "a/bad.py", "a/good.py", "a/minus.py"}
    assert {r["path"]: r["error"] for r in errors.collect()}.keys() == {"a/minus.py"}


def test_candidates_meet_similar_projects(spark):
    rows = [("r", "a.py", "Python", "slug text", False), ("r", "b.py", "Python", "none", False), ("r", "c.py", "Python", "slug", True), ("r", "d.py", "Python", "slug", False)]
    cands = spark.createDataFrame(rows, "repo string, path string, language string, query string, skipped boolean")
    catalogue = spark.createDataFrame([(f"o/p{i}", "u", i * 10, "", "2025-01-01", "MIT", 1, 1, "Python", ["slug", "text"]) for i in range(9)], "full_name string, html_url string, stars long, description string, pushed_at string, license string, open_issues long, forks long, language string, tokens array<string>")
    limited = spark.createDataFrame([("r", "d.py")], "repo string, path string")
    got = {r["path"]: r for r in search.with_similar(cands, catalogue, "2025-06-30", limited=limited).collect()}
    assert {p: (r["similar_count"], r["search_status"]) for p, r in got.items()} == {"a.py": (5, "ok"), "b.py": (0, "ok"), "c.py": (-1, "none"), "d.py": (-1, "rate_limited")}
    assert [p["full_name"] for p in got["a.py"]["similar_projects"]] == ["o/p8", "o/p7", "o/p6", "o/p5", "o/p4"]
    assert search.rate_limited(search.with_similar(cands, catalogue, "2025-06-30", limited=limited)).first()["rate_limited"] == 1


def test_token_checks(spark):
    df = spark.createDataFrame([(200, "read:org", "me", None), (200, "", "me", None), (200, "repo, delete:x", "me", None), (401, None, None, None), (403, None, None, None), (500, "", None, None), (None, None, None, "timed out")], "status int, scopes string, login string, failure string")
    got = [tuple(r[0]) for r in df.select(scan.scope_check(F.col("status"), F.col("scopes"), F.col("login"), F.col("failure"))).collect()]
    assert [(r[0], r[1], r[4]) for r in got] == [(True, "me", True), (True, "me", False), (False, None, True)] + [(False, None, False)] * 4
    assert got[0][3] is None and "cannot be verified" in got[1][3] and got[2][2] == "token may write: repo, delete:x" and got[6][2] == "network error: timed out"
    assert one(spark, "no abc here", lambda c: scan.redact(c, F.lit("abc"))) == "no *** here" and one(spark, "abc", lambda c: scan.redact(c, F.lit(""))) == "abc"


def test_directory_scan(spark, tmp_path):
    for p, c in {"pkg/__init__.py": "", "pkg/_own.py": "x = 1\n", ".hidden": "x", ".env.example": "x", "node_modules/a.js": "x", "a.png": "x", "gen.go": "// Code generated by x\n", "bom.py": "\ufeffx\r\ny"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(c.encode())
    (tmp_path / "bad.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "link.py").symlink_to(tmp_path / "bad.py")
    got = {r["path"]: r for r in from_directory(spark, str(tmp_path), "o/r").collect()}
    assert set(got) == {"pkg/__init__.py", "pkg/_own.py", ".env.example", "bom.py", "bad.py"}
    assert got["bom.py"]["content"] == "x\ny" and got["bad.py"]["content"] == "x = ''\n"


def test_package_writing(spark, tmp_path):
    rows = spark.createDataFrame([("p", "a/b.py", "x"), ("p", "README.md", "y")], "package string, rel_path string, content string")
    assert extract.write_packages(rows, f"file://{tmp_path}").count() == 2 and (tmp_path / "p/a/b.py").read_text() == "x"
