"""Repositories that documents stand for: one file for each gate, reason, form of import, declaration and documentation.

The texts of the data tables hold none of these forms. So each document stands for one file by its id: every
115 documents make three repositories that hold all of them, and as many as there are documents for are made.
Texts, answers and names to judge are chosen by the id too. Results are in ``golden``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.sources.files import from_table
from stratalode.sources.tables import read_table

_STEPS = "".join(f"    step{i} = {i}\n" for i in range(12))
_PY = f"def work(a):\n{_STEPS}"
_JS = "export function work(a) {\n" + "".join(f"  let s{i} = {i};\n" for i in range(12)) + "}\n"

GATES = {
    # what a scan leaves out
    "node_modules/dep/index.js": _JS, "src/logo.PNG": "x", ".hidden.py": _PY, ".env.example": "A=1\n", "src/schema.generated.ts": _JS,
    "src/header.go": "// Code generated by a tool\n" + "package x\n" * 12, "src/bom.py": "\ufeff" + _PY, "src/ends.txt": "a\r\nb\nc",
    # what a path rules out
    "src/tests/helper.py": _PY, "src/test_work.py": _PY, "src/work_test.go": "package x\n" * 12, "src/work.spec.ts": _JS, "src/conftest.py": _PY, "src/__init__.py": _PY,
    "src/notes.md": "text\n" * 12, "app/page.tsx": _JS, "src/routes/user.js": _JS, "src/layout.tsx": _JS,
    # reasons, in their order
    "src/mod.rs": "".join(f"pub mod part{i};\n" for i in range(12)), "src/lib.rs": "".join(f"pub use part{i}::X;\n" for i in range(12)), "src/bare.js": "".join(f"call{i}();\n" for i in range(12)),
    "src/limits.py": "".join(f"LIMIT_{i} = {i}\n" for i in range(12)) + "def f():\n    pass\n", "src/types.d.ts": "interface A {\n" + "  a: number;\n" * 12 + "}\n",
    "src/wrap.py": "# This file was automatically generated by SWIG\n" + _PY, "src/legal.js": "// Copyright A\n" * 16 + "function f() {\n" + "  x();\n" * 8 + "}\n",
    "src/settings.py": _PY, "src/texts.py": 'HELP = """\n' + "words\n" * 14 + '"""\ndef f():\n    return HELP\n', "src/main.py": _PY, "src/tiny.py": "x = 1\n",
    "src/parse_cache_helper.py": _PY, "src/two.py": "from .work import a\nfrom .other import b\n" + _PY, "src/gone.py": "from .nowhere import a\n" + _PY, "src/work.py": _PY, "src/pair.py": "from .work import work\n" + _PY,
}

LANGS = {
    "LICENSE": "MIT License\n",
    "pkg/text.py": '#!/usr/bin/env python\n"""Turns text into slugs.\n\nMore of it.\n"""\nimport os, re\nimport numpy.linalg as n\nfrom collections import OrderedDict\nfrom . import side\nfrom ..up import (\n    one,\n    two,\n)\n\nclass Slug:\n    def make(self, a, b):\n        if a and b or self:\n            return [x for x in a if x]\n        return _hide(a) if a else None\n\ndef _hide(a):\n    with open(a) as f:\n        assert f\n    try:\n        pass\n    except OSError:\n        pass\n\nasync def later():\n    while True:\n        pass\n',
    "pkg/side.py": _PY, "up.py": _PY,
    "web/box.ts": "/**\n * Formats a box.\n */\nimport React from 'react';\nimport x from '@scope/lib/deep';\nimport y from './part';\nimport z from '../up/index';\nconst q = require('express');\nexport default function box(a) {\n  if (a && a.b || a?.c) { return a ?? 1; }\n  for (const b of a) { }\n  return a ? 1 : 2;\n}\nexport const limit = 3;\nexport interface Shape { }\nexport type Kind = string;\n",
    "web/part.tsx": _JS, "up/index.js": _JS,
    "go/box.go": "// Copyright A\n\n// Package box holds boxes.\n// More of it.\npackage box\n\nimport (\n\t\"fmt\"\n\t\"net/http\"\n\t\"github.com/gin-gonic/gin\"\n)\n\n// Open opens.\nfunc Open(a int) int {\n\tif a > 1 && a < 3 {\n\t\tfmt.Println(a)\n\t}\n\tfor a < 9 { a++ }\n\tswitch a {\n\tcase 1:\n\t}\n\treturn a\n}\n\ntype Box struct {\n}\nfunc hidden() {}\n",
    "rs/box.rs": "use crate::inner::thing;\nuse std::fmt;\nuse serde::Serialize;\n\n//! Boxes.\n//! More.\n\npub fn open(a: u32) -> u32 {\n    if a > 1 || a < 9 { return 1; }\n    while a < 3 { }\n    loop { }\n    match a {\n        _ => 1\n    }\n}\npub struct Box { }\nfn hidden() {}\n",
    "rs/inner.rs": "pub fn thing() {\n" + "    step();\n" * 12 + "}\n",
    "jvm/Box.java": "package a.b;\nimport org.apache.Thing;\nimport java.util.List;\nimport static com.acme.Util;\n\n/**\n * Opens boxes.\n */\npublic final class Box {\n  public static int open(int a) {\n    if (a > 1 && a < 9) { return a > 2 ? 1 : 2; }\n    while (a < 3) { a++; }\n    try { } catch (Exception e) { }\n    return a;\n  }\n  private int hidden() { return 1; }\n}\n",
    "jvm/Box.kt": "package a.b\nimport org.acme.Thing as T\nimport kotlin.math.abs\nimport java.util.List\n\n/* Opens. */\nopen class Box {\n  fun open(a: Int): Int {\n    if (a > 1 && a < 9) { return 1 }\n    for (x in 1..3) { }\n    return a\n  }\n}\ndata class Pair(val a: Int)\n",
    "c/box.c": "/* Opens boxes. */\n#include <stdio.h>\n#include \"local/thing.h\"\n#include <boost/any.hpp>\n\nint open_box(int a) {\n  if (a > 1 && a < 9) {\n    return a > 2 ? 1 : 2;\n  }\n  while (a < 3) { a++; }\n  return a;\n}\nstatic int hidden(int a) {\n  return a;\n}\nint other(int b);\n",
    "cs/Box.cs": "using System;\nusing Acme.Json;\nusing Alias = Other.Name;\n\n/// <summary>Opens boxes.</summary>\npublic sealed class Box {\n  public static int Open(int a) {\n    if (a > 1 && a < 9) { return 1; }\n    while (a < 3) { a++; }\n    return a;\n  }\n  private int Hidden() { return 1; }\n}\npublic interface IBox { }\n",
    "rb/box.rb": "# frozen_string_literal: true\n# Opens boxes.\n# More.\nrequire 'json'\nrequire 'net/http'\nrequire_relative 'side'\n\nmodule Boxes\n  def self.open(a)\n    if a > 1 && a < 9\n      return 1\n    elsif a\n      return 2\n    end\n    a unless a\n  end\nend\n",
    "php/box.php": "<?php\nnamespace Acme;\nuse Symfony\\Thing;\n\n/**\n * Opens boxes.\n */\nfinal class Box {\n  public function open($a) {\n    if ($a > 1 && $a < 9) { return 1; }\n    while ($a < 3) { $a++; }\n    return $a;\n  }\n  private function hidden() { }\n}\n# mark\n",
    "swift/box.swift": "import Foundation\nimport Alamofire\n\n/* Opens. */\npublic struct Box {\n  func open(a: Int) -> Int {\n    if a > 1 && a < 9 { return 1 }\n    while a < 3 { }\n    return a\n  }\n  private func hidden() { }\n}\n",
}

GRAPH = {
    "a.py": "import b\n" + _PY, "b.py": "import a\n" + _PY, "c.py": "import d\n" + _PY, "d.py": "import e\n" + _PY, "e.py": "import c\nimport e\n" + _PY,
    "hub.py": _PY, "tests/test_a.py": "import a\n", "pkg/deep/mod.py": _PY, "pkg/tests/mod_test.py": "x = 1\n", "web/view.js": _JS, "web/view.test.js": "x();\n", "long.py": _PY + "def more():\n" + "    x = 1\n" * 700,
    **{f"use{i}.py": "import hub\n" + _PY for i in range(52)},
}

REPOS = {"fix/gates": GATES, "fix/langs": LANGS, "fix/graph": GRAPH}


#: Files of the three repositories, in order.
FILES = [(repo, path, content) for repo, files in REPOS.items() for path, content in files.items()]


def chosen(spark: SparkSession, sf_dir: str, rows: list[tuple], kind: str) -> DataFrame:
    """(doc_id, no, *kind): for each document the row of its id; the rows are a fixed few."""
    few = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"no long, {kind}")
    ids = read_table(spark, f"{sf_dir}/documents.parquet").filter("doc_id IS NOT NULL").select("doc_id", F.pmod("doc_id", F.lit(len(rows))).alias("no"))
    return ids.join(few, "no")


def code_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all whole groups of documents; a group's number ends the names of its repositories."""
    each = chosen(spark, sf_dir, FILES, "repo string, path string, content string").withColumn("group", F.floor(F.col("doc_id") / len(FILES)))
    whole = each.groupBy("group").agg(F.countDistinct("no").alias("n")).filter(F.col("n") == len(FILES)).select("group")
    return from_table(each.join(whole, "group").select(F.concat_ws("-", "repo", "group").alias("repo"), "path", "content").distinct())


#: Texts around obviously false secrets, one for each pattern, and what rendered text must not hold.
TEXTS = [
    "a ghp_" + "a1" * 18 + " b", "github_pat_" + "A" * 82, "AKIA" + "B" * 16, 'aws_secret_access_key = "' + "c" * 40 + '"', "xoxb-" + "1" * 12, "sk-" + "d" * 24, "sk-ant-" + "e-" * 12,
    "AIza" + "F" * 35, "pk_live_" + "g" * 24, "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + "h" * 12 + "." + "i" * 12 + "." + "j" * 12, "heroku_api_key: 12345678-1234-1234-1234-123456789abc",
    "AC" + "0" * 32, "SG." + "k" * 22 + "." + "l" * 43, "npm_" + "m" * 36, "M" + "n" * 24 + "." + "o" * 6 + "." + "p" * 27, "x " + "f" * 64 + " y", "x" + "f" * 64, "f" * 63, "nothing here",
    "a ```b``` c", "a<SCRIPT src=x>1\n2</script>b", "[x](JavaScript:go())", "<script>open",
]

HEADERS = [
    "/*\n * Copyright A\n * All of it\n */\n\nint x;\n", "#!/bin/sh\n# Copyright A\n# more\nx = 1\n", "// Licensed under B\n// more\nvar x;\n", "//! Permission is hereby granted\n//! more\nfn x() {}\n",
    "# no header\nx = 1\n", "x = 1\n# Copyright A\n", "/*\n" + " * line\n" * 60 + " */\nint x;\n",
]

ANSWERS = [(200, "read:org", "me", None), (200, "", "me", None), (200, "repo", "me", None), (200, "read:org, delete:packages", "me", None), (401, None, None, None), (403, None, None, None), (500, None, None, None), (None, None, None, "timed out")]

RESPONSES = [
    '{"items":[{"full_name":"a/b","html_url":"u","stargazers_count":2000,"description":" d ","pushed_at":"2023-01-02T00:00:00Z","license":{"spdx_id":"MIT"},"open_issues_count":30,"forks_count":1,"language":"Go"},{"full_name":"c"},5,{"full_name":"e/f","html_url":"v","stargazers_count":9,"license":null}]}',
    '{"items":[{"full_name":"g/h","html_url":"w","stargazers_count":7,"pushed_at":"2025-06-01T00:00:00Z","language":"Python"}]}', '{"items":[]}', "[1]", "no json",
]

NAMES = [  # path, documentation, functions, first lines
    ("src/utils.py", "", ["parse_date"], "import arrow\n"), ("src/cache/utils.py", "", [], ""), ("pkg/HTTPServer.ts", "Serves files.", [], "import x from 'koa';\n"), ("lib/mod.rs", "", [], ""), ("tools/net/mod.rs", "", [], ""),
    ("src/types.d.ts", "", [], ""), ("helpers.go", "", ["main", "Retry"], ""), ("index.js", "A small queue for jobs.", [], ""), ("src/rate_limiter.py", "Limits calls, fast and simple.", ["allow", "limit_calls"], "from redis import Redis\n"),
]
