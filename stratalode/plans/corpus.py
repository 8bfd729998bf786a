"""Source files for queries: a projection of the documents table in SQL that two engines read alike.

Each document becomes one file: its id chooses repository, language, folder and name,
a generated head gives imports and declarations, and its text follows as comments.
Imports point to ``doc_id + 357``, which has the same repository, folder and language.
Some ids also stand for a test of their file, beside it, in a test folder or at the root, for a file
that a rule on contents or names passes over, or for one of the many that import one module.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

EXTS = [".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java", ".kt", ".c", ".h", ".cpp", ".hpp", ".cs", ".rb", ".php", ".swift"]
_ID = "cast(doc_id AS varchar(20))"
_NEXT = "cast(doc_id + 357 AS varchar(20))"
_NL = "chr(10)"


def _case(key: str, values: list[str], otherwise: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {otherwise} END"


def _rows(*rows: str) -> str:
    """SQL for lines with their ends; {id} and {next} are filled in."""
    out = []
    for r in rows:
        parts = r.replace("'", "''").replace("{id}", f"' || {_ID} || '").replace("{next}", f"' || {_NEXT} || '")
        out.append(f"'{parts}' || {_NL}")
    return "(" + " || ".join(out) + ")"


_HEADS = {
    "python": _rows("import os", "import numpy as np", "def parse_{id}(text, limit):", "    if text and limit:", "        return [x for x in text if x]", "    for x in text:", "        limit = limit + 1", "    return limit", "class Holder{id}:", "    def size(self):", "        return 1"),
    "js": _rows("import React from 'react';", "const fs = require('fs');", "export function format{id}(a) {", "  if (a && a.b) {", "    return a ? 1 : 2;", "  }", "  for (const x of a) { fs.log(x || 1); }", "  return 0;", "}", "export const limit{id} = 3;", "/* a block", "   that goes on */"),
    "go": _rows("package main", "import (", '\t"fmt"', '\t"github.com/gin-gonic/gin"', ")", "func Encode{id}(a int) int {", "\tif a > 1 && a < 9 {", "\t\tfmt.Println(a)", "\t}", "\tfor a < 3 { a++ }", "\treturn a", "}", "type Box{id} struct {", "}"),
    "rust": _rows("use std::fmt;", "use serde::Serialize;", "pub fn hash_{id}(a: u32) -> u32 {", "    if a > 1 && a < 9 {", "        return 1;", "    }", "    while a < 3 { }", "    match a {", "        _ => 1", "    }", "}", "pub struct Box{id} {", "}"),
    "jvm": _rows("package a.b;", "import org.apache.Thing;", "import java.util.List;", "public class Box{id} {", "  public static int sort{id}(int a) {", "    if (a > 1 && a < 9) {", "      return 1;", "    }", "    while (a < 3) { a++; }", "    return a;", "  }", "}"),
    "c": _rows("#include <stdio.h>", '#include "local/thing.h"', "#include <boost/any.hpp>", "int merge_{id}(int a) {", "  if (a > 1 && a < 9) {", "    return 1;", "  }", "  while (a < 3) { a++; }", "  return a;", "}", "int other_{id}(int b);"),
    "csharp": _rows("using System;", "using Newtonsoft.Json;", "public class Box{id} {", "  public int Search{id}(int a) {", "    if (a > 1 && a < 9) {", "      return 1;", "    }", "    while (a < 3) { a++; }", "    return a;", "  }", "}"),
    "ruby": _rows("require 'json'", "require 'net/http'", "module Box{id}", "  def self.cache_{id}(a)", "    if a > 1 && a < 9", "      return 1", "    end", "    while a < 3", "      a += 1", "    end", "  end", "end"),
    "php": _rows("<?php", "use Symfony\\Thing;", "class Box{id} {", "  public function retry{id}($a) {", "    if ($a > 1 && $a < 9) {", "      return 1;", "    }", "    while ($a < 3) { $a++; }", "    return $a;", "  }", "}"),
    "swift": _rows("import Foundation", "import Alamofire", "struct Box{id} {", "  func join{id}(a: Int) -> Int {", "    if a > 1 && a < 9 {", "      return 1", "    }", "    while a < 3 { }", "    return a", "  }", "}"),
}
_KIND = ["python", "js", "js", "js", "js", "go", "rust", "jvm", "jvm", "c", "c", "c", "c", "csharp", "ruby", "php", "swift"]
_MARK = ["# "] + ["// "] * 13 + ["# ", "// ", "// "]
_HEAD = _case("doc_id % 17", [_HEADS[k] for k in _KIND], "''")
_REL = _case("doc_id % 17", [_rows("from .mod{next} import thing"), *[_rows("import x from './mod{next}';")] * 4], "''")
_BACK = "CASE WHEN doc_id % 17 = 0 AND doc_id % 4 = 1 AND doc_id >= 357 THEN 'from .mod' || cast(doc_id - 357 AS varchar(20)) || ' import thing' || chr(10) ELSE '' END"
_HUB = "CASE WHEN doc_id % 17 = 0 AND doc_id % 3 = 0 THEN 'import shared' || chr(10) ELSE '' END"
_FOLDER = "CASE WHEN doc_id % 29 = 3 THEN 'tests/' WHEN doc_id % 31 = 3 THEN 'app/' WHEN doc_id % 37 = 3 THEN 'vendor/' WHEN doc_id % 23 = 3 THEN '' ELSE 'pkg' || cast(doc_id % 7 AS varchar(20)) || '/' END"
_NAME = f"CASE WHEN doc_id % 41 = 5 THEN 'test_mod' WHEN doc_id % 43 = 5 THEN 'zz_generated_' WHEN doc_id % 19 = 5 THEN 'parse_helper' WHEN doc_id % 47 = 5 THEN 'spec_' ELSE 'mod' END || {_ID}"

_STEPS = [f"    step{i} = {i}" for i in range(12)]
_EXT = _case("doc_id % 17", [f"'{e}'" for e in EXTS], "''")
#: Ids, path, extension, content.
_MORE = [
    ("doc_id % 11 = 2", f"{_FOLDER} || 'test_' || {_NAME} || {_EXT}", _EXT, _rows("x = 1")),
    ("doc_id % 13 = 3", f"{_FOLDER} || 'tests/' || {_NAME} || {_EXT}", _EXT, _rows("x = 1")),
    ("doc_id % 19 = 7", f"'tests/' || {_NAME} || '_test' || {_EXT}", _EXT, _rows("x = 1")),
    ("doc_id % 3 = 0", f"'use/u' || {_ID} || '.py'", "'.py'", f"CASE WHEN doc_id % 9 = 0 THEN {_rows('from django.conf import settings')} ELSE '' END || " + _rows("import hub", "def use_{id}(a):", *_STEPS)),
    ("doc_id % 17 = 6 AND doc_id % 2 = 0", f"'crate' || {_ID} || '/mod.rs'", "'.rs'", _rows(*(f"pub mod part{i};" for i in range(12)))),
    ("doc_id % 17 = 6 AND doc_id % 2 = 1", f"'crate' || {_ID} || '/lib.rs'", "'.rs'", _rows(*(f"pub use part{i}::X;" for i in range(12)))),
    ("doc_id % 17 = 0 AND doc_id % 5 = 0", f"'util' || {_ID} || '/utils.py'", "'.py'", _rows("def parse_{id}(a):", *_STEPS)),
    ("doc_id % 17 = 0 AND doc_id % 5 = 1", f"'const' || {_ID} || '/limits.py'", "'.py'", _rows(*(f"LIMIT_{i} = {i}" for i in range(12)), "def f():", "    pass")),
    ("doc_id % 17 = 0 AND doc_id % 5 = 2", f"'wrap' || {_ID} || '/wrap.py'", "'.py'", _rows("# This file was automatically generated by SWIG", "def wrap(a):", *_STEPS)),
    ("doc_id % 17 = 0 AND doc_id % 5 = 3", f"'conf' || {_ID} || '/settings.py'", "'.py'", _rows("def f(a):", *_STEPS)),
    ("doc_id % 17 = 0 AND doc_id % 5 = 4", f"'run' || {_ID} || '/main.py'", "'.py'", _rows("def f(a):", *_STEPS)),
    ("doc_id % 17 = 0 AND doc_id % 7 = 1", f"'text' || {_ID} || '/texts.py'", "'.py'", _rows('HELP = """', *["words"] * 14, '"""', "def f():", "    return HELP")),
    ("doc_id % 17 = 1 AND doc_id % 3 = 0", f"'types' || {_ID} || '/shape.d.ts'", "'.ts'", _rows("interface A {", *["  a: number;"] * 20, "}")),
    ("doc_id % 17 = 1 AND doc_id % 3 = 1", f"'legal' || {_ID} || '/legal.js'", "'.js'", _rows(*["// Copyright A"] * 16, "function f() {", *["  x();"] * 8, "}")),
    ("doc_id % 17 = 1 AND doc_id % 3 = 2", f"'bare' || {_ID} || '/bare.js'", "'.js'", _rows(*["call();"] * 12)),
    ("doc_id % 17 = 5 AND doc_id % 2 = 1", f"'box' || {_ID} || '/box.go'", "'.go'", _rows("// Package box holds boxes.", "// More of it.", "package box", "func Open{id}(a int) int {", *["\tx = 1"] * 12, "}")),
]
_MORE_SQL = "".join(f"UNION ALL SELECT 'acme/repo' || cast(doc_id % 3 AS varchar(20)), {path}, {ext}, {content} FROM documents WHERE {ids}\n" for ids, path, ext, content in _MORE)

#: (repo, path, ext, content), one row for each document and some more.
SRC_SQL = f"""
SELECT 'acme/repo' || cast(doc_id % 3 AS varchar(20)) AS repo, {_FOLDER} || {_NAME} || {_case('doc_id % 17', [f"'{e}'" for e in EXTS], "''")} AS path,
       {_case('doc_id % 17', [f"'{e}'" for e in EXTS], "''")} AS ext,
       CASE WHEN doc_id % 3 > 0 THEN {_REL} ELSE '' END || {_BACK} || {_HUB} || {_HEAD}
       || {_case('doc_id % 17', [f"'{m}'" for m in _MARK], "''")} || replace(coalesce(text, ''), chr(10), chr(10) || {_case('doc_id % 17', [f"'{m}'" for m in _MARK], "''")}) || chr(10)
       || repeat('step = 1' || chr(10), cast(doc_id % 60 AS INT)) AS content
FROM documents
UNION ALL SELECT 'acme/repo0', 'LICENSE', '', 'MIT License' || chr(10)
UNION ALL SELECT 'acme/repo0', 'shared.py', '.py', 'def shared():' || chr(10) || repeat('    step = 1' || chr(10), 30)
UNION ALL SELECT 'acme/repo1', 'docs/LICENSE', '', 'MIT License' || chr(10)
UNION ALL SELECT 'acme/repo0', 'hub.py', '.py', 'def hub():' || chr(10) || repeat('    step = 1' || chr(10), 30)
{_MORE_SQL}"""

#: The same with physical lines; starts a WITH clause.
SRC_CTE = f"""WITH RECURSIVE src0 AS ({SRC_SQL}),
src AS (SELECT *, CAST(strlen(content) AS BIGINT) AS size,
        CAST(length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END AS INT) AS loc FROM src0)"""


def as_files(documents: DataFrame) -> DataFrame:
    """The file table made from rows of documents."""
    from stratalode.sources.files import from_table

    spark = documents.sparkSession
    view = f"documents_{uuid.uuid4().hex}"
    documents.createOrReplaceTempView(view)
    sql = SRC_SQL.replace("\\", "\\\\").replace("FROM documents", f"FROM {view}")  # backslashes escape here, not in the other engine
    made = spark.sql(sql).select("repo", "path", "content")
    spark.catalog.dropTempView(view)
    return from_table(made)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file table made from the documents of a data folder."""
    from stratalode.sources.tables import read_table

    return as_files(read_table(spark, f"{sf_dir}/documents.parquet"))
