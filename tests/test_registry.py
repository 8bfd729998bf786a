"""A family that is registered is known to every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratalode.functions import constants as K
from stratalode.functions import languages as L
from stratalode.operators import candidates, report, resolve, scan, scoring
from stratalode.sources.files import from_table


@pytest.fixture
def lua():
    """A twelfth family, with a parser of its own for complexity."""
    before = dict(L.RULES), dict(K.LANGUAGE_BY_EXT), dict(K.FAMILY_BY_EXT), dict(K.LANGUAGE_TAGS)
    required = L.said(r"""^\s*local\s+\w+\s*=\s*require\(?["']([\w.]+)["']""")
    near = r"""require\(?["']\./(\w+)["']"""
    L.register("lua", L.Rules(
        ("//",), (), (r"^function\s+(\w+)\s*\(",), imports=lambda lines: L.modules(F.transform(lines, required), lambda m: F.lit(True), L.first_part),
        relative=lambda content: F.transform(L.matches(content, near), lambda n: F.struct(n.alias("name"), F.lit(1).alias("level"))).cast(L.NEIGHBOURS),
        doc=lambda lines, stripped: F.when(F.get(stripped, F.lit(0)).startswith("--- "), F.substring(F.get(stripped, F.lit(0)), 5, 100)).otherwise(""),
        internal=lambda x: x.rlike(near), weight=lambda m: F.when(m == "torch", 3).otherwise(1), siblings=("{}.lua", "{}/init.lua"),
        parse=lambda content: {"complexity": 1 + content.count("then")}, parses=("complexity",),
    ), {".lua": "Lua"}, "lua")
    yield
    for kept, now in zip(before, (L.RULES, K.LANGUAGE_BY_EXT, K.FAMILY_BY_EXT, K.LANGUAGE_TAGS), strict=True):
        now.clear()
        now.update(kept)


CODE = "--- Makes slugs.\nlocal t = require('torch.nn')\nlocal h = require('./helper')\nfunction slugify(a)\n  if a then\n    return a\n  end\n" + "  x = 1\n" * 12 + "end\n"


def test_a_twelfth_family(spark, lua):
    rows = [("r", "src/slug.lua", CODE), ("r", "src/helper/init.lua", "function f()\n" + "  y = 2\n" * 12 + "end\n"), ("r", "src/test_slug.lua", "x"), ("r", "src/gone.lua", "local g = require('./nowhere')\nfunction g()\n" + "  y = 2\n" * 12)]
    files = from_table(spark.createDataFrame(rows, "repo string, path string, content string"))
    assert {tuple(r) for r in scan.loc_by_language(files).select("language", "files").collect()} == {("Lua", 4)}
    found = {r["path"]: r.asDict() for r in scoring.score(candidates.detect(files)).collect()}
    one = found["src/slug.lua"]
    assert set(found) == {"src/slug.lua", "src/helper/init.lua", "src/gone.lua"}
    assert (one["language"], one["complexity"], one["dependency_weight"], one["function_names"], one["docstring_snippet"]) == ("Lua", 2, 3, ["slugify"], "Makes slugs.")
    assert (one["sibling_paths"], one["extraction_type"], one["internal_imports"], one["has_tests"]) == (["src/helper/init.lua"], "multi", 1, True)
    assert found["src/gone.lua"]["skip_reason"] == "References missing sibling(s): nowhere"
    assert "lua" in {f for f, r in L.RULES.items() if r.siblings} and resolve.RULES is L.RULES
    assert report.K.LANGUAGE_TAGS["Lua"] == "lua"


def test_it_is_gone_again():
    assert "lua" not in L.RULES and ".lua" not in K.LANGUAGE_BY_EXT
