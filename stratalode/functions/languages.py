"""Language rules as data, and the column expressions made from them.

A ``Rules`` entry describes one family; ``RULES`` is the registry, and ``register`` adds to it. Everything is
expressed with built-in functions but for what needs a parser: the syntax tree of
Python files and comments before Go declarations (``parsed``, an Arrow function).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalode.functions import constants as K
from stratalode.functions.text import contains_any, filled, lookup, matches, starts_any, strings, strip

#: Unicode classes as the source language's regular expressions have them; ^ after line feeds only.
U, UM = "(?U)", "(?Umd)"


@dataclass(frozen=True)
class Rules:
    comments: tuple[str, ...]
    complexity: tuple[str, ...]
    api: tuple[str, ...] = ()
    skip_before_doc: str = ""
    doc_window: int = 100
    doc_open: tuple[str, ...] = ("/*",)
    starred: bool = False  # a line that starts with * continues a block comment
    preprocessor: bool = False
    # Expressions of a family's own, where its patterns don't say it all; families without one get none of it.
    #: lines -> modules that are imported, in order
    imports: Callable[[Column], Column] | None = None
    #: content -> array<struct<name, level>> of neighbours that are imported
    relative: Callable[[Column], Column] | None = None
    #: found names by pattern, content -> names of public declarations
    names: Callable[[list[Column], Column], Column] | None = None
    #: lines, stripped lines -> documentation
    doc: Callable[[Column, Column], Column] | None = None
    #: a line -> whether it imports from the project
    internal: Callable[[Column], Column] | None = None
    #: a module -> 0 for the standard library, 3 for a heavy one, else 1
    weight: Callable[[Column], Column] | None = None
    #: what a neighbour's name may be completed to, first choice first
    siblings: tuple[str, ...] = ()
    #: content -> any of names, complexity, relative, doc; ``parses`` says which
    parse: Callable[[str], dict] | None = None
    parses: tuple[str, ...] = ()


IF, FOR, WHILE, CASE, CATCH = r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bcase\s+", r"\bcatch\s*\("
AND, OR, TERNARY = "&&", r"\|\|", r"\?\s*[^?]"
SLASHES = ("//", "/*")
_BRACED = (IF, FOR, WHILE, CASE, CATCH, AND, OR, TERNARY)
_KOTLIN = r"^\s*(?:public\s+|open\s+|final\s+|abstract\s+|sealed\s+)*"
_SHARP = r"^\s*public\s+(?:sealed\s+|abstract\s+|static\s+|virtual\s+|override\s+|async\s+)*"
_SWIFT = r"^\s*(?:public\s+|open\s+|internal\s+|fileprivate\s+|private\s+)?"
_C = r"^\s*(?!static\b)(?:[\w][\w\s\*<>:,&]*?)\s+(\w+)\s*\([^)]*\)\s*"

# Comment marks, branches, declarations and where documentation starts, by family.
RULES: dict[str, Rules] = {
    "python": Rules(("#",), ()),
    "js": Rules(
        SLASHES, (*_BRACED, r"\?\?"),
        (r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum|namespace)\s+(\w+)",),
        r"^$|^#!|^//|^/\*(?!\*)", 10, ("/**",), True,
    ),
    "go": Rules(SLASHES, (r"\bif\s+", r"\bfor\s+", CASE, AND, OR), (r"^\s*func\s+([A-Z]\w*)", r"^\s*type\s+([A-Z]\w*)")),
    "rust": Rules(
        ("//",), (r"\bif\s+", r"\bmatch\s+", r"\bfor\s+", r"\bwhile\s+", r"\bloop\s*\{", AND, OR),
        (r"^\s*pub\s+(?:async\s+)?fn\s+(\w+)", r"^\s*pub\s+(?:struct|enum|trait)\s+(\w+)"),
    ),
    "java": Rules(
        SLASHES, _BRACED,
        (r"^\s*public\s+(?:final\s+|abstract\s+|static\s+)*(?:class|interface|enum)\s+(\w+)",
         r"^\s*public\s+(?:final\s+|abstract\s+|static\s+|synchronized\s+)*(?:[\w<>\[\],?\s]+)\s+(\w+)\s*\("),
        r"^$|^//|^package |^import ", starred=True,
    ),
    "kotlin": Rules(
        SLASHES, _BRACED,
        (_KOTLIN + r"(?:fun|override\s+fun)\s+(\w+)", _KOTLIN + r"(?:class|object|interface|enum\s+class|data\s+class)\s+(\w+)"),
        r"^$|^//|^package |^import ", starred=True,
    ),
    "c": Rules(
        SLASHES, (IF, FOR, WHILE, CASE, AND, OR, TERNARY), (_C + r"\{", _C + ";"), "^$|^//|^#", starred=True, preprocessor=True,
    ),
    "csharp": Rules(
        SLASHES, _BRACED,
        (_SHARP + r"(?:class|interface|struct|enum)\s+(\w+)", _SHARP + r"(?:[\w<>\[\],?\s]+)\s+(\w+)\s*\("),
        "^$|^//|^using |^namespace", starred=True,
    ),
    "ruby": Rules(
        ("#",), (r"\bif\b", r"\belsif\b", r"\bfor\b", r"\bwhile\b", r"\bunless\b", r"\bcase\b", r"\bwhen\b", r"\brescue\b", AND, OR),
        (r"^\s*def\s+(?:self\.)?(\w+)", r"^\s*(?:module|class)\s+(\w+)"),
    ),
    "php": Rules(
        ("//", "#", "/*"), _BRACED,
        (r"^\s*(?:public\s+|protected\s+|static\s+)*function\s+(\w+)", r"^\s*(?:final\s+|abstract\s+)*(?:class|interface|trait)\s+(\w+)"),
        r"^$|^<\?php|^//|^namespace |^use ", starred=True,
    ),
    "swift": Rules(
        SLASHES, (r"\bif\s+", r"\bfor\s+", r"\bwhile\s+", CASE, r"\bcatch\s*\{", AND, OR),
        (_SWIFT + r"func\s+(\w+)", _SWIFT + r"(?:struct|class|enum|protocol)\s+(\w+)"),
        "^$|^//|^import ", starred=True,
    ),
}


def register(family: str, rules: Rules, languages: dict[str, str], tag: str = "") -> None:
    """Adds a family, or replaces one: every operator knows its files from then on. ``languages`` are its extensions
    and the language of each. Its functions must be ones that executors can import, or be given by value."""
    RULES[family] = rules
    for ext, language_name in languages.items():
        K.LANGUAGE_BY_EXT[ext], K.FAMILY_BY_EXT[ext] = language_name, family
        if tag:
            K.LANGUAGE_TAGS[language_name] = tag


_made: dict[tuple, object] = {}


def once(name: str, make: Callable[[], object]) -> object:
    """What ``make`` makes, kept for the Spark context and the registry as they are: expressions over all families take
    thousands of calls to build, and don't change."""
    key = (id(SparkContext._active_spark_context), name, *map(id, RULES.values()))
    if key not in _made:
        _made[key] = make()
    return _made[key]


def by_family(family: Column, make: Callable[[str, Rules], Column | None], otherwise: Column) -> Column:
    """A CASE over families; families without an expression of their own get ``otherwise``."""
    out = None
    for name, rules in RULES.items():
        if (made := make(name, rules)) is not None:
            out = F.when(family == name, made) if out is None else out.when(family == name, made)
    return otherwise if out is None else out.otherwise(otherwise)


def language(ext: Column) -> Column:
    return lookup(K.LANGUAGE_BY_EXT, ext)


def family(ext: Column) -> Column:
    return lookup(K.FAMILY_BY_EXT, ext)


def _among(fam: Column, test: Callable[[Rules], bool]) -> Column:
    """Whether a family's rules pass."""
    return fam.isin([name for name, rules in RULES.items() if test(rules)])


Test = Callable[[Column], Column]


def _stated(stripped: Column, outside: Test, opening: Test, inside: int, start: Column) -> Column:
    """struct<within, n>: after lines of a text that begin inside a block comment or not (``start``), whether
    they end inside one, and how many of them count."""

    def step(acc: Column, s: Column) -> Column:
        closes = s.contains("*/")
        opens = s.contains("/*") & ~closes
        within = F.when(s == "", acc["within"]).when(acc["within"], ~closes).otherwise(opens)
        add = F.when(s == "", False).when(acc["within"], bool(inside)).when(opens, opening(s)).otherwise(outside(s))
        return F.struct(within.alias("within"), (acc["n"] + add.cast("int")).cast("int").alias("n"))

    return F.aggregate(stripped, F.struct(start.alias("within"), F.lit(0).cast("int").alias("n")), step)


def _counted(stripped: Column, outside: Test, opening: Test, inside: int) -> Column:
    """Counts lines by a block-comment state that is carried from line to line: ``outside`` and
    ``opening`` say if a line outside a block, or one that opens a block, counts; those inside
    count ``inside``. Texts without a block need no state."""
    plain = F.size(F.filter(stripped, lambda s: (s != "") & outside(s)))
    return F.when(F.exists(stripped, lambda s: s.contains("/*")), _stated(stripped, outside, opening, inside, F.lit(False))["n"]).otherwise(plain)


def _comment(fam: Column) -> Callable[[Column], Column]:
    """Whether a stripped line starts with a comment mark of its family."""
    marks = {m: _among(fam, lambda r, m=m: m in r.comments) for m in ("//", "#", "/*")}
    return lambda s: (s.startswith("//") & marks["//"]) | (s.startswith("#") & marks["#"]) | (s.startswith("/*") & marks["/*"])


def _starred(fam: Column) -> Callable[[Column], Column]:
    starred = _among(fam, lambda r: r.starred)
    return lambda s: s.startswith("*") & starred & ~s.startswith("*/")


def _code_lines(fam: Column) -> tuple[Test, Test]:
    """Whether a line outside block comments, or one that opens one, is code."""
    comment, starred, preprocessor = _comment(fam), _starred(fam), _among(fam, lambda r: r.preprocessor)

    def opening(s: Column) -> Column:
        before = strip(F.substring_index(s, "/*", 1))
        return (before != "") & ~before.startswith("//")

    return (lambda s: (s.startswith("#") & preprocessor) | ~(starred(s) | (comment(s) & (F.length(s) > 2)))), opening


def logical_loc(fam: Column, stripped: Column) -> Column:
    """Lines that are neither blank nor comment, from an array of stripped lines."""
    outside, opening = _code_lines(fam)
    return F.when(_among(fam, lambda r: True), _counted(stripped, outside, opening, 0))


def loc_passage(fam: Column, stripped: Column) -> Column:
    """What some lines of a file do to its count, for either state they may begin in: struct<out, in>, each
    struct<within, n>. Passages of a file, in order, give its count by ``joined_loc``."""
    outside, opening = _code_lines(fam)
    return F.struct(*(_stated(stripped, outside, opening, 0, F.lit(k == "in")).alias(k) for k in ("out", "in")))


def joined_loc(passages: Column) -> Column:
    """Lines of code of a file from the array of its passages in order."""

    def step(acc: Column, p: Column) -> Column:
        next_ = F.when(acc["within"], p["in"]).otherwise(p["out"])
        return F.struct(next_["within"].alias("within"), (acc["n"] + next_["n"]).alias("n"))

    return F.aggregate(passages, F.struct(F.lit(False).alias("within"), F.lit(0).cast("long").alias("n")), step, lambda acc: acc["n"])


def comment_ratio(fam: Column, stripped: Column) -> Column:
    """Comment lines over all lines, 0 for no lines."""
    comment, starred = _comment(fam), _starred(fam)
    n = F.size(stripped)
    found = F.when(_among(fam, lambda r: True), _counted(stripped, lambda s: starred(s) | comment(s), lambda s: F.lit(True), 1)).otherwise(0)
    return F.when(n > 0, found / n).otherwise(0.0)


def first_part(c: Column, mark: str = ".") -> Column:
    return F.substring_index(c, mark, 1)


def modules(found: Column, keep: Callable[[Column], Column], cut: Callable[[Column], Column]) -> Column:
    """Modules that are kept, cut to the part that counts, each once, in order."""
    kept = F.transform(F.filter(found, lambda m: (m != "") & keep(m)), lambda m: cut(m))
    return F.array_distinct(F.filter(kept, lambda m: m != ""))


def said(pattern: str, group: int = 1) -> Callable[[Column], Column]:
    return lambda line: F.regexp_extract(line, U + pattern, group)


def _always(m: Column) -> Column:
    return F.lit(True)


def _python_imports(lines: Column) -> Column:
    named, plain = said(r"^\s*from\s+([\w.]+)\s+import"), said(r"^\s*import\s+([\w.]+)")
    return modules(F.transform(lines, lambda x: F.when(x.rlike(U + r"^\s*from\s+\."), "").otherwise(F.coalesce(filled(named(x)), plain(x)))), _always, first_part)


def _js_imports(lines: Column) -> Column:
    return modules(F.transform(lines, said(r"""(?:from|require\()\s*['"]([\w@/\-]+)['"]""")), lambda m: ~m.startswith("/"), lambda m: first_part(F.regexp_replace(m, "^@+", ""), "/"))


def _go_imports(lines: Column) -> Column:
    return modules(F.transform(lines, said(r'^\s*(?:import\s+)?"([\w./\-]+)"')), lambda m: m.contains("/"), lambda m: m)


def _rust_imports(lines: Column) -> Column:
    used = said(r"^\s*use\s+([\w:]+)")
    return modules(F.transform(lines, lambda x: F.when(x.rlike(U + r"^\s*use\s+(super|crate|self)::"), "").otherwise(used(x))), _always, lambda m: first_part(m, "::"))


def _foreign(m: Column) -> Column:
    return ~starts_any(m, K.JAVA_STDLIB_PREFIXES)


def _java_imports(lines: Column) -> Column:
    return modules(F.transform(lines, said(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;")), _foreign, first_part)


def _kotlin_imports(lines: Column) -> Column:
    return modules(F.transform(lines, said(r"^\s*import\s+([\w.]+)(?:\s+as\s+\w+)?\s*$")), lambda m: _foreign(m) & ~m.startswith("kotlin."), first_part)


def _c_imports(lines: Column) -> Column:
    quoted, angled = said(r'^\s*#include\s+"([^"]+)"'), said(r"^\s*#include\s+<([^>]+)>")
    top = lambda m: first_part(first_part(m, "/"))
    known = strings([*K.C_STDLIB, *K.CPP_STDLIB])
    outside = lambda x: F.when(F.array_contains(known, top(angled(x))), "").otherwise(top(angled(x)))
    return modules(F.transform(lines, lambda x: F.coalesce(filled(top(quoted(x))), F.when(quoted(x) == "", outside(x)), F.lit(""))), _always, lambda m: m)


def _csharp_imports(lines: Column) -> Column:
    used = said(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", 2)
    return modules(F.transform(lines, used), lambda m: ~m.startswith("System") & (first_part(m) != "Microsoft"), first_part)


def _ruby_imports(lines: Column) -> Column:
    return modules(F.transform(lines, said(r"^\s*require\s+['\"]([^'\"]+)['\"]")), _always, lambda m: first_part(m, "/"))


def _php_imports(lines: Column) -> Column:
    return modules(F.transform(lines, said(r"^\s*use\s+([\w\\]+)")), _always, lambda m: first_part(F.regexp_replace(m, r"^\\+", ""), "\\"))


def _swift_imports(lines: Column) -> Column:
    return modules(F.transform(lines, said(r"^\s*import\s+(\w+)")), lambda m: ~F.array_contains(strings(K.SWIFT_STDLIB), m), lambda m: m)


def external_imports(fam: Column, lines: Column) -> Column:
    """Modules that are imported, each once, in order."""
    return by_family(fam, lambda _, rules: rules.imports and rules.imports(lines), F.array().cast("array<string>"))


NEIGHBOURS = "array<struct<name:string,level:int>>"


def _js_relative(content: Column) -> Column:
    def of(path: Column) -> Column:
        level = F.when(path.startswith("./"), 1).otherwise((F.length(path) - F.length(F.replace(path, F.lit("../"), F.lit("")))) / 3 + 1).cast("int")
        cut = F.split(F.regexp_replace(F.regexp_replace(path, r"^\.*/*", ""), "/+$", ""), "/")
        last = F.regexp_replace(F.element_at(cut, -1), r"\.(js|ts|jsx|tsx|mjs|cjs)$", "")
        named = F.when(last == "index", F.coalesce(F.get(cut, F.size(cut) - 2), F.lit(""))).otherwise(last)
        return F.struct(named.alias("name"), level.alias("level"))

    found = F.transform(matches(content, U + r"""(?:from|require\()\s*['"](\.{1,2}/[\w./@\-~]+)['"]"""), of)
    return F.array_distinct(F.filter(found, lambda s: s["name"] != "")).cast(NEIGHBOURS)


def _rust_relative(content: Column) -> Column:
    at = U + r"^\s*use\s+(super|crate|self)(?:::([\w.]+))?"  # only at the very start of a file
    word, inner = F.regexp_extract(content, at, 1), first_part(F.regexp_extract(content, at, 2))
    return F.when(inner != "", F.array(F.struct(inner.alias("name"), F.when(word == "super", 2).otherwise(1).cast("int").alias("level")))).otherwise(F.array().cast(NEIGHBOURS))


def relative_imports(fam: Column, content: Column) -> Column:
    """array<struct<name, level>> of families that need no parser for it."""
    return by_family(fam, lambda _, rules: rules.relative and rules.relative(content), F.array().cast(NEIGHBOURS))


def _but(*words: str) -> Callable[[Column], Column]:
    return lambda names: F.filter(names, lambda n: ~n.isin(*words))


def _c_names(found: list[Column], content: Column) -> Column:
    kept = [_but("if", "for", "while", "switch", "return", "sizeof")(x) for x in found]
    return F.concat(kept[0], F.array_distinct(F.array_except(kept[1], kept[0])))


def _swift_names(found: list[Column], content: Column) -> Column:
    named = lambda p: lambda m: F.regexp_extract(m, U + p, 1)
    return F.concat(*(F.transform(F.filter(matches(content, UM + p, 0), lambda m: ~m.contains("private")), named(p)) for p in RULES["swift"].api))


def public_api(fam: Column, content: Column) -> Column:
    """Names of public declarations in order of the patterns, of families that need no parser for it."""

    def of(_: str, rules: Rules) -> Column | None:
        if not rules.api:
            return None
        found = [matches(content, UM + p) for p in rules.api]
        return rules.names(found, content) if rules.names else F.concat(*found)

    return by_family(fam, of, F.array().cast("array<string>"))


def _word_first(pattern: str) -> str:
    """A pattern that begins at the start of a word, as one that finds the word and then looks back at its start:
    the same matches, but no test of Unicode classes at every character."""
    return re.sub(r"^\\b([a-z]+)", r"\1(?<=\\b\1)", pattern)


def complexity(fam: Column, content: Column) -> Column:
    """One more than the branches; Python's comes from ``parsed``."""

    def of(_: str, rules: Rules) -> Column | None:
        if not rules.complexity:
            return None
        out = F.lit(1)
        for p in rules.complexity:
            out = out + F.regexp_count(content, F.lit(U + _word_first(p)))
        return out.cast("int")

    return by_family(fam, of, F.lit(0))


def _js_internal(x: Column) -> Column:
    came = F.regexp_extract(x, U + r"""^\s*import\s+.*from\s+["']([\w./@\-~]+)""", 1)
    scope = F.regexp_extract(came, "^@([^/]*)/", 1)
    need = F.regexp_extract(x, U + r"""^\s*(?:const|let|var)\s+\w+\s*=\s*require\(["']([\w./@\-~]+)["']\)""", 1)
    own = starts_any(came, [".", "/", "@/", "~/"]) | (came.rlike("^@.[^/]*/|^@/.*/") & ~F.array_contains(strings(K.EXTERNAL_SCOPES), scope))
    return own | starts_any(need, [".", "@/", "~/"])


def internal_lines(fam: Column, lines: Column) -> Column:
    """Lines that import from the project, of families that show it by themselves."""
    return by_family(fam, lambda _, rules: rules.internal and F.size(F.filter(lines, rules.internal)), F.lit(0))


def python_roots(lines: Column) -> Column:
    """The first name of every absolute import line of a Python file, repeats included."""
    found = F.transform(lines, lambda x: F.when(x.rlike(U + r"^\s*from\s+\."), "").otherwise(F.coalesce(filled(F.regexp_extract(x, U + r"^\s*from\s+([\w.]+)\s+import", 1)), F.regexp_extract(x, U + r"^\s*import\s+([\w.]+)", 1))))
    return F.transform(F.filter(found, lambda m: m != ""), lambda m: first_part(m))


def _among_names(known: list[str], heavy: list[str]) -> Callable[[Column], Column]:
    return lambda m: F.when(F.array_contains(strings(known), F.lower(m)), 0).when(F.array_contains(strings(heavy), F.lower(m)), 3).otherwise(1)


def _go_weight(m: Column) -> Column:
    return F.when(F.array_contains(strings(K.GO_STDLIB), first_part(F.lower(m), "/")), 0).when(contains_any(F.lower(m), K.GO_HEAVY), 3).otherwise(1)


def dependency_weight(fam: Column, imports: Column) -> Column:
    """struct<weight, stdlib_only>: 0 for the standard library, 3 for heavy modules, else 1."""
    weights = by_family(fam, lambda _, rules: rules.weight and F.transform(imports, rules.weight), F.transform(imports, lambda m: F.lit(1)))
    return F.struct(F.coalesce(F.array_max(weights), F.lit(0)).cast("int").alias("weight"), F.forall(weights, lambda w: w == 0).alias("stdlib_only"))


def _first(block: Column, test: Callable[[Column], Column]) -> Column:
    """Where the first line that passes stands, counted from 1; one more than there are lines where none does."""
    return F.array_position(F.concat(F.transform(block, test), F.array(F.lit(True))), F.lit(True)).cast("int")


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _top(stripped: Column, skip: str, window: int) -> Column:
    """How many lines at the top, among the first ``window``, match ``skip``."""
    return _first(F.slice(stripped, 1, window), lambda s: ~s.rlike(skip)) - 1


def _until(block: Column, last: Callable[[Column], Column]) -> Column:
    """``block`` up to the first line that ends it, that one included."""
    return F.slice(block, F.lit(1), _first(block, last))


def _joined(block: Column) -> Column:
    return strip(F.array_join(block, "\n"))


def _block_doc(rules: Rules, lines: Column, stripped: Column) -> Column:
    """A block comment at the top."""

    def of(at: Column) -> Column:
        opened = starts_any(F.coalesce(F.get(stripped, at), F.lit("")), rules.doc_open)
        return F.when(opened, _joined(_until(F.slice(lines, at + 1, 30), lambda x: strip(x).endswith("*/")))).otherwise("")

    return _bound(_top(stripped, rules.skip_before_doc, rules.doc_window), of)


def _run_doc(lines: Column, test: Callable[[Column], Column], window: int, skipped: Callable[[Column], Column] | None = None) -> Column:
    """The first run of lines that pass, among the first ``window``."""
    some = F.slice(lines, 1, window)
    if skipped is not None:
        some = F.filter(some, lambda x: ~skipped(strip(x)))
    at = F.array_position(F.transform(some, lambda x: test(strip(x))), F.lit(True)).cast("int")
    rest = F.slice(some, F.greatest(at, F.lit(1)), window)
    end = F.array_position(F.transform(rest, lambda x: test(strip(x))), F.lit(False)).cast("int")
    return F.when(at > 0, _joined(F.slice(rest, 1, F.when(end > 0, end - 1).otherwise(window)))).otherwise("")


def _python_doc(lines: Column, stripped: Column) -> Column:
    at = _top(stripped, "^$|^#|coding:|^from __future__|^import __future__", 10)
    opening = F.coalesce(F.get(stripped, at), F.lit(""))
    quote = F.when(opening.contains('"""'), F.lit('"""')).otherwise(F.lit("'''"))
    closed = F.length(opening) - F.length(F.replace(opening, quote, F.lit(""))) >= 6
    rest = _until(F.slice(lines, at + 2, 20), lambda x: x.contains(quote))
    first = F.regexp_replace(F.coalesce(F.get(lines, at), F.lit("")), "^\\s+", "")
    return F.when(~starts_any(opening, ['"""', "'''"]), "").when(closed, strip(first)).otherwise(_joined(F.concat(F.array(first), rest)))


def _ruby_doc(lines: Column, stripped: Column) -> Column:
    begin = F.array_position(F.transform(F.slice(stripped, 1, 100), lambda s: s == "=begin"), F.lit(True)).cast("int")
    block = F.when(begin > 0, _joined(F.concat(F.array(F.element_at(lines, F.greatest(begin, F.lit(1)))), _until(F.slice(lines, begin + 1, 29), lambda x: strip(x) == "=end")))).otherwise("")
    return F.coalesce(filled(_run_doc(lines, lambda s: s.startswith("#"), 20, lambda s: s.startswith("#") & s.rlike("frozen_string_literal|encoding:|coding:"))), block)


def _rust_doc(lines: Column, stripped: Column) -> Column:
    return _run_doc(lines, lambda s: starts_any(s, ["///", "//!"]), 30)


def _csharp_doc(lines: Column, stripped: Column) -> Column:
    return F.coalesce(filled(_block_doc(RULES["csharp"], lines, stripped)), _run_doc(lines, lambda s: s.startswith("///"), 30))


def docstring(fam: Column, lines: Column, stripped: Column) -> Column:
    """The module's documentation or '', of families that need no parser for it."""

    def of(_: str, rules: Rules) -> Column | None:
        if rules.doc:
            return rules.doc(lines, stripped)
        return _block_doc(rules, lines, stripped) if rules.skip_before_doc else None

    return by_family(fam, of, F.lit(""))


PARSED = "struct<names:array<string>,complexity:int,relative:array<struct<name:string,level:int>>,doc:string,err:string>"


#: A line up to its comment: strings, closed or not, and whatever else is no ``#``.
_CODE = re.compile(r"""(?:[^"'#]|"(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$))*""")
#: A relative import: dots, module, and its names up to the end of the line, or in brackets up to a line that ends with one.
_RELATIVE = re.compile(r"^[^\S\n]*from[^\S\n]+(\.+)([\w.]*)[^\S\n]+import[^\S\n]+(\((?s:.*?)\)[^\S\n]*$|\((?s:.*)\Z|[^(\s].*$)", re.M)


def python_relative(content: str) -> list[tuple[str, int]]:
    """(module, or each name where only dots are said; number of dots) of relative imports, each once."""
    code = "\n".join(_CODE.match(x)[0] for x in content.splitlines())
    found: list[tuple[str, int]] = []
    for dots, module, names in _RELATIVE.findall(code):
        plain = [n.strip().partition(" as ")[0].strip() for n in re.sub("[()\n]", " ", re.sub(r"[^\S\n]*\n", " ", names, count=1)).split(",")]
        said = [module.partition(".")[0]] if module else [n for n in plain if n != "*" and n[:1] not in ("", ".")]
        found += [(n, len(dots)) for n in said]
    return list(dict.fromkeys(found))


def python_tree(content: str) -> tuple[list[str], int]:
    """Public names, breadth first, and the cyclomatic complexity; nothing and 0 for wrong syntax."""
    try:
        nodes = [*ast.walk(ast.parse(content))]
    except SyntaxError:
        return [], 0
    names = [n.name for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n.name[0] != "_"]
    total = 1
    for n in nodes:
        match n:
            case ast.If() | ast.For() | ast.While() | ast.ExceptHandler() | ast.With() | ast.Assert() | ast.IfExp():
                total += 1
            case ast.BoolOp():
                total += len(n.values) - 1
            case ast.ListComp() | ast.SetComp() | ast.DictComp() | ast.GeneratorExp():
                total += sum(1 + len(g.ifs) for g in n.generators)
    return names, total


def go_doc(content: str) -> str:
    """The comment before ``package``, or else before the first exported declaration that has one."""
    lines = content.splitlines()
    bare = [x.strip() for x in lines]
    package = next((i for i, s in enumerate(bare[:100]) if s.startswith("package ")), None)
    if package is None:
        return ""

    def above(i: int) -> list[int]:
        """Comment lines over line i; blank lines may stand between."""
        found = []
        while (i := i - 1) >= 0 and (not bare[i] or bare[i].startswith("//")):
            if bare[i]:
                found.insert(0, i)
        return found

    legal = lambda rows: all("copyright" in bare[i].lower() or "license" in bare[i].lower() for i in rows)
    rows = above(package)
    if rows and not legal(rows):
        return "\n".join(lines[i] for i in rows).strip()
    for i, s in enumerate(bare):
        if re.match(r"(func|type|var)\s+[A-Z]\w*", s) and (rows := above(i)) and not legal(rows):
            return "\n".join(bare[j][2:].strip() for j in rows).strip()
    return ""


def _parse_python(content: str) -> dict:
    names, total = python_tree(content)
    return {"names": names, "complexity": total, "relative": [{"name": n, "level": k} for n, k in python_relative(content)]}


def _parse_go(content: str) -> dict:
    return {"doc": go_doc(content)}


def by_parser(what: str = "") -> list[str]:
    """Families whose parser gives ``what``, or anything."""
    return [name for name, rules in RULES.items() if rules.parse and (not what or what in rules.parses)]


def parsed(fam: Column, content: Column) -> Column:
    """What needs a parser; others get empty values. ``err`` names what a file made fail."""
    parsers = {name: RULES[name].parse for name in by_parser()}

    def run(fam: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for f, c in zip(fam, content, strict=True):
            found, err = {}, None
            try:
                if c and f in parsers:
                    found = parsers[f](c)
            except (ValueError, RecursionError, MemoryError) as e:  # of this one file: it is left out and counted
                err = type(e).__name__
            rows.append((found.get("names", []), found.get("complexity", 0), found.get("relative", []), found.get("doc", ""), err))
        return pd.DataFrame(rows, columns=["names", "complexity", "relative", "doc", "err"])

    return F.pandas_udf(run, PARSED)(fam, content)


def told(what: str, fam: Column, parsed: Column, otherwise: Column) -> Column:
    """``what`` from the parser, of families whose parser gives it, else the expression."""
    return F.when(fam.isin(by_parser(what)), parsed[what]).otherwise(otherwise)


_JS_ENDS = (".ts", ".tsx", ".js", ".jsx")
_OWN = {
    "python": {
        "imports": _python_imports, "doc": _python_doc, "internal": lambda x: x.rlike(U + r"^\s*from\s+\."), "weight": _among_names(K.PYTHON_STDLIB, K.PYTHON_HEAVY),
        "siblings": ("{}.py", "{}/__init__.py"), "parse": _parse_python, "parses": ("names", "complexity", "relative"),
    },
    "js": {
        "imports": _js_imports, "relative": _js_relative, "names": lambda found, content: F.array_distinct(_but("default")(found[0])), "internal": _js_internal, "weight": _among_names([""], K.JS_HEAVY),
        "siblings": tuple(f"{{}}{mid}{e}" for mid in ("", "/index") for e in _JS_ENDS),
    },
    "go": {"imports": _go_imports, "weight": _go_weight, "parse": _parse_go, "parses": ("doc",)},
    "rust": {
        "imports": _rust_imports, "relative": _rust_relative, "doc": _rust_doc, "internal": lambda x: x.rlike(U + r"^\s*use\s+(crate|super|self)"), "weight": _among_names(K.RUST_STDLIB, [""]),
        "siblings": ("{}.rs", "{}/mod.rs"),
    },
    "java": {"imports": _java_imports, "names": lambda found, content: F.concat(found[0], _but("class", "interface", "enum")(found[1]))},
    "kotlin": {"imports": _kotlin_imports},
    "c": {"imports": _c_imports, "names": _c_names},
    "csharp": {"imports": _csharp_imports, "doc": _csharp_doc, "names": lambda found, content: F.concat(found[0], _but("class", "interface", "struct", "enum")(found[1]))},
    "ruby": {"imports": _ruby_imports, "doc": _ruby_doc, "internal": lambda x: x.rlike(U + r"^\s*require_relative\s+")},
    "php": {"imports": _php_imports},
    "swift": {"imports": _swift_imports, "names": _swift_names},
}
for _family, _more in _OWN.items():
    RULES[_family] = replace(RULES[_family], **_more)
