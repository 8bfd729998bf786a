"""What a file does, in a line: from its documentation, its declarations or its first words.

Everything is an expression on arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalode.functions.languages import U
from stratalode.functions.text import contains_any, lines, strip

# Words of legal lines.
LEGAL = ("copyright", "licensed under", "license:", "permission is hereby", "all rights reserved")
# What declares a name, in this order; the flag keeps names with a leading underscore out.
DECLARATIONS = [
    (r"\s*func\s+(\w+)\s*\(", True),
    (r"\s*type\s+(\w+)\s", True),
    (r"\s*(?:var|const)\s+(\w+)\s", True),
    (r"def\s+(\w+)\s*\(", True),
    (r"class\s+(\w+)\s*[:\(]", False),
    (r"\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", False),
    (r"\s*(?:export\s+)?const\s+(\w+)\s*[:=]", False),
    (r"\s*export\s+default\s+(?:function|class)\s+(\w+)", False),
    (r"\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*(?:<[^>]*>)?\s*(?:\(|$)", False),
    (r"\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)", False),
    (r"\s*(?:public|private|protected|static|abstract|final|sealed|open|internal)*\s*(?:class|interface|enum|record|struct)\s+(\w+)", False),
    (r"\s*(?:public|private|protected|static|abstract|final|async|override)\s+\w+\s+(\w+)\s*\(", False),
    (r"\s*typedef\s+\w+\s+(\w+)", False),
]
# How lines start that tell nothing.
DULL = r"\s*package\s|\s*import\s|\s*\(|\s*\{\s*$|\s*\}\s*$|\s*$|\s*//|\s*#|\s*\*|\s*use\s+|\s*extern\s+|\s*pub\s+use"
# What a file that only names itself is called.
SELF = [
    (r"\s*package\s+(\w+)", "Package '{}' — contains declarations"),
    (r"\s*module\s+(\S+)", "Module '{}' — contains declarations"),
    (r"\s*(?:pub\s+)?mod\s+(\w+)", "Rust module '{}' — contains declarations"),
    (r"\s*extern\s+crate\s+(\w+)", "Extern crate '{}' — contains declarations"),
    (r"\s*#\s*define\s+(\w+)", "Header defines: {} (and more)"),
    (r"\s*#\s*ifdef\s+(\w+)", "Conditional compilation for {}"),
]
UNDERLINE = r"^[~\-=]+$"


def at_start(pattern: str) -> str:
    return f"{U}^(?:{pattern})"


def from_doc(doc: Column) -> Column:
    """The first telling line: no title, no rule, no mark of a tag, nothing legal; null if there is none."""
    cut = lines(doc)
    bare = F.transform(cut, lambda x: strip(F.regexp_replace(strip(F.regexp_replace(x, U + r"^[\s*/#!'\"?]+\s*", "")), "['\"]+$", "")))
    below = lambda i: strip(F.coalesce(F.get(cut, i + 1), F.lit("")))
    telling = lambda s, i: (F.length(s) > 5) & ~s.rlike(UNDERLINE) & ~s.startswith("@") & ~below(i).rlike(UNDERLINE) & ~contains_any(F.lower(s), LEGAL)
    said = F.transform(bare, lambda s, i: F.when(telling(s, i), F.substring(s, 1, 200)))
    return F.get(F.filter(said, lambda s: s.isNotNull()), F.lit(0))


def declared(line: Column) -> Column:
    """The name that a line declares, by the first pattern it fits; null if none, or if the name hides."""
    out = None
    for pattern, shy in DECLARATIONS:
        found = F.regexp_extract(line, at_start(pattern), 1)
        hit = line.rlike(at_start(pattern)), F.when(~found.startswith("_"), found) if shy else found
        out = F.when(*hit) if out is None else out.when(*hit)
    return out


def named_itself(line: Column) -> Column:
    out = None
    for pattern, form in SELF:
        before, after = form.split("{}")
        hit = line.rlike(at_start(pattern)), F.concat(F.lit(before), F.regexp_extract(line, at_start(pattern), 1), F.lit(after))
        out = F.when(*hit) if out is None else out.when(*hit)
    return out


def from_code(content: Column) -> Column:
    """Declared names, else the first telling lines, else what the file calls itself; null for neither."""
    cut = lines(content)
    known = lambda made: F.filter(made, lambda x: x.isNotNull())
    names = F.array_distinct(known(F.transform(cut, declared)))
    exports = F.concat(F.lit("Exports: "), F.array_join(F.slice(names, 1, 5), ", "), F.when(F.size(names) > 5, F.concat(F.lit(" (+"), (F.size(names) - 5).cast("string"), F.lit(" more)"))).otherwise(""))
    telling = F.transform(F.filter(F.transform(F.filter(cut, lambda x: ~x.rlike(at_start(DULL))), strip), lambda s: F.length(s) > 2), lambda s: F.substring(s, 1, 80))
    told = F.array_join(F.slice(telling, 1, 3), " | ")
    return F.when(F.size(names) > 0, exports).when(F.size(telling) > 0, told).otherwise(F.get(known(F.transform(cut, named_itself)), F.lit(0)))


def described(doc: Column, path: Column, content: Column) -> Column:
    doc, content = F.coalesce(doc, F.lit("")), F.coalesce(content, F.lit(""))
    return F.coalesce(F.when(doc != "", from_doc(doc)), F.when(content != "", from_code(content)), F.concat(F.lit("Source file at "), F.coalesce(path, F.lit(""))))
