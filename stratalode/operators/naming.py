"""Names, tags and search words for candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalode.functions import constants as K
from stratalode.functions.text import contains_any, filled, lookup, matches, name, parent, parts, slug, stem, strings

WORD = "[A-Za-z][A-Za-z0-9-]{2,}"


def hint(doc: Column, functions: Column) -> Column:
    """The first telling function name, else the first telling word of the documentation, else ''."""
    noise = strings(K.HINT_NOISE)
    named = F.filter(functions, lambda n: (F.length(n) >= 3) & ~n.startswith("_") & ~F.array_contains(noise, F.lower(n)))
    said = F.filter(matches(doc, WORD, 0), lambda w: ~F.array_contains(noise, F.lower(w)))
    return F.lower(F.coalesce(F.get(named, F.lit(0)), F.get(said, F.lit(0)), F.lit("")))


def suggest_name(path: Column, doc: Column, functions: Column, passed_over: Column | None = None) -> Column:
    """A package's name. Of files that were ``passed_over`` no documentation and no functions are known; where their
    folder tells nothing either they keep their own name."""
    s, folder = stem(path), name(parent(path))
    neutral = strings(K.NEUTRAL_DIRS)
    plain = (folder != "") & ~F.array_contains(neutral, folder)
    above = parts(parent(path))
    # of mod.rs and lib.rs: the own folder, else the outermost telling one
    outer = F.get(F.filter(above, lambda d: (d != "") & ~F.array_contains(neutral, d)), F.lit(0))
    typed = F.when(path.endswith(".d.ts"), F.regexp_replace(name(path), "\\.d\\.ts$", "")).otherwise(s)
    kebab = F.lower(F.regexp_replace(F.regexp_replace(typed, "([a-z0-9])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2"))
    word = hint(doc, functions)
    told = slug(folder)
    repeats = (slug(word) != "") & (told != "") & ((F.substring_index(told, "-", -1) == slug(word)) | (told == slug(word)) | told.endswith(F.concat(F.lit("-"), slug(word))))
    fallback = F.lit("extracted-utility")
    own = F.coalesce(filled(slug(kebab)), fallback)
    last = fallback if passed_over is None else F.when(passed_over, own).otherwise(fallback)
    generic = F.when(plain, F.when((word != "") & ~repeats, slug(F.concat(folder, F.lit("-"), word))).otherwise(told)).when(word != "", slug(word)).otherwise(last)
    usual = F.when(~F.array_contains(strings(K.GENERIC_NAMES), F.lower(typed)), own).otherwise(generic)
    return F.when(s.isin("mod", "lib") & plain, told).when(s.isin("mod", "lib") & outer.isNotNull(), slug(outer)).otherwise(usual)


def suggest_tags(path: Column, language: Column, doc: Column) -> Column:
    """At most five: language, what the file name tells, two fixed ones, words of the documentation."""
    low = F.lower(stem(path))
    fixed = [lookup(K.LANGUAGE_TAGS, language)]
    fixed += [F.when(contains_any(low, marks), tag) for marks, tag in K.STEM_TAGS] + [F.lit("library"), F.lit("open-source")]
    words = F.transform(F.split(F.lower(doc), "\\s+"), lambda w: F.regexp_replace(w, "^[.,;:!?()\\[\\]{}']+|[.,;:!?()\\[\\]{}']+$", ""))
    kept = F.filter(words, lambda w: F.length(w).between(4, 19) & w.rlike("^\\p{L}+$") & ~F.array_contains(strings(K.TAG_NOISE), w))
    return F.slice(F.array_distinct(F.concat(F.filter(F.array(*fixed), lambda t: t.isNotNull()), kept)), 1, 5)


def search_query(path: Column, doc: Column, functions: Column, first_lines: Column) -> Column:
    """Words to look for similar projects by: the name, two functions, else words and imports."""
    noise = strings(K.QUERY_NOISE)
    own = F.when(F.lower(stem(path)).isin(K.QUERY_GENERIC_STEMS), F.array().cast("array<string>")).otherwise(F.array(stem(path)))
    called = F.slice(F.filter(F.transform(functions, F.lower), lambda n: (F.length(n) >= 4) & ~F.array_contains(noise, n)), 1, 2)
    said = F.slice(F.filter(matches(doc, WORD, 0), lambda w: ~F.array_contains(noise, F.lower(w))), 1, 2)
    python = F.transform(matches(first_lines, "(?Umd)^\\s*(?:from|import)\\s+([\\w.]+)"), lambda m: F.lower(F.substring_index(m, ".", 1)))
    quoted = F.transform(matches(first_lines, "(?U)(?:from|require\\()\\s*['\"]([\\w@/\\-]+)['\"]"), lambda m: F.lower(F.substring_index(F.regexp_replace(m, "^@+", ""), "/", 1)))
    used = F.slice(F.array_distinct(F.filter(F.concat(python, quoted), lambda m: (F.length(m) >= 3) & ~F.array_contains(noise, m))), 1, 2)
    words = F.concat(own, F.when(F.size(called) > 0, called).otherwise(F.concat(said, used)))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(stem(path))
