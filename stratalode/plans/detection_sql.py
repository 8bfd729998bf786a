"""Detection, scores and what follows from them as SQL for another engine, put together from
the parts in ``oracle``. What the corpus cannot hold (modules of other names, other documentation)
is left out here; the fixed repositories cover it.
"""

from __future__ import annotations

from stratalode.functions import constants as K
from stratalode.plans import oracle as O
from stratalode.plans.corpus import SRC_CTE


def _after(whole: str, start: str, until: str = "") -> str:
    rest = whole[len(start) :]
    return rest[: rest.index(until)] if until else rest


def _any(c: str, values: list[str]) -> str:
    return f"len(list_filter([{O._list(values)}], lambda v: contains({c}, v))) > 0"


_KEPT = _after(O.SQL["scan_filters"], SRC_CTE).split("WHERE", 1)[1]
_GATE = _after(O.SQL["hard_gates"], SRC_CTE).split("WHERE", 1)[1]
_SCORE = O.SQL["filename_score"].split("SELECT repo, path,", 2)[2].split("AS filename_score", 1)[0].replace("(s, p)", f"(lower({O.STEM}), p)").replace("WHEN s IN", f"WHEN lower({O.STEM}) IN").replace("contains(s,", f"contains(lower({O.STEM}),")
_DOCS = _after(O.SQL["docstrings"], O.LINED).replace("marked", "hashed")
_HITS = _after(O.SQL["sibling_resolution"], f"{O.LINED}, {O.RELATIVE}", "SELECT repo, path, coalesce(string_agg")
_TRIED = _after(O.SQL["has_test"], SRC_CTE, "SELECT DISTINCT tried.repo").replace("named", "test_names")
_REACH, _CYCLES = _after(O.SQL["import_cycles"], O.EDGES).split("SELECT x.repo", 1)
_MODIFIERS = "(public|private|protected|static|final|abstract|open|sealed|suspend|inline|override|async|synchronized|internal|fileprivate|companion)"
_FUNCTION = rf"(?m)^\s*{_MODIFIERS}*\s*(def |func |fn |function |void |int |string |bool |var |let |const |public |private |protected )"
_CLASS = r"(?m)^\s*(public|private|protected|static|final|abstract|open|sealed|internal|fileprivate|data|companion)*\s*(class |struct |interface |enum |trait |impl |object |protocol |record )"
_COMPLEXITY = "CASE fam " + " ".join(f"WHEN '{f}' THEN 1 + " + " + ".join(f"len(regexp_extract_all(content, '{p}'))" for p in ps) for f, ps in O._BRANCHES.items()) + " ELSE coalesce(branches.c, 0) END"
_OWN = r"""CASE fam WHEN 'js' THEN len(list_filter(ls, lambda x: regexp_matches(x, '^\s*import\s+.*from\s+["''](\.|/|@/|~/)'))) WHEN 'python' THEN len(list_filter(ls, lambda x: regexp_matches(x, '^\s*from\s+\.'))) ELSE 0 END"""
_WHY = f"""list_filter([
  CASE WHEN tests THEN 'Has corresponding test file' END, CASE WHEN doc <> '' THEN 'Has module-level documentation' END,
  CASE internal WHEN 0 THEN 'Zero internal project imports — fully self-contained' WHEN 1 THEN 'Only 1 internal import — loosely coupled' END,
  CASE WHEN outside <= 3 THEN 'Small dependency footprint (' || outside || ' external import(s))' END,
  CASE WHEN loc < 50 THEN 'Very small (' || loc || ' LOC)' WHEN loc < 150 THEN 'Manageable size (' || loc || ' LOC)' END,
  CASE WHEN fscore > 0 THEN 'Filename suggests a reusable utility' END,
  CASE fan WHEN 0 THEN 'Zero fan-in (orphan) — nothing else depends on it' WHEN 1 THEN 'Low fan-in (1 importer)' END,
  CASE WHEN cyclic THEN '⚠ Part of an import cycle — extraction requires breaking the cycle first' END,
  CASE WHEN cc BETWEEN 1 AND 5 THEN 'Low cyclomatic complexity (cc=' || cc || ')' WHEN cc > 15 THEN '⚠ High cyclomatic complexity (cc=' || cc || ')' END,
  CASE WHEN weight = 0 THEN 'Stdlib-only — zero external dependencies, truly standalone' WHEN weight >= 3 THEN '⚠ Heavy dependencies (weight=' || weight || ')' END,
  CASE WHEN len(names) >= 3 THEN 'Rich API surface (' || len(names) || ' public functions/classes)' WHEN len(names) = 1 THEN '⚠ Only 1 public function — snippet, not a full library' END,
  CASE WHEN refs THEN '⚠ References framework internals' END,
  CASE WHEN ratio >= 0.15 THEN 'Well-commented (' || CAST(round_even(ratio * 100, 0) AS INT) || '% comment lines)' END,
  CASE WHEN useful IS NOT NULL THEN 'Solves a common problem (function: ' || useful || ')' END,
  CASE WHEN len(found) > 0 THEN '⚠ Multi-file extraction — also needs: ' || array_to_string(list_transform(found, lambda x: regexp_extract(x, '[^/]*$')), ', ') WHEN len(wanted_names) = 0 THEN '✓ Verified standalone — no relative imports, extractable as-is' END,
  CASE WHEN NOT licensed THEN '⚠ Source repo has NO license file — extraction is legally risky' END], lambda r: r IS NOT NULL)"""

#: All files that pass the hard gates, with their signals, the reason they are skipped for, and scores.
DETECTED = rf"""{SRC_CTE.replace(chr(10) + 'src AS (', chr(10) + 'all_src AS (')}, src AS (SELECT * FROM all_src WHERE {_KEPT}){_after(O.STATE, SRC_CTE)}{_after(O.IMPORTS, O.LINED)}
{_after(O.SQL['dependency_weight'], O.IMPORTS, 'SELECT repo, path, CAST(coalesce')}, {O.PY_BRANCHES}, {O.RELATIVE}{_HITS}{_after(O.EDGES, SRC_CTE)}{_REACH}{_TRIED},
logic AS ({_after(O.SQL['logical_loc'], O.STATE)}), ratios AS ({_after(O.SQL['comment_ratio'], O.STATE)}), legal AS ({_after(O.SQL['license_present'], SRC_CTE).replace('FROM src', 'FROM all_src')}){_DOCS.split('SELECT repo, path, CASE WHEN fam', 1)[0]},
docs AS (SELECT repo, path, CASE WHEN fam{_DOCS.split('SELECT repo, path, CASE WHEN fam', 1)[1]}), tested AS (SELECT DISTINCT tried.repo, tried.path FROM tried JOIN src ON tried.repo = src.repo AND tried.t = src.path),
fans AS (SELECT py.repo, py.path, count(src) AS fan FROM py LEFT JOIN edges ON py.repo = edges.repo AND py.path = edges.dst GROUP BY 1, 2), cycles AS (SELECT x.repo{_CYCLES}),
siblings AS (SELECT repo, path, list(name ORDER BY pos) AS wanted_names, coalesce(list(target ORDER BY pos) FILTER (target IS NOT NULL), []) AS found, coalesce(list(name ORDER BY pos) FILTER (target IS NULL), []) AS missing FROM hit GROUP BY repo, path),
project AS (SELECT DISTINCT repo, CASE WHEN len(cut) = 1 THEN stem ELSE cut[1] END AS module FROM py), rooted AS (SELECT read.repo, src AS path, count(*) AS n FROM read JOIN project ON read.repo = project.repo AND key = module WHERE NOT regexp_matches(line, '^\s*from\s+\.') GROUP BY 1, 2),
weights AS (SELECT repo, path, max(w) AS weight, count(*) AS outside FROM weighed GROUP BY 1, 2),
signals AS (SELECT fams.*, {O.LANG} AS language, CAST(logic.loc AS BIGINT) AS lines, CASE WHEN ends_with(path, '/mod.rs') AND logic.loc <= 30 AND 2 * len(list_filter(ls, lambda x: regexp_matches(x, '^\s*pub (mod |\(crate\) mod )'))) >= logic.loc THEN 'Rust mod.rs with only module declarations'
    WHEN ends_with(path, '/lib.rs') AND logic.loc <= 30 AND 2 * len(list_filter(ls, lambda x: regexp_matches(x, '^\s*pub (mod|use) '))) >= logic.loc THEN 'Rust lib.rs with only re-exports'
    WHEN logic.loc < 20 AND NOT regexp_matches(content, '{_FUNCTION}') AND NOT regexp_matches(content, '{_CLASS}') THEN 'Under 20 LOC with no function/class definitions'
    WHEN ext = '.py' AND logic.loc <= 50 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[A-Z_][A-Z_0-9]*\s*='))) >= logic.loc * 0.6 THEN 'Mostly constant definitions'
    WHEN ends_with(path, '.d.ts') THEN 'TypeScript declaration file (.d.ts)'
    WHEN contains(left(content, 500), 'automatically generated by SWIG') THEN 'SWIG auto-generated file'
    WHEN logic.loc <= 15 AND len(ls) <= 40 AND len(list_filter(ls[1:30], lambda x: regexp_matches(lower(x), 'copyright|licensed under|apache license|mit license|permission is hereby granted'))) >= 0.6 * len(ls) THEN 'Mostly copyright/license comments'
    WHEN {O.NAME} IN ('conf.py', 'settings.py', 'config.py', 'settings_prod.py', 'settings_dev.py') THEN 'Configuration file'
    WHEN ext = '.py' AND logic.loc > 10 AND 2 * list_sum(list_transform(regexp_extract_all(content, '(?ms)^\s*[A-Z][A-Z_]+\s*=\s*r?["]{{3}}.*?["]{{3}}'), lambda x: length(x) - length(replace(x, chr(10), '')))) >= logic.loc THEN 'Documentation-only file (string variables dominate)' END AS early,
    tested.path IS NOT NULL AS tests, docs.docstring AS doc, {_OWN} + coalesce(rooted.n, 0) AS internal, coalesce(outside, 0) AS outside, {_SCORE} AS fscore, array_to_string(ls[1:30], chr(10)) AS head, {_COMPLEXITY} AS cc,
    coalesce(fan, -1) AS fan, cycles.path IS NOT NULL AS cyclic, coalesce(weight, 0) AS weight, regexp_matches(content, '{'|'.join(K.PROJECT_REFS)}') AS refs, CASE fam {O._API} END AS names, comment_ratio AS ratio,
    coalesce(wanted_names, []) AS wanted_names, coalesce(found, []) AS found, coalesce(missing, []) AS missing, has_license AS licensed
  FROM fams JOIN logic USING (repo, path) JOIN ratios USING (repo, path) JOIN docs USING (repo, path) JOIN legal USING (repo) LEFT JOIN tested USING (repo, path) LEFT JOIN rooted USING (repo, path) LEFT JOIN weights USING (repo, path)
  LEFT JOIN fans USING (repo, path) LEFT JOIN cycles USING (repo, path) LEFT JOIN siblings USING (repo, path) LEFT JOIN branches USING (repo, path) WHERE logic.loc >= 10 AND {_GATE}
), gated AS (SELECT * EXCLUDE (loc), lines AS loc, CASE WHEN early IS NOT NULL THEN early WHEN internal >= 2 THEN internal || ' internal imports — tightly coupled' WHEN fan > 50 THEN 'High inbound fan-in (' || fan || ' importers) — too tightly coupled'
    WHEN fscore < -0.5 THEN 'Filename is a framework entry point' WHEN len(missing) > 0 THEN 'References missing sibling(s): ' || array_to_string(missing, ', ') END AS reason,
    list_filter(names, lambda n: {_any('lower(n)', K.COMMON_PROBLEMS)})[1] AS useful FROM signals
), told AS (SELECT *, reason IS NULL AS live, early IS NULL AND reason IS NOT NULL AND starts_with(reason, 'References missing') AS blocked FROM gated
), detected AS (SELECT repo, path, language, loc, early IS NULL AND tests AS has_tests, early IS NULL AND doc <> '' AS has_docstring, CAST(CASE WHEN early IS NULL THEN internal ELSE 0 END AS BIGINT) AS internal_imports,
  CAST(CASE WHEN early IS NULL THEN outside ELSE 0 END AS BIGINT) AS external_imports, CAST(CASE WHEN early IS NULL THEN fscore ELSE 0 END AS DOUBLE) AS filename_score, CASE WHEN live THEN doc ELSE '' END AS docstring_snippet, CASE WHEN live THEN head ELSE '' END AS first_lines,
  CAST(CASE WHEN live THEN cc ELSE 0 END AS BIGINT) AS complexity, CAST(CASE WHEN live THEN fan ELSE -1 END AS BIGINT) AS fan_in, live AND cyclic AS in_cycle, CAST(CASE WHEN live THEN weight ELSE 0 END AS BIGINT) AS dependency_weight,
  CAST(CASE WHEN live THEN len(names) ELSE 0 END AS BIGINT) AS api_surface_count, live AND weight = 0 AS is_stdlib_only, live AND refs AS has_project_specific_refs, CASE WHEN live THEN names ELSE [] END AS function_names, CASE WHEN live THEN ratio ELSE 0 END AS comment_ratio,
  CASE WHEN live OR blocked THEN wanted_names ELSE [] END AS relative_imports, CASE WHEN live THEN found ELSE [] END AS sibling_paths, CASE WHEN blocked THEN missing ELSE [] END AS missing_siblings,
  CASE WHEN blocked THEN 'blocked' WHEN live AND len(found) > 0 THEN 'multi' ELSE 'single' END AS extraction_type, NOT live AS skipped, coalesce(reason, '') AS skip_reason, licensed AS source_has_license, CASE WHEN live THEN {_WHY} ELSE [] END AS why_extractable FROM told)"""

_SCORED = rf"""{DETECTED}, marks AS (SELECT *, extraction_type = 'single' AND len(relative_imports) = 0 AS alone, extraction_type = 'multi' AS multi, CASE WHEN loc <= 500 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, floor((loc - 351) / 150) * 0.1) END AS over,
  len(list_filter(function_names, lambda n: {_any('lower(n)', list(K.GENERIC_FUNCTIONS))})) > 0 AS generic, len(list_filter(function_names, lambda n: length(n) > 25 OR length(n) - length(replace(n, '_', '')) > 3)) > 0 AS clumsy FROM detected
), dims AS (SELECT *, 2.5 * has_tests::INT + 1.5 * has_docstring::INT + CASE internal_imports WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 ELSE 0 END + CASE WHEN external_imports <= 3 THEN 1.5 WHEN external_imports <= 5 THEN 0.5 ELSE 0 END + CASE WHEN filename_score > 0 THEN 0.5 ELSE 0 END
   + CASE WHEN fan_in = 0 THEN 0.5 WHEN fan_in > 50 THEN -2.5 WHEN fan_in > 20 THEN -1.5 WHEN fan_in > 10 THEN -0.5 ELSE 0 END + CASE WHEN alone THEN 1 WHEN multi THEN -1 ELSE 0 END - CASE WHEN complexity > 20 THEN 3 WHEN complexity > 10 THEN 1.5 WHEN complexity > 5 THEN 0.5 ELSE 0 END
   - 2 * in_cycle::INT - CASE WHEN NOT has_docstring AND NOT has_tests THEN 1.5 ELSE 0 END + CASE WHEN has_docstring AND has_tests AND complexity BETWEEN 1 AND 5 THEN 1 ELSE 0 END + over AS q,
  4 + CASE WHEN alone THEN 2.5 WHEN multi THEN -1.5 ELSE 0 END + CASE dependency_weight WHEN 0 THEN 2 WHEN 1 THEN 0.5 WHEN 3 THEN -2.5 ELSE 0 END + CASE api_surface_count WHEN 0 THEN -2.5 WHEN 1 THEN -1 WHEN 2 THEN 0.5 ELSE 1.5 END - 2 * has_project_specific_refs::INT
   + CASE WHEN loc BETWEEN 50 AND 200 THEN 0.5 WHEN loc < 20 THEN -1.5 WHEN loc > 400 THEN -0.5 ELSE 0 END + 0.5 * has_tests::INT + 0.5 * has_docstring::INT + CASE WHEN internal_imports = 0 THEN 0.5 ELSE 0 END
   + CASE WHEN fan_in > 50 THEN -2.5 WHEN fan_in > 20 THEN -1.5 WHEN fan_in > 10 THEN -0.5 ELSE 0 END - CASE WHEN source_has_license THEN 0 ELSE 1 END AS r,
  4 + CASE WHEN generic THEN 1.5 WHEN clumsy THEN -1 ELSE 0 END + CASE WHEN lower({O.STEM}) IN ({O._list(list(K.USEFUL_STEMS))}) THEN 1 ELSE 0 END + CASE WHEN loc BETWEEN 50 AND 300 THEN 1 WHEN loc < 20 THEN -1.5 ELSE 0 END + 0.5 * has_tests::INT
   + CASE WHEN api_surface_count >= 3 THEN 1 WHEN api_surface_count = 1 THEN -0.5 WHEN api_surface_count = 0 THEN -1 ELSE 0 END + 0.5 * is_stdlib_only::INT AS u,
  4 + CASE WHEN comment_ratio >= 0.15 THEN 2 WHEN comment_ratio >= 0.05 THEN 1 WHEN comment_ratio = 0 AND loc > 30 THEN -1.5 ELSE 0 END + has_docstring::INT + CASE WHEN complexity <= 0 THEN 0 WHEN complexity <= 5 THEN 1.5 WHEN complexity <= 10 THEN 0.5 WHEN complexity > 20 THEN -2 WHEN complexity > 15 THEN -1 ELSE 0 END
   + CASE WHEN loc BETWEEN 50 AND 200 THEN 1 WHEN loc > 400 THEN -0.5 ELSE 0 END - over + 0.5 * has_tests::INT AS m FROM marks
), bounded AS (SELECT *, greatest(0, least(q, 10))::DOUBLE AS qq, greatest(0, least(r, 10))::DOUBLE AS rr, greatest(0, least(u, 10))::DOUBLE AS uu, greatest(0, least(m, 10))::DOUBLE AS mm FROM dims
), summed AS (SELECT *, 0.25::DOUBLE * qq + 0.15::DOUBLE * 5 + 0.1::DOUBLE * 5 + 0.15::DOUBLE * rr + 0.2::DOUBLE * uu + 0.15::DOUBLE * mm AS raw FROM bounded
), scored AS (SELECT *, CASE WHEN rr < 3 THEN raw * 0.5 ELSE raw END AS combined_score, CAST(CASE WHEN loc < 50 THEN 1.5 WHEN loc < 150 THEN 3 WHEN loc < 300 THEN 6 ELSE 16 END AS DOUBLE) AS ship_effort_hours FROM summed)"""

_STEM = f"lower({O.STEM})"
_TAGS = "list_concat([" + O._map("language", K.LANGUAGE_TAGS) + ", " + ", ".join(f"CASE WHEN {_any(_STEM, list(marks))} THEN '{tag}' END" for marks, tag in K.STEM_TAGS) + ", 'library', 'open-source'], " + (
    rf"list_filter(list_transform(string_split_regex(lower(docstring_snippet), '\s+'), lambda w: regexp_replace(w, '^[.,;:!?()\[\]{{}}'']+|[.,;:!?()\[\]{{}}'']+$', '', 'g')), lambda w: length(w) BETWEEN 4 AND 19 AND regexp_matches(w, '^\pL+$') AND w NOT IN ({O._list(list(K.TAG_NOISE))})))"
)
_CALLED = f"list_filter(list_transform(function_names, lambda n: lower(n)), lambda n: length(n) >= 4 AND n NOT IN ({O._list(list(K.QUERY_NOISE))}))[1:2]"
_FOLDER = "regexp_extract(path, '([^/]*)/[^/]*$', 1)"
_WORD = f"list_filter(function_names, lambda n: length(n) >= 3 AND NOT starts_with(n, '_') AND lower(n) NOT IN ({O._list(list(K.HINT_NOISE))}))[1]"
_SLUG = "regexp_replace(regexp_replace({}, '[^a-z0-9-]+', '-', 'g'), '^-|-$', '', 'g')"
#: The corpus's generic names stand in folders that tell something and don't repeat it.
NAMED = f"""{_SCORED}, tagged AS (SELECT *, list_filter({_TAGS}, lambda t: t IS NOT NULL) AS t, {_CALLED} AS called, lower({O.STEM}) AS low FROM scored), firsts AS (SELECT *, list_filter(t, lambda x, i: list_position(t, x) = i)[1:5] AS tags FROM tagged),
searched AS (SELECT * REPLACE (list_concat(CASE WHEN low IN ('util', 'utils', 'helper', 'helpers', 'common', 'lib', 'tool', 'tools', 'misc', 'mod', 'init', 'types', 'conf') THEN [] ELSE [{O.STEM}] END, called) AS called) FROM firsts),
named AS (SELECT *, CASE WHEN len(called) = 0 THEN {O.STEM} ELSE array_to_string(called, ' ') END AS query, CASE WHEN low IN ('mod', 'lib') THEN {_SLUG.format(f'lower({_FOLDER})')}
  WHEN low IN ({O._list(K.GENERIC_NAMES)}) AND {_FOLDER} <> '' THEN {_SLUG.format(f"lower({_FOLDER} || coalesce('-' || {_WORD}, ''))")} ELSE {_SLUG.format("regexp_replace(low, '[.]d$', '')")} END AS package FROM searched)"""
_LISTS = ("function_names", "relative_imports", "sibling_paths", "missing_siblings", "why_extractable")
SQL = {
    "detect_candidates": f"{DETECTED} SELECT * REPLACE (" + ", ".join(f"coalesce(array_to_string({c}, ','), '') AS {c}" for c in _LISTS) + ") FROM detected",
    "scored_candidates": f"{NAMED} SELECT repo, path, skipped, round(combined_score, 6) AS combined_score, ship_effort_hours, package AS suggested_name, array_to_string(tags, ',') AS tags, query FROM named",
    "extract_plan": rf"""{NAMED}, picked AS (SELECT *, regexp_extract(path, '\.[^.]*$') AS e FROM named WHERE NOT skipped AND combined_score >= 4.0 ORDER BY combined_score DESC, repo, path LIMIT 5),
        parts AS (SELECT repo, package, e, unnest(list_concat([path], sibling_paths)) AS p, unnest(generate_series(0, len(sibling_paths))) AS k FROM picked)
        SELECT repo, package, CASE WHEN e = '.py' THEN replace(package, '-', '_') || '/' WHEN e IN ('.ts', '.tsx', '.js', '.jsx', '.rs') THEN 'src/' ELSE '' END || CASE WHEN e = '.rs' AND k = 0 THEN 'lib.rs' ELSE regexp_extract(p, '[^/]*$') END AS rel_path FROM parts
        UNION ALL SELECT repo, package, unnest(list_concat(['README.md', 'LICENSE-REVIEW.md'], CASE e WHEN '.py' THEN ['pyproject.toml', replace(package, '-', '_') || '/__init__.py'] WHEN '.rs' THEN ['Cargo.toml'] WHEN '.go' THEN ['go.mod']
            ELSE CASE WHEN e IN ('.ts', '.tsx', '.js', '.jsx') THEN ['package.json', 'index.js'] ELSE [] END END)) FROM picked
        UNION ALL SELECT picked.repo, package, 'SOURCE-LICENSE' FROM picked JOIN src ON src.repo = picked.repo AND src.path = 'LICENSE'""",
    "report_summary": f"""{_SCORED}, shown AS (SELECT *, NOT skipped AND combined_score >= 5.0 AS s FROM scored) SELECT repo, count(*) AS analyzed, CAST(count_if(s) AS BIGINT) AS shown, CAST(count_if(NOT skipped AND NOT s) AS BIGINT) AS hidden, CAST(count_if(skipped) AS BIGINT) AS skipped,
        CAST(count_if(s AND extraction_type = 'single') AS BIGINT) AS single, CAST(count_if(s AND extraction_type = 'multi') AS BIGINT) AS multi, CAST(count_if(s AND extraction_type = 'blocked') AS BIGINT) AS blocked, CAST(coalesce(sum(loc) FILTER (s), 0) AS BIGINT) AS total_loc,
        round(coalesce(sum(complexity) FILTER (s), 0) / greatest(count_if(s), 1), 6) AS avg_complexity, CAST(count_if(s AND is_stdlib_only) AS BIGINT) AS stdlib_only, CAST(count_if(s AND NOT source_has_license) AS BIGINT) AS no_license FROM shown GROUP BY repo""",
    "report_top": f"{_SCORED} SELECT repo, path, round(combined_score, 6) AS combined_score FROM scored WHERE NOT skipped ORDER BY scored.combined_score DESC, repo, path LIMIT 10",
}
