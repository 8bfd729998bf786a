"""The same results as SQL for another engine, written from the rules and not from the operators."""

from __future__ import annotations

from stratalode.functions import constants as K
from stratalode.plans import fixture, golden
from stratalode.plans.corpus import SRC_CTE
from stratalode.plans.queries import ASOF, CCS, FANS, LOCS


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _map(key: str, table: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


LANG, FAM = _map("ext", K.LANGUAGE_BY_EXT), _map("ext", K.FAMILY_BY_EXT)
NAME = "regexp_extract(path, '[^/]*$')"
STEM = rf"regexp_replace({NAME}, '(.)\.[^.]+$', '\1')"
PARENT = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
PARTS = "string_split(lower(path), '/')"
LINES = "CASE WHEN ends_with(content, chr(10)) THEN string_split(left(content, length(content) - 1), chr(10)) WHEN content = '' THEN [] ELSE string_split(content, chr(10)) END"
LINED = f"""{SRC_CTE}, fams AS (SELECT *, {FAM} AS fam, {LINES} AS ls FROM src),
lined AS (SELECT repo, path, fam, ls[i] AS line, regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g') AS s, i AS pos
          FROM (SELECT *, unnest(generate_series(1, len(ls))) AS i FROM fams WHERE fam IS NOT NULL))"""
#: Whether a line stands inside a block comment: the last line before it that opened or closed one, opened it.
STATE = f"""{LINED}, marked AS (SELECT *, CASE WHEN contains(s, '*/') THEN 'C' WHEN contains(s, '/*') THEN 'O' END AS mark FROM lined),
stated AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'C') = 'O' AS within FROM marked)"""
STARRED = "fam IN ('js', 'java', 'kotlin', 'c', 'csharp', 'php', 'swift')"
COMMENT = "CASE WHEN fam IN ('python', 'ruby') THEN starts_with(s, '#') WHEN fam = 'rust' THEN starts_with(s, '//') WHEN fam = 'php' THEN starts_with(s, '//') OR starts_with(s, '#') OR starts_with(s, '/*') ELSE starts_with(s, '//') OR starts_with(s, '/*') END"
IMPORT = r"""CASE fam
  WHEN 'python' THEN CASE WHEN regexp_matches(line, '^\s*from\s+\.') THEN '' WHEN regexp_matches(line, '^\s*from\s+[\w.]+\s+import') THEN split_part(regexp_extract(line, '^\s*from\s+([\w.]+)\s+import', 1), '.', 1) ELSE split_part(regexp_extract(line, '^\s*import\s+([\w.]+)', 1), '.', 1) END
  WHEN 'js' THEN split_part(regexp_replace(regexp_extract(line, '(?:from|require\()\s*[''"]([\w@/\-]+)[''"]', 1), '^@+', ''), '/', 1)
  WHEN 'go' THEN CASE WHEN contains(regexp_extract(line, '^\s*(?:import\s+)?"([\w./\-]+)"', 1), '/') THEN regexp_extract(line, '^\s*(?:import\s+)?"([\w./\-]+)"', 1) ELSE '' END
  WHEN 'rust' THEN CASE WHEN regexp_matches(line, '^\s*use\s+(super|crate|self)::') THEN '' ELSE split_part(regexp_extract(line, '^\s*use\s+([\w:]+)', 1), '::', 1) END
  WHEN 'java' THEN CASE WHEN regexp_matches(line, '^\s*import\s+(?:static\s+)?(java|javax|javafx|jdk|sun|com\.sun|org\.w3c|org\.xml|org\.ietf)\.') THEN '' ELSE split_part(regexp_extract(line, '^\s*import\s+(?:static\s+)?([\w.]+)\s*;', 1), '.', 1) END
  WHEN 'kotlin' THEN CASE WHEN regexp_matches(line, '^\s*import\s+(java|javax|javafx|jdk|sun|com\.sun|org\.w3c|org\.xml|org\.ietf|kotlin)\.') THEN '' ELSE split_part(regexp_extract(line, '^\s*import\s+([\w.]+)(?:\s+as\s+\w+)?\s*$', 1), '.', 1) END
  WHEN 'c' THEN CASE WHEN regexp_matches(line, '^\s*#include\s+"[^"]+"') THEN split_part(split_part(regexp_extract(line, '^\s*#include\s+"([^"]+)"', 1), '/', 1), '.', 1)
       WHEN split_part(split_part(regexp_extract(line, '^\s*#include\s+<([^>]+)>', 1), '/', 1), '.', 1) IN (@C@) THEN '' ELSE split_part(split_part(regexp_extract(line, '^\s*#include\s+<([^>]+)>', 1), '/', 1), '.', 1) END
  WHEN 'csharp' THEN CASE WHEN regexp_matches(line, '^\s*(?:global\s+)?using\s+(?:static\s+)?(System|Microsoft\b)') THEN '' ELSE split_part(regexp_extract(line, '^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;', 1), '.', 1) END
  WHEN 'ruby' THEN split_part(regexp_extract(line, '^\s*require\s+[''"]([^''"]+)[''"]', 1), '/', 1)
  WHEN 'php' THEN split_part(regexp_replace(regexp_extract(line, '^\s*use\s+([\w\\]+)', 1), '^\\+', ''), chr(92), 1)
  ELSE CASE WHEN regexp_extract(line, '^\s*import\s+(\w+)', 1) IN (@SWIFT@) THEN '' ELSE regexp_extract(line, '^\s*import\s+(\w+)', 1) END END
""".replace("@C@", _list([*K.C_STDLIB, *K.CPP_STDLIB])).replace("@SWIFT@", _list(K.SWIFT_STDLIB))
IMPORTS = f"{LINED}, every AS (SELECT repo, path, fam, pos, {IMPORT} AS module FROM lined), imports AS (SELECT repo, path, fam, module, min(pos) AS place FROM every WHERE module <> '' GROUP BY ALL)"
_BRACED = [r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bcase\s+", r"\bcatch\s*\(", "&&", r"\|\|", r"\?\s*[^?]"]
_BRANCHES = {
    "js": [*_BRACED, r"\?\?"], "go": [r"\bif\s+", r"\bfor\s+", r"\bcase\s+", "&&", r"\|\|"],
    "rust": [r"\bif\s+", r"\bmatch\s+", r"\bfor\s+", r"\bwhile\s+", r"\bloop\s*\{", "&&", r"\|\|"], "java": _BRACED, "kotlin": _BRACED, "csharp": _BRACED, "php": _BRACED,
    "c": [p for p in _BRACED if "catch" not in p], "ruby": [*(rf"\b{w}\b" for w in "if elsif for while unless case when rescue".split()), "&&", r"\|\|"],
    "swift": [r"\bif\s+", r"\bfor\s+", r"\bwhile\s+", r"\bcase\s+", r"\bcatch\s*\{", "&&", r"\|\|"],
}
EDGES = rf"""{SRC_CTE}, py AS (SELECT repo, path, content, string_split(path, '/') AS cut, {STEM} AS stem, {PARENT} AS folder, {NAME} AS name FROM src WHERE ext = '.py'),
modules AS (SELECT repo, stem AS key, path AS dst FROM py UNION SELECT repo, cut[1], path FROM py WHERE len(cut) > 1
            UNION SELECT repo, CASE WHEN len(cut) > 1 THEN cut[len(cut) - 1] ELSE '' END, path FROM py WHERE name = '__init__.py'),
said AS (SELECT repo, path AS src, folder, unnest(string_split(content, chr(10))) AS line FROM py),
read AS (SELECT *, regexp_extract(line, '^\s*from\s+\.(\w*)\s+import', 1) AS beside,
         CASE WHEN regexp_matches(line, '^\s*from\s+[\w.]+\s+import') THEN split_part(regexp_extract(line, '^\s*from\s+([\w.]+)\s+import', 1), '.', 1)
              WHEN regexp_matches(line, '^\s*import\s+[\w.]+') THEN split_part(regexp_extract(line, '^\s*import\s+([\w.]+)', 1), '.', 1) END AS key FROM said),
near AS (SELECT repo, src, CASE WHEN folder = '' THEN '' ELSE folder || '/' END || beside || unnest(['.py', '/__init__.py']) AS dst FROM read WHERE beside <> ''),
edges AS (SELECT near.repo, src, dst FROM near JOIN py ON near.repo = py.repo AND near.dst = py.path WHERE src <> dst
          UNION SELECT read.repo, src, dst FROM read JOIN modules ON read.repo = modules.repo AND read.key = modules.key WHERE beside = '' AND src <> dst)"""


#: Branches of the corpus's Python files: every statement and comprehension stands on a line of its own.
PY_BRANCHES = r"""branches AS (SELECT repo, path, CAST(1 + sum(CASE WHEN starts_with(s, '#') THEN 0 ELSE CAST(regexp_matches(s, '^(if|for|while|with|assert|except)\b') AS INT) + len(regexp_extract_all(s, '\b(?:and|or)\b'))
  + CASE WHEN regexp_matches(s, '\[.* for .* in .*\]') THEN 1 + len(regexp_extract_all(s, ' if ')) ELSE 0 END END) AS BIGINT) AS c FROM lined WHERE fam = 'python' GROUP BY repo, path)"""
#: Names of the module first, then those inside classes.
PY_NAMES = r"list_concat(regexp_extract_all(content, '(?m)^(?:def|class) ([A-Za-z]\w*)', 1), regexp_extract_all(content, '(?m)^[ ]+(?:def|class) ([A-Za-z]\w*)', 1))"
RELATIVE = r"""scripts AS (SELECT repo, path, unnest(list_distinct(regexp_extract_all(content, '(?:from|require\()\s*[''"](\.{1,2}/[\w./@\-~]+)[''"]', 1))) AS p FROM fams WHERE fam = 'js'),
relative AS (SELECT repo, path, regexp_replace(regexp_extract(p, '[^/]*$'), '\.(js|ts|jsx|tsx|mjs|cjs)$', '') AS name, CAST(CASE WHEN starts_with(p, './') THEN 1 ELSE 1 + len(regexp_extract_all(p, '\.\./')) END AS BIGINT) AS level, 1 AS pos FROM scripts
  UNION ALL SELECT repo, path, split_part(regexp_extract(line, '^\s*from\s+\.+([\w.]*)\s+import', 1), '.', 1), CAST(length(regexp_extract(line, '^\s*from\s+(\.+)', 1)) AS BIGINT), pos FROM lined WHERE fam = 'python' AND regexp_matches(line, '^\s*from\s+\.+[\w.]+\s+import\s'))"""


def _found(*patterns: str, out: str = "") -> str:
    lists = [f"regexp_extract_all(content, '(?m){p}', 1)" for p in patterns]
    whole = lists[0] if len(lists) == 1 else f"list_concat({', '.join(lists)})"
    return f"list_filter({whole}, lambda n: n NOT IN ({out}))" if out else whole


_API = f"WHEN 'python' THEN {PY_NAMES} " + " ".join(f"WHEN '{f}' THEN {x}" for f, x in {
    "js": _found(r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum|namespace)\s+(\w+)", out="'default'"),
    "go": _found(r"^\s*func\s+([A-Z]\w*)", r"^\s*type\s+([A-Z]\w*)"), "rust": _found(r"^\s*pub\s+(?:async\s+)?fn\s+(\w+)", r"^\s*pub\s+(?:struct|enum|trait)\s+(\w+)"),
    "java": _found(r"^\s*public\s+(?:final\s+|abstract\s+|static\s+)*(?:class|interface|enum)\s+(\w+)", r"^\s*public\s+(?:final\s+|abstract\s+|static\s+|synchronized\s+)*(?:[\w<>\[\],?\s]+)\s+(\w+)\s*\(", out="'class', 'interface', 'enum'"),
    "kotlin": _found(r"^\s*(?:public\s+|open\s+|final\s+|abstract\s+|sealed\s+)*(?:fun|override\s+fun)\s+(\w+)", r"^\s*(?:public\s+|open\s+|final\s+|abstract\s+|sealed\s+)*(?:class|object|interface|enum\s+class|data\s+class)\s+(\w+)"),
    "c": _found(r"^\s*(?:\w[\w\s\*<>:,&]*?)\s+(\w+)\s*\([^)]*\)\s*\{", r"^\s*(?:\w[\w\s\*<>:,&]*?)\s+(\w+)\s*\([^)]*\)\s*;", out="'if', 'for', 'while', 'switch', 'return', 'sizeof'"),
    "csharp": _found(r"^\s*public\s+(?:sealed\s+|abstract\s+|static\s+|virtual\s+|override\s+|async\s+)*(?:class|interface|struct|enum)\s+(\w+)", r"^\s*public\s+(?:sealed\s+|abstract\s+|static\s+|virtual\s+|override\s+|async\s+)*(?:[\w<>\[\],?\s]+)\s+(\w+)\s*\(", out="'class', 'interface', 'struct', 'enum'"),
    "ruby": _found(r"^\s*def\s+(?:self\.)?(\w+)", r"^\s*(?:module|class)\s+(\w+)"),
    "php": _found(r"^\s*(?:public\s+|protected\s+|static\s+)*function\s+(\w+)", r"^\s*(?:final\s+|abstract\s+)*(?:class|interface|trait)\s+(\w+)"),
    "swift": _found(r"^\s*(?:public\s+|open\s+|internal\s+|fileprivate\s+)?func\s+(\w+)", r"^\s*(?:public\s+|open\s+|internal\s+|fileprivate\s+)?(?:struct|class|enum|protocol)\s+(\w+)"),
}.items())


def _cleaned(text: str) -> str:
    out = f"regexp_replace(regexp_replace(replace({text}, '```', '\\`\\`\\`'), '(?is)<script\\b.*?</script>', '', 'g'), '(?i)\\]\\(javascript:', '](disabled:', 'g')"
    for p in K.SECRET_PATTERNS[:-1]:
        out = f"regexp_replace({out}, '{p.replace(chr(39), chr(39) * 2)}', '***REDACTED***', 'g')"
    return rf"regexp_replace({out}, '(^|[^A-Za-z0-9])[a-f0-9]{{64,}}($|[^A-Za-z0-9])', '\1***REDACTED***\2', 'g')"


_CLEAN = _cleaned(f"(html || chr(10) || [{_list(fixture.TEXTS)}][page_id % {len(fixture.TEXTS)} + 1])")


def _pick(values: list, by: int) -> str:
    return f"[{', '.join(map(str, values))}][CAST(floor(key / {by}) AS BIGINT) % {len(values)} + 1]"


def _flag(by: int) -> str:
    return f"CAST(floor(key / {by}) AS BIGINT) % 2 = 1"


GRID = f"""WITH keyed AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS key FROM lineitem), g AS (
SELECT l_orderkey, l_linenumber, {_pick(LOCS, 1)} AS loc, {_pick(FANS, 2)} AS fan, {_pick(CCS, 3)} AS cc, {_pick([0, 1, 2, 3], 5)} AS api, {_pick([0, 1, 3], 7)} AS weight, {_pick([0, 1], 4)} AS internal,
  {_pick([0, 3, 4, 5, 6], 6)} AS outside, {_pick([0.0, 0.5, -0.5], 9)} AS fscore, CAST({_pick([0.0, 0.04, 0.05, 0.15], 8)} AS DOUBLE) AS ratio, {_flag(3)} AS tests, {_flag(5)} AS doc, {_flag(11)} AS cyclic, {_flag(13)} AS refs,
  {_flag(17)} AS plain, {_flag(19)} AS licensed, {_flag(2)} AS multi, {_flag(7)} AS generic, {_pick([-1, 0, 1, 2, 3, 5, 6], 10)} AS alike FROM keyed
), s AS (SELECT *, CASE WHEN loc <= 500 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, floor((loc - 351) / 150) * 0.1) END AS over FROM g
), d AS (SELECT *,
  2.5 * tests::INT + 1.5 * doc::INT + CASE internal WHEN 0 THEN 1.5 ELSE 0.5 END + CASE WHEN outside <= 3 THEN 1.5 WHEN outside <= 5 THEN 0.5 ELSE 0 END + CASE WHEN fscore > 0 THEN 0.5 ELSE 0 END
   + CASE WHEN fan = 0 THEN 0.5 WHEN fan > 50 THEN -2.5 WHEN fan > 20 THEN -1.5 WHEN fan > 10 THEN -0.5 ELSE 0 END + CASE WHEN multi THEN -1 ELSE 1 END
   - CASE WHEN cc > 20 THEN 3 WHEN cc > 10 THEN 1.5 WHEN cc > 5 THEN 0.5 ELSE 0 END - 2 * cyclic::INT - CASE WHEN NOT doc AND NOT tests THEN 1.5 ELSE 0 END + CASE WHEN doc AND tests AND cc BETWEEN 1 AND 5 THEN 1 ELSE 0 END + over AS q,
  4 + CASE WHEN multi THEN -1.5 ELSE 2.5 END + CASE weight WHEN 0 THEN 2 WHEN 1 THEN 0.5 ELSE -2.5 END + CASE api WHEN 0 THEN -2.5 WHEN 1 THEN -1 WHEN 2 THEN 0.5 ELSE 1.5 END - 2 * refs::INT
   + CASE WHEN loc BETWEEN 50 AND 200 THEN 0.5 WHEN loc < 20 THEN -1.5 WHEN loc > 400 THEN -0.5 ELSE 0 END + 0.5 * tests::INT + 0.5 * doc::INT + CASE WHEN internal = 0 THEN 0.5 ELSE 0 END
   + CASE WHEN fan > 50 THEN -2.5 WHEN fan > 20 THEN -1.5 WHEN fan > 10 THEN -0.5 ELSE 0 END - CASE WHEN licensed THEN 0 ELSE 1 END AS r,
  5 + CASE WHEN generic THEN 1.5 ELSE -1 END + CASE WHEN loc BETWEEN 50 AND 300 THEN 1 WHEN loc < 20 THEN -1.5 ELSE 0 END + 0.5 * tests::INT + CASE WHEN api >= 3 THEN 1 WHEN api = 1 THEN -0.5 WHEN api = 0 THEN -1 ELSE 0 END + 0.5 * plain::INT AS u,
  4 + CASE WHEN ratio >= 0.15 THEN 2 WHEN ratio >= 0.05 THEN 1 WHEN ratio = 0 AND loc > 30 THEN -1.5 ELSE 0 END + doc::INT + CASE WHEN cc <= 0 THEN 0 WHEN cc <= 5 THEN 1.5 WHEN cc <= 10 THEN 0.5 WHEN cc > 20 THEN -2 WHEN cc > 15 THEN -1 ELSE 0 END
   + CASE WHEN loc BETWEEN 50 AND 200 THEN 1 WHEN loc > 400 THEN -0.5 ELSE 0 END - over + 0.5 * tests::INT AS m,
  CASE WHEN alike < 0 THEN 5.0 WHEN alike = 0 THEN 8.0 WHEN alike <= 2 THEN 6.0 WHEN alike <= 5 THEN 4.0 ELSE 2.0 END AS n FROM s
), c AS (SELECT l_orderkey, l_linenumber, loc, CAST(greatest(0, least(q, 10)) AS DOUBLE) AS q, CAST(greatest(0, least(r, 10)) AS DOUBLE) AS r, CAST(greatest(0, least(u, 10)) AS DOUBLE) AS u, CAST(greatest(0, least(m, 10)) AS DOUBLE) AS m, CAST(n AS DOUBLE) AS n FROM d
), t AS (SELECT *, 0.25::DOUBLE * q + 0.15::DOUBLE * n + 0.1::DOUBLE * 5 + 0.15::DOUBLE * r + 0.2::DOUBLE * u + 0.15::DOUBLE * m AS raw FROM c)
SELECT l_orderkey, l_linenumber, round(q, 6) AS code_quality, round(r, 6) AS relevance, round(u, 6) AS usefulness, round(m, 6) AS maintainability, n AS uniqueness,
       round(CASE WHEN r < 3 THEN raw * 0.5 ELSE raw END, 6) AS combined_score, CAST(CASE WHEN loc < 50 THEN 1.5 WHEN loc < 150 THEN 3 WHEN loc < 300 THEN 6 ELSE 16 END AS DOUBLE) AS ship_effort_hours FROM t"""

TOP = f"""WITH p AS (SELECT 'acme/p' || p_partkey AS full_name, p_partkey * 37 % 3000 AS stars, p_partkey * 11 % 90 AS forks, p_partkey * 7 % 60 AS issues, 't' || p_partkey % 5 AS token,
  CASE WHEN p_partkey % 13 = 0 THEN 'soon' ELSE CAST(DATE '{ASOF}' - CAST(p_partkey % 1000 AS INT) AS VARCHAR) END AS pushed_at, p_partkey % 4 AS lang FROM part),
w AS (SELECT CAST(s_suppkey AS VARCHAR) AS path, s_suppkey % 4 AS lang, 't' || s_suppkey % 5 AS token FROM supplier),
top AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY stars DESC, full_name) AS rank, p.* FROM w JOIN p USING (lang, token)
        WHERE stars >= 5 AND pushed_at >= CAST(DATE '{ASOF}' - 730 AS VARCHAR) QUALIFY rank <= 5)"""
_MONTHS = f"CAST(floor((DATE '{ASOF}' - try_cast(pushed_at AS DATE)) / 30) AS BIGINT)"

SQL = golden.SQL | {
    "loc_by_language": f"{SRC_CTE} SELECT repo, {LANG} AS language, CAST(sum(loc) AS BIGINT) AS loc, count(*) AS files FROM src WHERE {LANG} IS NOT NULL GROUP BY 1, 2",
    "primary_language": f"{SRC_CTE}, sums AS (SELECT repo, {LANG} AS language, sum(loc) AS loc FROM src GROUP BY 1, 2) SELECT repo, language FROM sums WHERE language IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY loc DESC, language) = 1",
    "scan_filters": f"""{SRC_CTE} SELECT repo, path, size, loc FROM src WHERE NOT list_has_any({PARTS}, [{_list(K.SKIP_DIRS)}]) AND ext NOT IN ({_list(K.SKIP_EXTS)})
        AND NOT (starts_with({NAME}, '.') AND NOT ends_with({NAME}, '.example')) AND NOT contains(lower(path), 'generated')
        AND NOT regexp_matches(left(content, 500), '(?i)code generated by|do not edit|auto-generated|auto generated')""",
    "hard_gates": f"""{SRC_CTE} SELECT repo, path FROM src WHERE {LANG} IS NOT NULL AND NOT list_has_any({PARTS}, [{_list(K.TEST_DIRS + K.FRAMEWORK_DIRS)}])
        AND NOT regexp_matches(lower({STEM}), 'test_|_test|\\.test|\\.spec|conftest') AND {NAME} NOT IN ('__init__.py', 'conftest.py', {_list(K.FRAMEWORK_SPECIAL_FILES)})""",
    "filename_score": f"""{SRC_CTE}, named AS (SELECT repo, path, lower({STEM}) AS s FROM src) SELECT repo, path,
        CAST(0.5 * len(list_filter([{_list(K.UTILITY_PATTERNS)}], lambda p: contains(s, p))) - CASE WHEN s IN ({_list(K.FRAMEWORK_ENTRY_NAMES)}) THEN 3 ELSE 0 END
             - CASE WHEN contains(s, 'test') OR contains(s, 'spec') THEN 2 ELSE 0 END AS DOUBLE) AS filename_score,
        list_has_any({PARTS}, ['app', 'pages', 'routes']) OR {NAME} IN ({_list(K.FRAMEWORK_SPECIAL_FILES)}) AS is_route FROM named""",
    "license_present": f"""{SRC_CTE} SELECT repo, bool_or(NOT contains(path, '/') AND (lower(path) IN ({_list(K.LICENSE_NAMES)})
        OR regexp_matches(lower(path), '^(license|copying|unlicense|copyright)(\\.md|\\.txt|\\.rst|\\.less|\\.lesser)?$') OR regexp_matches(lower(path), '^license[-.]'))) AS has_license FROM src GROUP BY repo""",
    "logical_loc": f"""{STATE} SELECT repo, path, CAST(sum(CASE WHEN s = '' OR within THEN 0
        WHEN mark = 'O' THEN CASE WHEN trim(split_part(s, '/*', 1)) <> '' AND NOT starts_with(s, '//') THEN 1 ELSE 0 END
        WHEN fam = 'c' AND starts_with(s, '#') THEN 1 WHEN {STARRED} AND starts_with(s, '*') AND NOT starts_with(s, '*/') THEN 0
        WHEN {COMMENT} AND length(s) > 2 THEN 0 ELSE 1 END) AS INT) AS loc FROM stated GROUP BY repo, path""",
    "comment_ratio": f"""{STATE} SELECT repo, path, round(sum(CASE WHEN s = '' THEN 0 WHEN within OR mark = 'O' THEN 1
        WHEN {STARRED} AND starts_with(s, '*') AND NOT starts_with(s, '*/') THEN 1 WHEN {COMMENT} THEN 1 ELSE 0 END) / count(*), 6) AS comment_ratio FROM stated GROUP BY repo, path""",
    "external_imports": f"{IMPORTS} SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY place) - 1 AS pos, module FROM imports",
    "dependency_weight": f"""{IMPORTS}, weighed AS (SELECT repo, path, CASE fam WHEN 'python' THEN CASE WHEN lower(module) IN ({_list(K.PYTHON_STDLIB)}) THEN 0 WHEN lower(module) IN ({_list(K.PYTHON_HEAVY)}) THEN 3 ELSE 1 END
        WHEN 'js' THEN CASE WHEN lower(module) IN ({_list(K.JS_HEAVY)}) THEN 3 ELSE 1 END WHEN 'rust' THEN CASE WHEN lower(module) IN ({_list(K.RUST_STDLIB)}) THEN 0 ELSE 1 END
        WHEN 'go' THEN CASE WHEN split_part(lower(module), '/', 1) IN ({_list(K.GO_STDLIB)}) THEN 0 WHEN regexp_matches(lower(module), 'k8s\\.io|kubernetes|helm|gin|echo|grpc|protobuf|docker') THEN 3 ELSE 1 END ELSE 1 END AS w FROM imports)
        SELECT repo, path, CAST(coalesce(max(w), 0) AS INT) AS weight, coalesce(max(w), 0) = 0 AS stdlib_only FROM fams LEFT JOIN weighed USING (repo, path) WHERE fam IS NOT NULL GROUP BY repo, path""",
    "complexity": f"{LINED}, {PY_BRANCHES} SELECT f.repo, f.path, CAST(CASE fam " + " ".join(f"WHEN '{f}' THEN 1 + " + " + ".join(f"len(regexp_extract_all(content, '{p}'))" for p in ps) for f, ps in _BRANCHES.items()) + " ELSE coalesce(c, 0) END AS BIGINT) AS complexity FROM fams f LEFT JOIN branches USING (repo, path) WHERE fam IS NOT NULL",
    "python_metrics": rf"""{LINED}, {PY_BRANCHES}, {RELATIVE} SELECT f.repo, f.path, array_to_string({PY_NAMES}, ',') AS names, coalesce(c, 0) AS complexity, (SELECT count(*) FROM relative r WHERE r.repo = f.repo AND r.path = f.path) AS n_relative
        FROM fams f LEFT JOIN branches USING (repo, path) WHERE fam = 'python'""",
    "public_api": f"{LINED}, named AS (SELECT repo, path, CASE fam {_API} END AS names FROM fams WHERE fam IS NOT NULL) SELECT repo, path, CAST(len(names) AS BIGINT) AS n, array_to_string(names, ',') AS names FROM named",
    "relative_imports": f"{LINED}, {RELATIVE} SELECT DISTINCT repo, path, name, level FROM relative",
    # in this corpus only Ruby files have documentation: the first run of marked lines among their first twenty
    "docstrings": rf"""{LINED}, top AS (SELECT repo, path, fam, content, list_filter(ls[1:20], lambda x: NOT (starts_with(trim(x), '#') AND regexp_matches(x, 'frozen_string_literal|encoding:|coding:'))) AS t FROM fams WHERE fam IS NOT NULL),
        marked AS (SELECT *, list_transform(t, lambda x: starts_with(trim(x), '#')) AS m FROM top), begun AS (SELECT *, coalesce(list_position(m, true), 0) AS i FROM marked),
        ended AS (SELECT *, coalesce(list_position(m[i:], false), 0) AS n FROM begun)
        SELECT repo, path, CASE WHEN fam = 'ruby' AND i > 0 THEN regexp_replace(array_to_string((t[i:])[1:CASE WHEN n > 0 THEN n - 1 ELSE 20 END], chr(10)), '^\s+|\s+$', '', 'g')
          WHEN fam = 'go' THEN rtrim(regexp_extract(content, '^((?://[^\n]*\n)+)package ', 1), chr(10)) ELSE '' END AS docstring FROM ended""",
    "sanitize_pages": f"SELECT page_id, CAST(length(c) AS BIGINT) AS n_chars, sha256(c) AS clean_sha256 FROM (SELECT page_id, {_CLEAN} AS c FROM pages)",
    "import_edges": f"{EDGES} SELECT repo, src, dst FROM edges",
    "fan_in": f"{EDGES} SELECT py.repo, py.path, count(src) AS fan_in FROM py LEFT JOIN edges ON py.repo = edges.repo AND py.path = edges.dst GROUP BY 1, 2",
    "import_cycles": f"""{EDGES}, reach AS (SELECT repo, src AS a, dst AS b FROM edges UNION SELECT reach.repo, a, dst FROM reach JOIN edges ON reach.repo = edges.repo AND reach.b = edges.src)
        SELECT x.repo, x.a AS path, least(x.a, min(x.b)) AS scc_id FROM reach x JOIN reach y ON x.repo = y.repo AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.repo, x.a""",
    "sibling_resolution": rf"""{LINED}, {RELATIVE}, wanted AS (SELECT *, {PARENT} AS folder FROM relative),
        choice AS (SELECT *, unnest(CASE WHEN ends_with(path, '.py') THEN ['.py', '/__init__.py'] ELSE ['.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx'] END) AS tail,
            unnest(generate_series(1, CASE WHEN ends_with(path, '.py') THEN 2 ELSE 8 END)) AS rank FROM wanted),
        hit AS (SELECT c.repo, c.path, name, pos, min_by(src.path, rank) AS target FROM choice c LEFT JOIN src ON src.repo = c.repo AND src.path = CASE WHEN folder = '' THEN '' ELSE folder || '/' END || name || tail GROUP BY c.repo, c.path, name, pos)
        SELECT repo, path, coalesce(string_agg(target, ',' ORDER BY pos), '') AS sibling_paths, coalesce(string_agg(CASE WHEN target IS NULL THEN name END, ',' ORDER BY pos), '') AS missing FROM hit GROUP BY repo, path""",
    "has_test": rf"""{SRC_CTE}, f AS (SELECT repo, path, {STEM} AS s, {PARENT} AS home, regexp_extract({NAME}, '.(\.[^.]+)$', 1) AS e FROM src),
        bare AS (SELECT *, unnest(['test_' || s || e, s || '_test' || e, s || 'Test' || e, s || '.test' || e, s || '.spec' || e]) AS n FROM f),
        named AS (SELECT repo, path, home, n FROM bare UNION ALL SELECT repo, path, home, s || e FROM f),
        dirs AS (SELECT DISTINCT repo, home, unnest(list_transform(generate_series(0, len(string_split(home, '/'))), lambda i: array_to_string(string_split(home, '/')[1:i], '/'))) AS d FROM f),
        tried AS (SELECT repo, path, home || '/' || n AS t FROM bare WHERE home <> '' UNION SELECT named.repo, path, CASE WHEN d = '' THEN '' ELSE d || '/' END || unnest(['tests', 'test', '__tests__', 'test_utils']) || '/' || n FROM named JOIN dirs USING (repo, home))
        SELECT DISTINCT tried.repo, tried.path FROM tried JOIN src ON tried.repo = src.repo AND tried.t = src.path""",
    "fix_relative_imports": rf"""{LINED}, done AS (SELECT repo, path, ext, content, string_agg(CASE
        WHEN ext = '.py' AND regexp_matches(line, '^\s*from\s+\.+') THEN '# TODO: ' || regexp_replace(line, '^\s+|\s+$', '', 'g') || ' — relative import, provide this module or install it'
        WHEN ext IN ('.ts', '.tsx', '.js', '.jsx') AND regexp_matches(line, '(?:from|require\()\s*[''"]\.{{1,2}}/') THEN '// TODO: ' || regexp_replace(line, '^\s+|\s+$', '', 'g') || ' — relative import, provide this module or install it'
        WHEN ext = '.rs' AND regexp_matches(line, '^\s*use\s+(super|crate|self)::') THEN '// TODO: ' || regexp_replace(line, '^\s+|\s+$', '', 'g') || ' — relative import, provide this module or install it' ELSE line END, chr(10) ORDER BY i) AS fixed
        FROM (SELECT *, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) AS i FROM src) GROUP BY repo, path, ext, content) SELECT repo, path, sha256(fixed) AS fixed_sha256 FROM done""",
    "score_grid": GRID,
    "similar_top5": f"{TOP} SELECT path, rank, full_name, stars FROM top",
    "demand_signal": f"""{TOP}, each AS (SELECT *, CASE WHEN stars > 0 THEN least(10.0, stars / 100) ELSE 0 END + CASE WHEN forks > 0 THEN least(5.0, forks / 50) ELSE 0 END + CASE WHEN issues > 0 THEN least(3.0, issues / 10) ELSE 0 END
        + CASE WHEN stars > 0 AND forks > 0 THEN CASE WHEN stars / forks > 50 THEN 0 WHEN stars / forks < 5 THEN 1.5 ELSE 0.5 END ELSE 0 END AS score, {_MONTHS} AS months FROM top)
        SELECT path, round(least(10.0, sum(score / rank) / sum(1 / rank) / 1.8), 6) AS demand, first(months ORDER BY rank) AS months, count(*) FILTER (months > 12) AS stale FROM each GROUP BY path""",
    "repo_arg_parse": r"""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 19 = 4 THEN '' ELSE replace(
          ['{}', 'https://github.com/{}', 'https://www.github.com/{}.git', 'git@github.com:{}.git', 'http://github.com/{}/', 'http://example.org/{}', 'git@example.org:{}.git', '{}/more', '{}.git', ' {} '][c_custkey % 10 + 1],
          '{}', CASE WHEN c_custkey % 17 = 3 THEN '' ELSE regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') END || '/n' || c_nationkey) END AS arg FROM customer),
        t AS (SELECT *, CASE WHEN starts_with(trim(arg), 'git@') THEN replace(regexp_extract(trim(arg), '[^:]*$'), '.git', '')
          WHEN starts_with(trim(arg), 'http') THEN regexp_replace(trim(regexp_extract(trim(arg), '^[^:]+://[^/]*(.*)$', 1), '/'), '\.git$', '') ELSE regexp_replace(trim(arg), '\.git$', '') END AS tail FROM a),
        f AS (SELECT *, regexp_matches(tail, '^[^/]+/[^/]+$') AND (NOT starts_with(trim(arg), 'git@') OR contains(arg, 'github.com'))
          AND (NOT starts_with(trim(arg), 'http') OR regexp_extract(trim(arg), '^[^:]+://([^/]*)', 1) IN ('github.com', 'www.github.com')) AS fits FROM t)
        SELECT c_custkey, arg, CASE WHEN fits THEN split_part(tail, '/', 1) END AS owner, CASE WHEN fits THEN split_part(tail, '/', 2) END AS name, fits FROM f""",
    "scope_check": r"""WITH a AS (SELECT event_id, CAST(user_id AS VARCHAR) AS login, event_id % 29 = 0 AS silent, CASE WHEN event_id % 5 = 1 THEN 401 WHEN event_id % 5 = 2 THEN 403 WHEN event_id % 35 = 3 THEN 500 ELSE 200 END AS status,
          ['', 'read:org', ' repo', 'write:packages', 'admin:org', 'delete_repo', 'public_repo', 'user:email', 'delete:packages', 'gist'] AS s FROM events),
        h AS (SELECT *, CASE event_id % 3 WHEN 0 THEN s[event_id % 10 + 1] || ',' || s[event_id // 10 % 10 + 1] WHEN 1 THEN s[event_id // 100 % 10 + 1] END AS header FROM a),
        o AS (SELECT *, list_filter(list_transform(string_split(coalesce(header, ''), ','), lambda x: trim(x)), lambda x: x IN ('repo', 'repo:status', 'repo_deployment', 'public_repo', 'delete_repo') OR regexp_matches(x, '^(admin|write|delete):')) AS bad FROM h),
        e AS (SELECT *, CASE WHEN silent THEN 'network error: timed out' WHEN status = 401 THEN 'token is invalid or expired' WHEN status = 403 THEN 'token may not read the user' WHEN status <> 200 THEN 'unexpected status: ' || status
          WHEN len(bad) > 0 THEN 'token may write: ' || array_to_string(bad, ', ') END AS error FROM o)
        SELECT event_id, array_to_string(bad, ',') AS offending, error IS NULL AS ok, CASE WHEN error IS NULL THEN login END AS user_name, error,
          CASE WHEN error IS NULL AND coalesce(header, '') = '' THEN 'fine-grained token: its scopes cannot be verified' END AS warning, status = 200 AND NOT silent AND coalesce(header, '') <> '' AS is_classic FROM e""",
    "license_lines": f"SELECT doc_id, len(list_filter(({LINES.replace('content', 'text')})[1:30], lambda x: regexp_matches(lower(x), 'copyright|licensed under|apache license|mit license|permission is hereby granted'))) AS n_legal, len({LINES.replace('content', 'text')}) AS n_lines FROM documents",
    "path_parts": f"{SRC_CTE} SELECT repo, path, {STEM} AS stem, {PARENT} AS parent FROM src",
}
SQL["chunked_loc"] = SQL["logical_loc"]
