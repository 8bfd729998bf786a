"""Fixed results of the queries over the repositories of ``fixture``, once for each group of documents or for each document.

``golden.json`` holds the columns, their types and the rows of each query. The rows were recorded
once and then read against the rules: reasons, gates, names, imports, complexities, siblings and
scores were followed by hand. They stand for themselves: nothing makes them anew when the
operators change, so a change of behaviour shows as a difference.
"""

from __future__ import annotations

import json
from pathlib import Path

from stratalode.plans import fixture

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).upper() if isinstance(value, bool) else repr(value)


def _select(columns: list[list[str]], rows: list[list[object]]) -> str:
    names = ", ".join(f"c{i}" for i in range(len(columns)))
    cast = ", ".join(f"CAST(c{i} AS {TYPES[kind]}) AS {name}" for i, (name, kind) in enumerate(columns))
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({names})"


def results() -> dict[str, dict]:
    return json.loads(Path(__file__).with_name("golden.json").read_text(encoding="utf-8"))


def _sql(name: str, columns: list[list[str]], rows: list[list[object]]) -> str:
    if (few := {"fixture_clean_text": fixture.TEXTS, "fixture_license_headers": fixture.HEADERS, "fixture_token_checks": fixture.ANSWERS, "fixture_responses": fixture.RESPONSES}.get(name)) is not None:
        return f"SELECT doc_id, t.* FROM documents JOIN ({_select(columns, rows)}) t ON doc_id % {len(few)} = no"
    if name == "fixture_names":
        number = " ".join(f"WHEN {_literal(r[0])} THEN {i}" for i, r in enumerate(fixture.NAMES))
        return f"WITH t AS (SELECT CAST(CASE path {number} END AS BIGINT) AS no, * FROM ({_select(columns, rows)})) SELECT doc_id, t.* FROM documents JOIN t ON doc_id % {len(fixture.NAMES)} = no"
    n = len(fixture.FILES)
    groups = f"WITH groups AS (SELECT doc_id // {n} AS g FROM documents WHERE doc_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id % {n}) = {n})"
    own = "t.* REPLACE (repo || '-' || g AS repo)" if ["repo", "string"] in columns else "t.*"
    return f"{groups} SELECT {own} FROM groups, ({_select(columns, rows)}) t"


SQL = {name: _sql(name, x["columns"], x["rows"]) for name, x in results().items()}
