"""Folders read by tasks, packages written all or none, contents looked at once."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratalode.functions import languages as L
from stratalode.functions.text import lines, strip
from stratalode.operators import candidates, chunks, extract, scan
from stratalode.sources import files
from stratalode.sources.files import FilteringReader, SourceTree, SourceTreeReader, from_directory, from_table

BODY = "".join(f"    x{i} = {i}\n" for i in range(15))


def tree(root):
    made = {"a.py": "x", "__init__.py": "", "_app.tsx": "y", "p/q/deep.py": "z", "p/.env.example": "A=1", "p/.hidden.py": "n", "p/logo.PNG": "n", "p/x_generated.ts": "n", "node_modules/d/i.js": "n",
            "p/Vendor/i.js": "n", "p/b.rs": "r\r\ns", "p/bad.js": b"a\xffb", "p/q/r/s/t/u.go": "g", "docs/LICENSE": "MIT"}
    for path, text in made.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())
    (root / "link.py").symlink_to(root / "a.py")
    (root / "loop").symlink_to(root / "p")
    (root / "gone.py").symlink_to(root / "nothing")
    return {"a.py": "x", "__init__.py": "", "_app.tsx": "y", "p/q/deep.py": "z", "p/.env.example": "A=1", "p/b.rs": "r\ns", "p/bad.js": "ab", "p/q/r/s/t/u.go": "g", "docs/LICENSE": "MIT"}


@pytest.mark.parametrize("folders", [1, 3, 256])
def test_every_folder_is_read_once(spark, tmp_path, folders, monkeypatch):
    expected = tree(tmp_path)
    monkeypatch.setattr(files, "FOLDERS", folders)
    reader = SourceTreeReader(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) <= max(folders + 2, 3) and all(os.path.isdir(tmp_path / p.path) for p in parts)
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == len(expected) and {r["path"]: r["content"] for r in got} == expected


def test_source_tree(spark, tmp_path):
    expected = tree(tmp_path)
    spark.dataSource.register(SourceTree)
    table = spark.read.format("source_tree").load(str(tmp_path))
    assert {r["path"]: (r["ext"], r["content"]) for r in table.collect()} == {p: (os.path.splitext(p)[1], c) for p, c in expected.items()}
    assert {r["path"] for r in from_directory(spark, str(tmp_path), "o/r").collect()} == set(expected)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    table = spark.read.format("source_tree").option("pushdown", "true").load(str(tmp_path))
    try:
        for some, paths in ((table.filter("ext = '.go'"), {"p/q/r/s/t/u.go"}), (table.filter("ext IN ('.py', '.rs') AND path LIKE 'p/%'"), {"p/q/deep.py", "p/b.rs"}), (table.filter("ext = '.py' AND length(content) > 0"), {"a.py", "p/q/deep.py"})):
            assert {r["path"] for r in some.collect()} == paths
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (tmp_path / "empty").mkdir()
    assert spark.read.format("source_tree").load(str(tmp_path / "empty")).count() == 0


def test_pushed_filters_choose_what_is_read(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    tree(tmp_path)
    reader = FilteringReader(str(tmp_path))
    other = GreaterThan(("size",), 3)
    assert [*reader.pushFilters([EqualTo(("ext",), ".py"), other, StringStartsWith(("path",), "p/")])] == [other]
    assert [r["path"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == ["p/q/deep.py"]


def test_packages_all_or_none(spark, tmp_path):
    rows = [(f"p{i}", "a/b.py", f"x{i}") for i in range(6)]
    shape = "package string, rel_path string, content string"
    folder = f"file://{tmp_path}/out"
    (tmp_path / "out").mkdir()
    wrong = spark.createDataFrame([*rows, ("p9", "../../x", "y")], shape).repartition(4)
    with pytest.raises(PySparkException, match="would leave the folder"):
        extract.write_packages(wrong, folder)
    assert os.listdir(tmp_path / "out") == []
    for text in ("x", "z"):  # once more over what is there
        told = extract.write_packages(spark.createDataFrame([(p, f, text) for p, f, _ in rows], shape).repartition(3), folder)
        assert sorted(map(tuple, told.collect())) == [(p, f, 1) for p, f, _ in rows]
        assert sorted(os.listdir(tmp_path / "out")) == [f"p{i}" for i in range(6)] and (tmp_path / "out/p3/a/b.py").read_text() == text


def test_each_content_is_looked_at_once(spark):
    """Every file in fifty repositories: facts are one for each content, candidates those of each repository alone."""
    one = [("src/slug.py", f'"""Slugs."""\nimport re\ndef slugify(a):\n{BODY}'), ("src/user.py", f"from .slug import slugify\ndef use(a):\n{BODY}"), ("lib/x.js", "export function y(a) {\n" + "  z();\n" * 15 + "}\n"),
           ("copy/slug.py", f'"""Slugs."""\nimport re\ndef slugify(a):\n{BODY}'), ("src/settings.py", f"def s(a):\n{BODY}"), ("LICENSE", "MIT"), ("src/__init__.py", ""), ("tests/test_slug.py", "import slug\n")]
    shape = "repo string, path string, content string"
    alone = candidates.detect(from_table(spark.createDataFrame([("r0", p, c) for p, c in one], shape)))
    many = from_table(spark.createDataFrame([(f"r{i}", p, c) for i in range(50) for p, c in one], shape))
    keys = candidates.file_keys(many)
    contents = candidates.distinct_contents(many, keys)
    assert contents.count() == 6 and keys.count() == 400  # five contents of candidates or tests, and the empty one
    text = lambda df: {(r[0], r[1]): r[2:] for r in df.select("repo", "path", *(F.col(c).cast("string") for c in df.columns if c not in ("repo", "path"))).collect()}
    expected, got = text(alone), text(candidates.detect(many))
    assert len(expected) == 5 and len(got) == 250
    assert all(got[f"r{i}", path] == row for i in range(50) for (_, path), row in expected.items())


def test_scan_filter_agrees_with_the_reader(spark, tmp_path):
    """What the reader leaves out is what the columns' rule leaves out."""
    tree(tmp_path)
    paths = [os.path.relpath(os.path.join(d, n), tmp_path) for d, _, names in os.walk(tmp_path) for n in names if not os.path.islink(os.path.join(d, n))]
    kept = from_table(spark.createDataFrame([("r", p, "x") for p in paths], "repo string, path string, content string")).filter(scan.kept_path(F.col("path"), F.col("ext")))
    reader = SourceTreeReader(str(tmp_path))
    assert {r["path"] for r in kept.collect()} == {r["path"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()}


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_a_file_in_chunks_has_the_same_lines_of_code(spark, tmp_path, size):
    """Blocks that go on over chunks, lines longer than a chunk, an empty file."""
    texts = {"a.c": "int a; /* one\n\n two\n*/ int b;\n// x\n#define A\n" * 9, "b.js": "/* open\n" + "x();\n" * 30, "c.py": "#\n# comment\nx = 1\n\n" * 5 + "y = '" + "z" * 300 + "'", "d.go": "", "e.rs": "fn a() {}\n*/\n/*/\nfn b() {}\n"}
    for path, text in texts.items():
        (tmp_path / path).write_text(text)
    spark.dataSource.register(SourceTree)
    rows = spark.read.format("source_tree").option("chunk_bytes", size).load(str(tmp_path)).withColumn("repo", F.lit("r"))
    whole = from_table(spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo string, path string, content string"))
    fam, ls = L.family(F.col("ext")), F.transform(lines(F.col("content")), strip)
    expected = {r["path"]: r["loc"] for r in whole.select("path", L.logical_loc(fam, ls).alias("loc")).collect()}
    assert {r["path"]: r["loc"] for r in chunks.logical_loc(rows).collect()} == expected
    assert {r["path"]: r["loc"] for r in chunks.logical_loc(chunks.cut(whole, 3)).collect()} == expected
    longest = {p: max(map(len, t.split("\n"))) + 1 for p, t in texts.items()}
    assert all(r["size"] <= size + longest[r["path"]] for r in rows.collect()) and rows.groupBy("path").agg(F.sum("size")).count() == 5
