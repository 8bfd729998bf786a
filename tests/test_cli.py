"""The command line over a small folder."""

from __future__ import annotations

from stratalode import cli
from tests.test_engine import SLUGIFY


def test_report_and_packages(spark, tmp_path, capsys):
    (tmp_path / "in/src").mkdir(parents=True)
    (tmp_path / "in/src/slugify.py").write_text(SLUGIFY)
    (tmp_path / "in/LICENSE").write_text("MIT")
    projects = spark.createDataFrame([("o/slugs", "u", 4000, "d", "2026-01-01", "MIT", 30, 9, "Python", ["slugify"])], "full_name string, html_url string, stars long, description string, pushed_at string, license string, open_issues long, forks long, language string, tokens array<string>")
    projects.write.parquet(str(tmp_path / "projects"))
    out = tmp_path / "r.md"
    asked = [str(tmp_path / "in"), "--repo", "o/r", "--output", str(out)]
    assert cli.main([*asked, "--extract", str(tmp_path / "out"), "--verbose", "--projects", str(tmp_path / "projects")]) == 0
    text = out.read_text()
    assert "`slugify.py`" in text and "`o/slugs`" in text and "need clear advantage" in text and (tmp_path / "out/slugify/slugify/slugify.py").read_text().startswith('"""Turn text')
    assert "1 candidates, 0 skipped" in capsys.readouterr().out
    assert cli.main([*asked, "--projects", str(tmp_path / "projects"), "--no-network"]) == 0 and "o/slugs" not in out.read_text()
    assert cli.main([*asked, "--language", "Go"]) == cli.REPO and cli.main([str(tmp_path / "none"), "--repo", "o/r"]) == cli.REPO


def test_exit_codes(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "in").mkdir()
    folder = str(tmp_path / "in")
    assert cli.main([folder, "--repo", "o/r"]) == cli.REPO  # empty
    (tmp_path / "in/a.py").write_text(SLUGIFY)
    assert cli.main([]) == 2 and cli.main([folder, "--repo", "o/r", "--language", "Cobol"]) == 2 and cli.main(["--version"]) == 0
    for wrong in (["--repo", "bad"], ["--repo", "o/r", "--min-score", "11"], ["--repo", "o/r", "--max-candidates", "0"], ["--repo", "o/r", "--max-extract", "0"], ["--repo", "o/r", "--output", folder], ["--repo", "o/r", "--output", f"{folder}/none/r.md"], ["--repo", "o/r", "--extract", f"{folder}/a.py"]):
        assert cli.main([folder, *wrong]) == cli.BAD_INPUT, wrong
    assert cli.main([folder, "--repo", "o/r", "--scopes", "read:org, write:packages"]) == cli.AUTH
    for error, code in ((KeyboardInterrupt(), cli.INTERRUPTED), (ValueError("odd"), cli.ERROR)):
        def fail(a, error=error):
            raise error

        monkeypatch.setattr(cli, "run", fail)
        assert cli.main([folder, "--repo", "o/r"]) == code
    assert "Error: odd" in capsys.readouterr().err
    monkeypatch.setenv("MY_TOKEN", "od")
    assert cli.main([folder, "--repo", "o/r", "--token-variable", "MY_TOKEN", "--debug"]) == cli.ERROR
    said = capsys.readouterr().err
    assert "Error: ***d" in said and "odd" not in said and "Traceback" in said


def test_public_names():
    import stratalode

    assert all(getattr(stratalode, name) is not None for name in stratalode.__all__)
