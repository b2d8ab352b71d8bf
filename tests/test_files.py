"""Files as a corpus, and the command line."""

from coppice import __main__ as cli
from coppice.sources.files import corpus, pairs, write


def test_corpus_globs_and_sinks(spark, tmp_path):
    for name, text in {"a.html": "<p>1</p>", "sub/b c.html": "<p>2</p>\n<p>3</p>", "sub/deep/d.ex": "x = 1", "test/e.html": ""}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    rows = corpus(spark, str(tmp_path / "in"), ["**/*.html"], ["test/**"]).collect()
    assert {r.path: r.source for r in rows} == {"a.html": "<p>1</p>", "sub/b c.html": "<p>2</p>\n<p>3</p>"}
    assert {r.path for r in corpus(spark, str(tmp_path / "in"), ["sub/**/*.{ex,exs}"]).collect()} == {"sub/deep/d.ex"}
    write(pairs(spark, [("a", "x"), ("b", None)]), str(tmp_path / "out"), by=["path"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_command_line(spark, tmp_path, capsys):
    box = "<div><ul><li>a</li><li>b</li><li>c</li></ul><p>t</p></div>"
    for k in range(2):
        (tmp_path / f"{k}.html").write_text(f"<main>\n{box}</main>")
    assert cli.main(["clones", str(tmp_path), "--min-mass", "4"]) == 0
    assert ".html" in capsys.readouterr().out
    assert cli.main(["rules"]) == 0 and "AliasOrder\t100\ton" in capsys.readouterr().out


def test_command_line_refactors(spark, tmp_path, capsys):
    (tmp_path / "a.ex").write_text("Enum.into(xs, %{})\n")
    (tmp_path / "b.ex").write_text("alias B\nalias A\n")
    (tmp_path / "c.txt").write_text("Enum.into(xs, %{})\n")
    run = lambda *a: (cli.main(["refactor", str(tmp_path), "--include", "*.ex", *a]), capsys.readouterr().out)
    assert run("--only", "NoSuchRule")[0] == 2
    code, out = run("--check")
    assert code == 1 and "would change\ta.ex\tEnumIntoToMapNew" in out and (tmp_path / "a.ex").read_text() == "Enum.into(xs, %{})\n"
    code, out = run("--exclude", "AliasOrder")
    assert code == 0 and (tmp_path / "a.ex").read_text() == "Map.new(xs)\n" and (tmp_path / "b.ex").read_text() == "alias B\nalias A\n"
    assert run("--dry-run", "--only", "AliasOrder") == (0, "would change\tb.ex\tAliasOrder\n1 files would change\n")
    run()
    assert (tmp_path / "b.ex").read_text() == "alias A\nalias B\n" and (tmp_path / "c.txt").read_text() == "Enum.into(xs, %{})\n" and run("--check")[0] == 0


def test_command_line_detects(spark, tmp_path, capsys):
    (tmp_path / "a.ex").write_text("  defp is_ok(x), do: x\nx = 1\n")
    assert cli.main(["refactor", str(tmp_path), "--detect", "--only", "BooleanFunctionQuestionMark", "--only", "SortKeywords"]) == 0
    out = capsys.readouterr().out
    assert "left out: SortKeywords needs lists" in out and "BooleanFunctionQuestionMark\ta.ex:1" in out
