import pytest
from pyspark.sql import functions as F

from claimlens.operators import inventory, links, recipes, report
from claimlens.sources import files


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_links(spark):
    assert one(spark, " arXiv:1609.02907v4 ", links.arxiv_id) == "1609.02907"
    assert one(spark, "https://arxiv.org/pdf/2011.14439v2.pdf", links.arxiv_id) == "2011.14439"
    assert one(spark, "tkipf/gcn", links.arxiv_id) is None
    text = "at github.com/a/b.git, (https://github.com/C/d_e) and github.com/topics/x, github.com/a/b."
    assert [x["repo"] for x in one(spark, text, links.repo_links)] == ["a/b", "C/d_e", "a/b"]
    keys = {"https://github.com/A/b.git": "a/b", "A/B/": "a/b", "git@github.com:a/b": "a/b", "https://github.com/a/b/tree/main": "a/b", "no repo": None, "https://x.org/a/b": None}
    assert {k: one(spark, k, links.repo_key) for k in keys} == keys


def test_ranking(spark):
    rows = [("p", "a/b", "paper page 1 (link)", "code", 0), ("p", "A/B", "paper page 5 (text)", "", 1), ("p", "c/d", "arXiv comments", "", 2), ("p", "pytorch/pytorch", "arXiv comments", "code", 3)]
    df = spark.createDataFrame(rows, "paper string, repo string, where string, text string, ord int")
    got = [(r["repo"], r["score"], r["mentions"]) for r in links.rank(df, ["paper"]).orderBy("rank").collect()]
    assert got == [("c/d", 101, 1), ("a/b", 30, 2)]


def test_inventory(spark):
    fs = [
        ("r", "README.md", 60, "# x\nUse Python 3.7.\n```\n$ pip install torch\npython main.py\n```\nneeds a GPU, data: https://x.org/a.zip."),
        ("r", "main.py", 50, "import x\nx.cuda()\nif __name__ == '__main__':\n  p.add_argument('--lr')"),
        ("r", "environment.yml", 40, "dependencies:\n  - python=3.8\n  - numpy=1.2"),
        ("r", "nb/a.ipynb", 900, "{}"),
    ]
    df = spark.createDataFrame(fs, "repo string, path string, size int, text string")
    lang = {r["language"]: (r["rank"], r["is_primary"]) for r in inventory.language_bytes(df).collect()}
    assert lang == {"Jupyter Notebook": (1, False), "Python": (2, True)}
    lines = inventory.file_lines(df)
    readme = inventory.file_lines(inventory.readmes(df))
    parsed = inventory.parse_requirements(inventory.dependency_files(df))
    assert inventory.suggest_python(inventory.python_hints(parsed, readme)).first()["version"] == "3.8"
    cmds = inventory.readme_commands(readme)
    assert [r["command"] for r in cmds.orderBy("ord").collect()] == ["pip install torch", "python main.py"]
    assert inventory.install_hints(cmds).first()["packages"] == ["torch"]
    entry = inventory.entry_points(df).first()
    assert (entry["path"], entry["why"], entry["flags"]) == ("main.py", ["name", "__main__ guard", "mentioned in README"], ["--lr"])
    assert [r["url"] for r in inventory.downloads(lines).collect()] == ["https://x.org/a.zip"]
    gpu = inventory.gpu_use(lines, readme, parsed).first()
    assert (gpu["code_lines"], gpu["checks"], gpu["readme_lines"]) == (1, 0, 1)
    assert inventory.gpu_only(lines).first()["line"] == 2


@pytest.mark.parametrize(
    "spec, pip",
    [("python=3.8", None), ("pytorch::pytorch=1.10", "torch==1.10.*"), ("numpy==1.21.2", "numpy==1.21.2"), ("numpy=1.21.2=py38", "numpy==1.21.2"), ("cudatoolkit", None), ("libpng", None), ("scipy", "scipy"), ("x >= 2", "x>=2"), ("??", None)],
)
def test_conda(spark, spec, pip):
    assert one(spark, spec, inventory.conda_to_pip) == pip


def test_environment_texts(spark):
    got = [one(spark, x, inventory.unpin) for x in ("torch==1.2", "a[b]>=1; python_version<'3'", "# c", "-r x.txt", "git+https://x", "")]
    assert got == ["torch", "a", "# c", "-r x.txt", "git+https://x", ""]
    assert one(spark, "A==1\nb==2\n-e x\nA==3", inventory.freeze) == {"a": "3", "b": "2"}
    assert one(spark, "noise\n × ValueError: no\nmore", inventory.error_gist) == "ValueError: no more"
    assert one(spark, "", inventory.error_gist) is None
    cmds = spark.createDataFrame([("r", "python -c 'x'", False), ("r", "python a.py", False), ("r", "python b.py", False), ("r", "x", True)], "repo string, command string, authored boolean")
    touched = spark.createDataFrame([("r", "src/a.py", True)], "repo string, path string, untracked boolean")
    got = {r["command"]: r["origin"] for r in inventory.command_origin(cmds, touched).collect()}
    assert got == {"python -c 'x'": "authored", "python a.py": "authored", "python b.py": "repo", "x": "authored"}


def test_run_overlap(spark):
    rows = [("k", i, f"2025-01-0{d} {a}", f"2025-01-0{e} {b}") for i, d, a, e, b in [(1, 1, "23:00:00", 2, "01:00:00"), (2, 2, "00:30:00", 2, "02:00:00"), (3, 2, "02:00:00", 2, "03:00:00"), (4, 1, "00:00:00", 5, "00:00:00")]]
    df = spark.createDataFrame(rows, "k string, id int, s string, e string").select("k", "id", F.col("s").cast("timestamp").alias("started"), F.col("e").cast("timestamp").alias("ended"))
    assert sorted((r["run"], r["other"]) for r in inventory.run_overlap(df, "k").collect()) == [(1, 2), (1, 4), (2, 4), (3, 4)]


RECIPE = {"slug": "a-b", "title": "t", "area": "x", "repo": "o/n", "command": "python t.py", "metric": {"name": "acc"}, "claim": {"source": "readme", "value": 1.0}}


@pytest.mark.parametrize(
    "change, words",
    [({"slug": "A B"}, "slug"), ({"commit": "abc"}, "commit"), ({"arxiv": "x"}, "arxiv"), ({"python": "2.7"}, "python"), ({"env": {"extra": "x"}}, "env.extra"), ({"seeds": []}, "seeds"), ({"seeds": [1, 2]}, "{seed}"), ({"metric": {}}, "metric.name"), ({"metric": {"name": "a", "select": "x"}}, "metric.select"), ({"claim": {"source": "readme"}}, "value"), ({"claim": {"source": "paper", "value": 1}}, "arXiv"), ({"tolerance": {"abs": 1}}, "why"), ({"vetted": {"verdict": "x"}}, "verdict"), ({"timeout": "1"}, "timeout")],
)
def test_recipe_rules(change, words):
    assert recipes.problems_of(RECIPE) == []
    assert any(words in p for p in recipes.problems_of(RECIPE | change))


def test_recipe_file(spark):
    import yaml

    assert files.read_recipes(spark, yaml.safe_dump([RECIPE])).count() == 1
    with pytest.raises(ValueError, match="commit"):
        files.read_recipes(spark, yaml.safe_dump([RECIPE, RECIPE | {"commit": "x"}]))


def test_sources(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    for name, text in {"a.log": "loss: 1.5", "b.json": '{"acc": 2}', "c.tsv": "id\tf1\nx\t3", ".git/d.log": "loss: 9"}.items():
        (tmp_path / name).write_text(text)
    got = sorted((r["name"], r["value"]) for r in files.metric_values(files.read_files(spark, str(tmp_path))).collect())
    assert got == [("accuracy", 2.0), ("f1", 3.0), ("loss", 1.5)]
    raw = spark.createDataFrame([("d", 1, 6.0, 8.0, [["0", "1", "2", "3", "9", "w"]], [[1.0, 2.0, 3.0]], [[4.0, 0.0, 5.0]])], "doc string, page int, width double, height double, words array<array<string>>, rules array<array<double>>, hrules array<array<double>>")
    row = files.shape_pages(raw).first()
    assert (row["words"][0]["text"], row["words"][0]["bottom"], row["hrules"][0]["y"]) == ("w", 3.0, 4.0)
    page = spark.createDataFrame([("59 .5±0.1 ﬁne",)], "text string")
    assert files.glue_numbers(page).first()[0] == "59.5 ± 0.1 fine"
    runs = spark.createDataFrame([("r1", ["o", "e"])], "run string, outputs array<string>")
    fs = spark.createDataFrame([("e", 1, "err"), ("o", 1, "out"), ("x", 1, "no")], "path string, size int, text string")
    assert [r["text"] for r in files.run_outputs(runs, fs).orderBy("ord").collect()] == ["out", "err"]


def test_badge(spark):
    df = spark.createDataFrame([(1,)], "x int").select(report.badge_url(F.lit("a-b"), F.lit("NOT REPRODUCED"), F.lit("1.5%"), F.lit("2_0"), F.lit("not_reproduced")))
    assert df.first()[0] == "https://img.shields.io/badge/a--b-NOT%20REPRODUCED%201.5%25%20vs%202__0-b42318"
