"""Links, snapshots, inventories and environments over the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import inventory, links, recipes
from ..sources import files, tree
from ..sources.shared import fresh
from .registry import query, table


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('1609.', lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0')) WHEN 1 THEN concat('2011.', lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0'))
  WHEN 2 THEN concat('1609.', lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0')) END AS arxiv FROM events
""")
def arxiv_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    five, four = F.lpad((F.col("event_id") % 100000).cast("string"), 5, "0"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")
    target = F.when(k == 0, F.concat(F.lit(" arXiv:1609."), five, F.lit("v2"))).when(k == 1, F.concat(F.lit("https://arxiv.org/pdf/2011."), four, F.lit("v1.pdf"))).when(k == 2, F.concat(F.lit("1609."), five)).otherwise(F.lit("owner/name"))
    return e.select("event_id", links.arxiv_id(target).alias("arxiv"))


@query("""
SELECT c_custkey, arxiv, line FROM customer, LATERAL (SELECT unnest(['1609.02907', concat('2011.1', lpad(CAST(c_nationkey AS VARCHAR), 4, '0'))]) AS arxiv, unnest([1, 3])::BIGINT AS line)
""")
def arxiv_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("See arXiv:1609.02907v4\nnothing\nand https://arxiv.org/abs/2011.1"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"), F.lit(" beside arxiv.org/pdf/1609.02907"))
    out = links.arxiv_mentions(c.select("c_custkey", text.alias("text")), "text", ["c_custkey"])
    return out.select("c_custkey", "arxiv", F.col("line").cast("long").alias("line"))


@query("""
WITH l AS (SELECT page_id, concat('site', split_part(url, '/', 3), '/', page_id % 5) AS repo, CAST(page_id % 12 AS BIGINT) AS page, page_id % 2 = 0 AS code, page_id % 9 = 0 AS listed FROM pages),
s AS (SELECT lower(repo) AS k, count(*) AS mentions, max(CASE WHEN listed THEN 100 ELSE greatest(0, 20 - 2 * page) END + CASE WHEN code THEN 10 ELSE 0 END) AS best, min(page_id) AS first FROM l GROUP BY 1)
SELECT k AS repo, CAST(best + least(mentions, 10) AS BIGINT) AS score, mentions, row_number() OVER (ORDER BY best + least(mentions, 10) DESC, first) AS rank FROM s
""")
def repo_links_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    repo = F.concat(F.lit("site"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/"), F.col("page_id") % 5)
    where = F.when(F.col("page_id") % 9 == 0, F.lit("arXiv comments")).otherwise(F.concat(F.lit("paper page "), F.col("page_id") % 12, F.lit(" (text)")))
    text = F.when(F.col("page_id") % 2 == 0, "our code is here").otherwise("see")
    rows = p.select(F.lit(1).alias("paper"), repo.alias("repo"), where.alias("where"), text.alias("text"), F.col("page_id").alias("ord"))
    noise = p.select(F.lit(1).alias("paper"), F.lit("PyTorch/pytorch").alias("repo"), F.lit("arXiv abstract").alias("where"), F.lit("code").alias("text"), F.col("page_id").alias("ord"))
    out = links.rank(rows.unionByName(noise), ["paper"])
    return out.select(F.lower("repo").alias("repo"), F.col("score").cast("long").alias("score"), "mentions", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT page_id, concat('owner', page_id % 7, '/tool-', page_id) AS repo, concat('paper page ', page_id % 5 + 1, ' (text)') AS "where" FROM pages
UNION ALL SELECT page_id, concat('Other/n_', page_id % 3), concat('paper page ', page_id % 5 + 1, ' (text)') FROM pages
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    text = F.concat(F.lit("Code\nat https://github.com/owner"), F.col("page_id") % 7, F.lit("/tool-"), "page_id", F.lit(".git, not github.com/topics/x;\nalso GitHub.com/Other/n_"), F.col("page_id") % 3, F.lit(")."))
    rows = p.select("page_id", (F.col("page_id") % 5 + 1).alias("page"), text.alias("text"))
    return links.page_links(rows, ["page_id"]).select("page_id", "repo", "where")


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('a/', page_id) WHEN page_id % 3 = 1 THEN concat('b/', page_id) ELSE concat('c/', page_id) END AS repo,
  ['page', 'paper', 'search'][page_id % 3 + 1] AS method, page_id % 3 < 2 AS author_stated FROM pages
""")
def link_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 3
    repo = lambda x: F.concat(F.lit(f"{x}/"), F.col("page_id").cast("string")).alias("repo")
    ranked = p.filter(k < 2).select("page_id", F.when(k == 0, repo("a")).otherwise(repo("b")).alias("repo"), F.when(k == 0, "arXiv abstract").otherwise("paper page 1 (text)").alias("where"), F.lit(1).alias("rank"))
    return links.choose(ranked, p.select("page_id", repo("c")), "page_id")


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('own.er/n-', page_id) END AS key, concat('n-', page_id) AS slug FROM pages
""")
def repo_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    good = F.concat(F.lit("https://github.com/Own.er/N-"), F.col("page_id").cast("string"))
    bad = F.concat(F.lit("https://gitlab.com/Own.er/N-"), F.col("page_id").cast("string"))
    url = F.concat(F.when(F.col("page_id") % 2 == 0, good).otherwise(bad), F.lit(".git"))
    return p.select("page_id", links.repo_key(url).alias("key"), links.slug(url).alias("slug"))


@query("""
SELECT s_suppkey, concat('r', CASE s_suppkey % 4 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey WHEN 2 THEN s_suppkey - s_suppkey % 5 END) AS recipe FROM supplier WHERE s_suppkey % 4 < 2
UNION ALL SELECT s_suppkey, NULL FROM supplier WHERE s_suppkey % 4 >= 2
""")
def recipe_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    own, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    rs = s.select(F.concat(F.lit("r"), own).alias("slug"), F.concat(F.lit("https://github.com/o/n"), own).alias("repo"), F.lit("1609.02907").alias("arxiv"), F.col("s_suppkey").alias("ord"))
    target = F.when(k == 0, F.concat(F.lit("R"), own)).when(k == 1, F.concat(F.lit("O/N"), own)).otherwise(F.concat(F.lit("none"), own))
    found = links.find_recipe(s.select(target.alias("target")), rs)
    return s.select("s_suppkey", target.alias("target")).join(found, "target").select("s_suppkey", "recipe")


@query("""
SELECT p_partkey, list_filter([CASE WHEN p_size % 2 = 1 THEN 'slug must be lowercase letters, digits and hyphens' END,
  CASE WHEN p_size % 3 = 1 THEN 'commit must be a full SHA' END, CASE WHEN p_size % 5 = 1 THEN 'the command uses {seed} but no seeds are listed' END,
  CASE WHEN p_size % 7 = 1 THEN 'claim needs a value or a range of two numbers' END], lambda x: x IS NOT NULL) AS problems FROM part
""")
def recipe_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_size")
    slug = F.when(n % 2 == 1, "Bad Slug").otherwise("good-slug")
    commit = F.when(n % 3 == 1, "abc").otherwise(F.repeat(F.lit("a"), F.lit(40)))
    seeds = F.when(n % 5 == 1, F.lit(None).cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(2)))
    none = F.lit(None).cast("double")
    said = recipes.problems(slug, F.lit("o/n"), commit, F.lit("python t.py --seed {seed}"), seeds, F.when(n % 7 == 1, none).otherwise(F.lit(1.0)), none, none)
    return p.select("p_partkey", said.alias("problems"))


@query("SELECT lang, CAST(sum(n_chars) AS BIGINT) AS bytes, rank() OVER (ORDER BY sum(n_chars) DESC) AS rank FROM documents WHERE lang <> 'xx' GROUP BY lang")
def language_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    names = {"en": ".py", "fr": ".R", "de": ".jl", "es": ".ipynb"}
    ext = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("lang"))
    rows = d.select(F.lit("repo").alias("repo"), F.concat(F.lit("src/d"), "doc_id", ext).alias("path"), F.col("n_chars").alias("size"))
    back = F.create_map(F.lit("Python"), F.lit("en"), F.lit("R"), F.lit("fr"), F.lit("Julia"), F.lit("de"), F.lit("Jupyter Notebook"), F.lit("es"))
    return inventory.language_bytes(rows).select(back[F.col("language")].alias("lang"), F.col("bytes").cast("long").alias("bytes"), F.col("rank").cast("long").alias("rank"))


@query("""
SELECT concat('p_brand=', p_brand, '/k=', p_size % 3) AS folder, rank() OVER (ORDER BY p_brand, p_size % 3) AS n,
  CAST(sum(length(p_name) + 1) AS BIGINT) AS size, sha256(string_agg(concat(p_name, chr(10)), '' ORDER BY p_partkey)) AS sha256
FROM part GROUP BY p_brand, p_size % 3
""")
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names written to folders of two levels, one file each: walked in order and hashed in chunks."""
    root = fresh(spark, "tree")
    part = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 3).alias("k"), "p_partkey", "p_name")
    sorted_ = part.repartition("p_brand", "k").sortWithinPartitions("p_brand", "k", "p_partkey")
    sorted_.select("p_brand", "k", "p_name").write.partitionBy("p_brand", "k").text(root)
    found = tree.walk(spark, root).filter("path like '%.txt'")
    n = F.row_number().over(Window.orderBy("ord")).cast("long")  # a walk is bounded
    out = tree.with_hashes(found.select("path", "size", n.alias("n")), root)
    folder = F.replace(F.regexp_replace("path", "/[^/]*$", ""), F.lit("%23"), F.lit("#"))
    return out.select(folder.alias("folder"), "n", "size", "sha256")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_size < 10 THEN 'created' WHEN p_size > 45 THEN 'deleted' ELSE 'modified' END AS change
FROM part WHERE p_size < 10 OR p_size > 45 OR p_size % 4 = 0
""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_size").alias("size"), F.lit(1).alias("mtime"))
    before = p.filter("size >= 10")
    after = p.filter("size <= 45").withColumn("mtime", F.when(F.col("size") % 4 == 0, 2).otherwise(1))
    return files.snapshot_diff(before, after)


@query("""
SELECT k, path FROM (SELECT p_brand AS k, concat(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), CASE WHEN p_size % 3 = 0 THEN '.json' WHEN p_size % 3 = 1 THEN '.log' ELSE '.pt' END) AS path, p_size * 10000 AS size
  FROM part) WHERE (path LIKE '%.json' AND size <= 2097152) OR (path LIKE '%.log' AND size <= 262144) QUALIFY row_number() OVER (PARTITION BY k ORDER BY path) <= 20
""")
def capture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_size") % 3
    path = F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.when(n == 0, ".json").when(n == 1, ".log").otherwise(".pt"))
    return files.captured(p.select(F.col("p_brand").alias("k"), path.alias("path"), (F.col("p_size") * 10000).alias("size")), "k").select("k", "path")


@query("""
SELECT l.event_id, arg_min(w.event_id, w.event_id) AS run FROM events l LEFT JOIN events w ON w.event_type = 'purchase' AND w.user_id = l.user_id GROUP BY 1
""")
def attribute_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("path", F.col("user_id").cast("string"))
    written = e.filter("event_type = 'purchase'").select("path", F.col("event_id").alias("run"), F.col("event_id").alias("ord"))
    return files.attribute_runs(e.select("event_id", F.col("path").alias("source")), written).select("event_id", "run")


@query("""
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'pip-requirements' WHEN 1 THEN 'conda-environment' WHEN 2 THEN 'dockerfile' WHEN 3 THEN 'setup.py' END AS kind
FROM part WHERE p_size % 6 < 4
""")
def dependency_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_size") % 6
    name = F.when(n == 0, "requirements-dev.txt").when(n == 1, "env/Environment.YML").when(n == 2, "Dockerfile.gpu").when(n == 3, "a/b/setup.py").when(n == 4, "a/b/c/setup.py").otherwise("train.py")
    rows = p.select("p_partkey", F.lit("r").alias("repo"), name.alias("path"))
    return inventory.dependency_files(rows).select("p_partkey", "kind")


@query("""
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN concat('torch==1.', p_size, '.*') WHEN 1 THEN concat('numpy==1.21.', p_size) WHEN 2 THEN NULL WHEN 3 THEN 'scipy' WHEN 4 THEN concat('pandas>=', p_size) ELSE NULL END AS pip FROM part
""")
def conda_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n, s = table(spark, sf_dir, "part"), F.col("p_size") % 6, F.col("p_size").cast("string")
    spec = F.when(n == 0, F.concat(F.lit("pytorch::pytorch=1."), s)).when(n == 1, F.concat(F.lit("numpy=1.21."), s)).when(n == 2, "cudatoolkit=11").when(n == 3, "scipy").when(n == 4, F.concat(F.lit("pandas>="), s)).otherwise("libpng=1.6")
    return p.select("p_partkey", inventory.conda_to_pip(spec).alias("pip"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat('pkg', p_size) WHEN 1 THEN concat('name', p_size) WHEN 2 THEN '-r other.txt' ELSE '# note' END AS name FROM part
""")
def requirements_unpin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n, s = table(spark, sf_dir, "part"), F.col("p_size") % 4, F.col("p_size").cast("string")
    line = F.when(n == 0, F.concat(F.lit("pkg"), s, F.lit("==1.0 "))).when(n == 1, F.concat(F.lit("name"), s, F.lit("[extra]>=2; python_version<'3'"))).when(n == 2, "-r other.txt").otherwise("# note")
    return p.select("p_partkey", inventory.unpin(line).alias("name"))


@query("""
SELECT p_partkey, name, version FROM part, LATERAL (SELECT unnest(['numpy', concat('pkg', p_size)]) AS name, unnest(['1.' || p_size, '2.0']) AS version)
""")
def freeze_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    text = F.concat(F.lit("NumPy==1."), s, F.lit("\n-e git+x\nPkg"), s, F.lit("==2.0\n# done"))
    return p.select("p_partkey", F.explode(inventory.freeze(text)).alias("name", "version"))


@query("""
SELECT CAST(u AS BIGINT) AS user_id, a AS run, b AS other FROM (SELECT x.user_id AS u, x.event_id AS a, y.event_id AS b FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_id < y.event_id
  AND x.ts < y.ts + INTERVAL 90 MINUTE AND y.ts < x.ts + INTERVAL 90 MINUTE)
""")
def run_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").alias("id"), F.col("ts").alias("started"), (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("ended"))
    return inventory.run_overlap(runs, "user_id")


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'repo' ELSE 'authored' END AS origin, CASE c_custkey % 3 WHEN 1 THEN 'runs inline code' WHEN 2 THEN concat('src/train', c_custkey, '.py was modified after checkout') END AS why FROM customer
""")
def command_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    own, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 3
    command = F.when(k == 1, F.lit("python -u -c 'print(1)'")).otherwise(F.concat(F.lit("python ./train"), own, F.lit(".py --lr 1")))
    commands = c.select(own.alias("repo"), command.alias("command"), F.lit(False).alias("authored"))
    touched = c.filter(k == 2).select(own.alias("repo"), F.concat(F.lit("src/train"), own, F.lit(".py")).alias("path"), F.lit(False).alias("untracked"))
    return inventory.command_origin(commands, touched).select(F.col("repo").cast("long").alias("c_custkey"), "origin", "why")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN concat('ValueError: bad ', event_id, ' at end') ELSE 'two three' END AS gist FROM events
""")
def error_gist(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("start\n  × ValueError: bad "), "event_id", F.lit("\n\nat end\n"))).otherwise("one\ntwo\n three \n")
    return e.select("event_id", inventory.error_gist(text).alias("gist"))


@query("""
SELECT s_suppkey, path, why FROM supplier, LATERAL (SELECT unnest(['train.py', 'go.sh', 'util.py']) AS path, unnest([['name', '__main__ guard', 'mentioned in README'], ['mentioned in README', 'shell script'], ['mentioned in README']]) AS why)
""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    file = lambda path, text: F.struct(F.lit(path).alias("path"), F.lit(text).alias("text"), F.lit(len(text)).alias("size"))
    fs = F.array(file("README.md", "run train.py, go.sh and util.py"), file("train.py", "if __name__ == '__main__':\n  p.add_argument('--lr')"), file("go.sh", "x"), file("util.py", ""), file("lib/helper.py", ""))
    rows = s.select(F.col("s_suppkey").cast("string").alias("repo"), F.explode(fs).alias("f")).select("repo", "f.*")
    return inventory.entry_points(rows).select(F.col("repo").cast("long").alias("s_suppkey"), "path", "why")


@query("""
SELECT s_suppkey, n_code AS code_lines, CAST(1 AS BIGINT) AS checks, CAST(1 AS BIGINT) AS readme_lines FROM (SELECT s_suppkey, CAST(CASE WHEN s_nationkey % 2 = 0 THEN 2 ELSE 3 END AS BIGINT) AS n_code FROM supplier)
""")
def gpu_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    file = lambda path, text: F.struct(F.lit(path).alias("path"), (text if isinstance(text, F.Column) else F.lit(text)).alias("text"), F.lit(100).alias("size"))
    pins = F.when(F.col("s_nationkey") % 2 == 0, "numpy==1").otherwise("torch==1+cu110")
    fs = F.array(file("README.md", "needs a GPU\nor not"), file("train.py", "x.cuda()\ntorch.cuda.is_available()\nimport cupy"), file("requirements.txt", pins))
    rows = s.select(F.col("s_suppkey").cast("string").alias("repo"), F.explode(fs).alias("f")).select("repo", "f.*")
    parsed = inventory.parse_requirements(inventory.dependency_files(rows))
    out = inventory.gpu_use(inventory.file_lines(rows), inventory.file_lines(inventory.readmes(rows)), parsed)
    return out.select(F.col("repo").cast("long").alias("s_suppkey"), "code_lines", "checks", "readme_lines")


@query("""
SELECT s_suppkey, url, source FROM supplier, LATERAL (SELECT unnest([concat('https://zenodo.org/', s_suppkey), 'http://x.org/d.zip']) AS url, unnest(['README.md:1', 'README.md:2']) AS source)
""")
def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("get https://zenodo.org/"), "s_suppkey", F.lit(".\nand http://x.org/d.zip, https://arxiv.org/x.txt\nhttp://x.org/d.zip again"))
    rows = s.select(F.col("s_suppkey").cast("string").alias("repo"), F.lit("README.md").alias("path"), F.lit(100).alias("size"), text.alias("text"))
    out = inventory.downloads(inventory.file_lines(rows))
    return out.select(F.col("repo").cast("long").alias("s_suppkey"), "url", "source")


@query("""
SELECT s_suppkey, command, ord FROM supplier, LATERAL (SELECT unnest(['pip install torch numpy', concat('python train.py --seed ', s_suppkey)]) AS command, unnest([1, 2])::BIGINT AS ord)
""")
def readme_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("# Hi\n```bash\n$ pip install torch numpy\n# no\n```\nUse `python train.py --seed "), "s_suppkey", F.lit("` or `x`"))
    rows = s.select(F.col("s_suppkey").cast("string").alias("repo"), F.lit("README.md").alias("path"), F.lit(100).alias("size"), text.alias("text"))
    out = inventory.readme_commands(inventory.file_lines(inventory.readmes(rows)))
    return out.select(F.col("repo").cast("long").alias("s_suppkey"), "command", F.col("ord").cast("long").alias("ord"))


@query("SELECT s_suppkey, ['torch', 'numpy'] AS packages FROM supplier")
def install_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    cmds = s.select(F.col("s_suppkey").cast("string").alias("repo"), F.posexplode(F.array(*[F.lit(x) for x in ("pip install -U torch numpy", "pip install -r requirements.txt", "python x.py")])).alias("ord", "command"))
    return inventory.install_hints(cmds).select(F.col("repo").cast("long").alias("s_suppkey"), "packages")


@query("""
SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN '3.8' WHEN s_nationkey % 3 = 1 THEN '3.6' ELSE '3.11' END AS version FROM supplier
""")
def python_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_nationkey") % 3
    file = lambda path, text: F.struct(F.lit(path).alias("path"), text.alias("text"), F.lit(100).alias("size"))
    fs = F.array(file("setup.py", F.when(k == 0, "python_requires='>=3.8'").otherwise("")), file("README.md", F.when(k < 2, "tested with Python 3.6").otherwise("python 2.7 only")))
    rows = s.select(F.col("s_suppkey").cast("string").alias("repo"), F.explode(fs).alias("f")).select("repo", "f.*")
    parsed = inventory.parse_requirements(inventory.dependency_files(rows))
    hints = inventory.python_hints(parsed, inventory.file_lines(inventory.readmes(rows)))
    return inventory.suggest_python(hints).select(F.col("repo").cast("long").alias("s_suppkey"), "version")


@query("SELECT s_suppkey, 'm.py' AS path, CAST(2 AS BIGINT) AS line FROM supplier WHERE s_nationkey % 2 = 1")
def gpu_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    text = F.when(F.col("s_nationkey") % 2 == 0, "x\ny.cuda()\ntorch.cuda.is_available()").otherwise("x\ny.cuda()")
    rows = s.select(F.col("s_suppkey").cast("string").alias("repo"), F.lit("m.py").alias("path"), F.lit(10).alias("size"), text.alias("text"))
    return inventory.gpu_only(inventory.file_lines(rows)).select(F.col("repo").cast("long").alias("s_suppkey"), "path", F.col("line").cast("long").alias("line"))


@query("""
SELECT s_suppkey, 'Py_Torch' AS package, CAST(s_nationkey AS VARCHAR) AS version FROM supplier
""")
def key_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("repo", F.col("s_suppkey").cast("string"))
    declared = s.select("repo", F.explode(F.array(F.lit("py-torch==1.0"), F.lit("missing"))).alias("requirement"))
    installed = s.select("repo", F.explode(F.array(F.lit("Py_Torch"), F.lit("other"))).alias("package"), F.col("s_nationkey").cast("string").alias("version"))
    return inventory.key_packages(declared, installed).select(F.col("repo").cast("long").alias("s_suppkey"), "package", "version")


@query("""
SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5
""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:

    d = table(spark, sf_dir, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return d.select("source", "doc_id", rank.cast("long").alias("rank")).filter("rank <= 5")


@query("""
SELECT page_id, concat('Title & ', page_id) AS title, ['A. Author', concat('B ', page_id)] AS authors, 'code at http://github.com/o/n now' AS comments FROM pages
""")
def abs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    html = F.concat(F.lit('<meta name="citation_title" content="Title &amp; '), "page_id", F.lit('"/><meta name="citation_author" content="A. Author"/><meta name="citation_author" content="B '), "page_id", F.lit('"/><td class="tablecell comments mathjax">code at\n<a href="http://github.com/o/n">this https URL</a> now</td>'))
    return p.select("page_id", links.abs_page(html).alias("a")).select("page_id", "a.title", "a.authors", "a.comments")


@query("SELECT page_id, concat('o/n', page_id) AS repo, CAST(page_id * 2 AS BIGINT) AS stars FROM pages")
def search_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    reply = F.concat(F.lit('{"total_count": 1, "items": [{"full_name": "o/n'), "page_id", F.lit('", "stargazers_count": '), F.col("page_id") * 2, F.lit(', "description": null}]}'))
    return p.select("page_id", F.explode(links.search_reply(reply)).alias("r")).select("page_id", "r.repo", "r.stars")


@query("""
SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'environment.yml' END AS requirements, s_nationkey % 3 = 2 AS install_project FROM supplier
""")
def environment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_nationkey") % 3
    paths = F.when(k == 0, F.array(F.lit("setup.py"), F.lit("environment.yml"), F.lit("requirements.txt"))).when(k == 1, F.array(F.lit("environment.yml"), F.lit("sub/requirements.txt"))).otherwise(F.array(F.lit("setup.py"), F.lit("README.md")))
    deps = inventory.dependency_files(s.select(F.col("s_suppkey").cast("string").alias("repo"), F.explode(paths).alias("path")))
    return inventory.environment_plan(deps).select(F.col("repo").cast("long").alias("s_suppkey"), "requirements", "install_project")


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'try a newer Python' WHEN 1 THEN 'raise the time limit' WHEN 2 THEN 'the pins cannot be resolved: try their Python version, then without pins'
  WHEN 3 THEN 'a newer Python, or no pins, may allow a ready-built release' END AS hint FROM events
""")
def environment_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
    error = F.when(k == 2, "No solution found").when(k == 3, "Failed to build x").otherwise("odd")
    hint = inventory.environment_hint(F.when(k == 0, "create venv").otherwise("install"), error, k == 1, F.lit(False))
    return e.select("event_id", hint.alias("hint"))
