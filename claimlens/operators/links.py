"""Paper and repository links: identifiers, mentions, ranking, recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches, strip

# Owners that are no owners, repositories that papers use and do not hold, words about code. ---------
NOT_OWNERS = ["orgs", "users", "topics", "about", "features", "sponsors"]
FRAMEWORKS = [
    "pytorch/pytorch", "pytorch/examples", "pytorch/vision", "tensorflow/tensorflow", "tensorflow/models", "google/jax",
    "jax-ml/jax", "huggingface/transformers", "huggingface/datasets", "facebookresearch/fairseq",
    "scikit-learn/scikit-learn", "numpy/numpy", "keras-team/keras", "openai/gym", "farama-foundation/gymnasium",
    "pyg-team/pytorch_geometric", "rusty1s/pytorch_geometric", "dmlc/dgl", "mlfoundations/open_clip", "openai/clip",
]
CODE_WORDS = r"(?iU)\b(code|implementation|available|released|open[- ]source|reproduc|repository)\b"
# ------------------------------------------------------------------------------------------------------------------
#: Characters of a link behind its host: an owner has up to 39, a name up to 100.
MAX_LINK = 400
ARXIV_MENTION = r"(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv:\s*)(\d{4}\.\d{4,5}|[a-z][a-z.\-]+/\d{7})"


def arxiv_id(target: Column) -> Column:
    """The id of arxiv:ID, an arXiv URL or a bare id, without its version; null for anything else."""
    text = strip(target)
    steps = F.split(text, "/")
    host = F.lower(F.get(steps, F.lit(2))).isin("arxiv.org", "www.arxiv.org") & F.lower(F.get(steps, F.lit(0))).isin("http:", "https:") & (F.get(steps, F.lit(1)) == "")
    page = host & F.lower(F.get(steps, F.lit(3))).isin("abs", "pdf") & (F.size(steps) == 5)
    named = F.when(F.size(steps) == 1, F.regexp_replace(text, "(?i)^arxiv:", "")).when(page, F.get(steps, F.lit(4)))
    bare = F.regexp_replace(F.regexp_replace(named, r"(?i)\.pdf$", ""), "(?i)v[0-9]+$", "")
    year, number = F.substring_index(bare, ".", 1), F.substring_index(bare, ".", -1)
    digits = year.rlike("^[0-9]{4}$") & number.rlike("^[0-9]{4,5}$") & (F.length(bare) == F.length(year) + F.length(number) + 1)
    return F.when(digits, bare)


def arxiv_mentions(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Each id with the line where it is first mentioned, per document."""
    ls = docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("at", "body"))
    ids = ls.select(*keys, (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all("body", F.lit(ARXIV_MENTION), F.lit(1))).alias("arxiv"))
    return ids.groupBy(*keys, "arxiv").agg(F.min("line").alias("line"))


def repo_links(text: Column) -> Column:
    """Structs (start, end, repo) of the repositories mentioned in a text, in order, with repeats."""
    name = lambda x: F.regexp_replace(F.regexp_replace(x["name"], r"[.,;:)\]}'\"]+$", ""), r"\.git$", "")
    good = lambda x: (name(x) != "") & ~F.lower(x["owner"]).isin(NOT_OWNERS)

    def read(x: Column) -> Column:
        behind = F.substring(text, x["end"] + 1, F.lit(MAX_LINK))
        owner = F.regexp_extract(behind, r"(?U)^[A-Za-z0-9][\w.-]*", 0)
        rest = F.substring(behind, F.length(owner) + 1, F.lit(MAX_LINK))
        repo = F.when((owner != "") & rest.startswith("/"), F.regexp_extract(F.substring(rest, 2, MAX_LINK), "^[A-Za-z0-9_.-]+", 0)).otherwise("")
        return F.struct(x["start"].alias("start"), (x["end"] + F.length(owner) + 1 + F.length(repo)).alias("end"), owner.alias("owner"), repo.alias("name"))

    found = F.filter(F.transform(matches(text, r"(?i)github\.com/", []), read), good)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat_ws("/", x["owner"], name(x)).alias("repo")))


def page_links(pages: DataFrame, keys: list[str], text: str = "text", page: str = "page") -> DataFrame:
    """Links of paper pages with their surroundings: 120 characters before, 40 after."""
    flat = F.regexp_replace(F.col(text), r"(?U)\s+", " ")
    rows = pages.select(*keys, page, flat.alias("_t")).select(*keys, page, "_t", F.posexplode(repo_links(F.col("_t"))).alias("at", "l"))
    begin = F.greatest(F.col("l.start") - 120, F.lit(0))
    where = F.concat(F.lit("paper page "), F.col(page).cast("string"), F.lit(" (text)"))
    return rows.select(*keys, "l.repo", where.alias("where"), F.substring(F.col("_t"), begin + 1, F.col("l.end") + 40 - begin).alias("text"), F.struct(page, "at").alias("ord"))


def rank(links: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates by key, best first: links (repo, where, text, ord) -> repo, score, where, text, mentions, rank."""
    from pyspark.sql import Window

    frameworks = F.broadcast(links.sparkSession.createDataFrame([(r,) for r in FRAMEWORKS], "key string"))  # twenty rows
    rows = links.withColumn("key", F.lower("repo")).join(frameworks, "key", "left_anti")
    page = F.regexp_extract("where", r"page (\d+)", 1).try_cast("int")
    score = F.when(F.col("where").startswith("arXiv"), 100).otherwise(F.greatest(F.lit(0), 20 - 2 * F.coalesce(page, F.lit(99))))
    score = score + F.when(F.coalesce(F.col("text"), F.lit("")).rlike(CODE_WORDS), 10).otherwise(0)
    best = F.min_by(F.struct("repo", "where", "text", F.col("_s").alias("s")), F.struct((-F.col("_s")).alias("down"), "ord"))
    out = rows.withColumn("_s", score).groupBy(*keys, "key").agg(best.alias("b"), F.count(F.lit(1)).alias("mentions"), F.min("ord").alias("first"))
    out = out.withColumn("score", F.col("b.s") + F.least("mentions", F.lit(10)))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "first")
    return out.select(*keys, "b.repo", "score", "b.where", "b.text", "mentions", F.row_number().over(order).alias("rank"))


def choose(ranked: DataFrame, search: DataFrame, key: str) -> DataFrame:
    """The method that names a paper's repository: its page, its text, or (not stated by the authors) a search."""
    stated = ranked.filter("rank = 1").select(key, "repo", F.when(F.col("where").startswith("arXiv"), 0).otherwise(1).alias("p"))
    both = stated.unionByName(search.select(key, "repo", F.lit(2).alias("p")))
    best = both.groupBy(key).agg(F.min_by(F.struct("repo", "p"), "p").alias("b"))
    how = F.element_at(F.array(*[F.lit(x) for x in ("page", "paper", "search")]), F.col("b.p") + 1)
    return best.select(key, "b.repo", how.alias("method"), (F.col("b.p") < 2).alias("author_stated"))


def abs_page(page: Column) -> Column:
    """Title, abstract, authors and comments of an abstract page's HTML."""
    entities = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}

    def plain(c: Column) -> Column:
        for code, char in entities.items():
            c = F.replace(c, F.lit(code), F.lit(char))
        return c

    meta = lambda key: F.trim(plain(F.nullif(F.regexp_extract(page, f'<meta name="citation_{key}" content="([^"]*)"', 1), F.lit(""))))
    authors = F.transform(F.regexp_extract_all(page, F.lit('<meta name="citation_author" content="([^"]*)"'), F.lit(1)), plain)
    comments = F.regexp_extract(page, r'(?s)<td class="tablecell comments[^"]*">(.*?)</td>', 1)
    anchor = F.regexp_replace(comments, r'(?s)<a [^>]*href="([^"]+)"[^>]*>.*?</a>', "$1")
    bare = F.trim(F.regexp_replace(plain(F.regexp_replace(anchor, "<[^>]+>", "")), r"\s+", " "))
    return F.struct(meta("title").alias("title"), meta("abstract").alias("abstract"), authors.alias("authors"), bare.alias("comments"))


def search_reply(reply: Column) -> Column:
    """Repositories of a code-search reply, in its order."""
    items = F.from_json(reply, "items array<struct<full_name string, stargazers_count bigint, description string>>")["items"]
    return F.transform(items, lambda x: F.struct(x["full_name"].alias("repo"), x["stargazers_count"].alias("stars"), x["description"].alias("description")))


def repo_key(text: Column) -> Column:
    """owner/name in lower case of a repository URL or an owner/name; null for anything else."""
    t = F.lower(strip(text))
    name = r"([a-z0-9][\w.-]*/[\w.-]+?)(?:\.git)?"
    url = F.regexp_extract(t, rf"^(?:git\+)?(?:https?://|git@|ssh://git@)?(?:www\.)?github\.com[:/]{name}(?:[/#?].*)?$", 1)
    return F.coalesce(F.nullif(url, F.lit("")), F.nullif(F.regexp_extract(t, rf"^(?!github\.com/){name}/?$", 1), F.lit("")))


def slug(text: Column) -> Column:
    """A name that is safe as a folder name."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(strip(text), r"/+$", ""), r"\.git$", ""), "[/:]"), -1)
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(last), r"[^a-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", ""), F.lit("")), F.lit("study"))


def find_recipe(targets: DataFrame, recipes: DataFrame) -> DataFrame:
    """For each target the first recipe by slug, else repository, else arXiv id; recipes: slug, repo, arxiv, ord."""
    keys = F.array(F.struct(F.lit(0).alias("p"), F.lower("slug").alias("k")), F.struct(F.lit(1).alias("p"), repo_key(F.col("repo")).alias("k")), F.struct(F.lit(2).alias("p"), F.col("arxiv").alias("k")))
    r = recipes.select(F.col("slug").alias("recipe"), "ord", F.explode(keys).alias("x")).select("recipe", "ord", "x.*").filter("k is not null")
    wants = F.array(F.struct(F.lit(0).alias("p"), F.lower("target").alias("k")), F.struct(F.lit(1).alias("p"), repo_key(F.col("target")).alias("k")), F.struct(F.lit(2).alias("p"), arxiv_id(F.col("target")).alias("k")))
    t = targets.select("target", F.explode(wants).alias("x")).select("target", "x.*").filter("k is not null")
    found = t.join(r, ["p", "k"]).groupBy("target").agg(F.min_by("recipe", F.struct("p", "ord")).alias("recipe"))
    return targets.select("target").distinct().join(found, "target", "left")
