import random
import re

import pytest
from pyspark.sql import functions as F

from claimlens.functions import names, patterns
from claimlens.functions.text import compact_number, duration, split_lines, tail
from claimlens.operators import extract
from claimlens.sources import files


def values(spark, *lines):
    df = spark.createDataFrame([("log", "\n".join(lines))], "source string, text string")
    rows = extract.text_values(extract.lines(df)).orderBy("ord").collect()
    return [(r["name"], r["value"], r["percent"]) for r in rows]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("accuracy: 0.913", [("accuracy", 0.913, False)]),
        ("acc=91.3%", [("accuracy", 91.3, True)]),
        ("F1 81.2", [("f1", 81.2, False)]),
        ("train loss 1.7621, val loss 1.8822", [("train_loss", 1.7621, False), ("val_loss", 1.8822, False)]),
        ("best validation loss is 1.4697.", [("best_val_loss", 1.4697, False)]),
        ("loss of only 1.88", [("loss", 1.88, False)]),
        ("top-1 accuracy 76.1%", [("top1_accuracy", 76.1, True)]),
        ("acc_val: 0.5200", [("val_accuracy", 0.52, False)]),
        ("perplexity 3.2e+01", [("perplexity", 32.0, False)]),
        ("Accuracy: 9897/10000 (99%)", [("accuracy", 0.9897, False)]),
        ("episodic_return=[500.]", [("episodic_return", 500.0, False)]),
        ("P@1\t0.986", [("p@1", 0.986, False)]),
        ("lossless compression, python 3.11", []),
        ("RuntimeError: CUDA error 2", []),
        ("loss 3x slower", []),
        ("loss=4/0", [("loss", 4.0, False)]),
        ("", []),
    ],
)
def test_text_forms(spark, line, expected):
    assert values(spark, line) == expected


def test_fraction_text_and_lines(spark):
    df = spark.createDataFrame([("a", "x\n\nAccuracy: 3/4\n")], "source string, text string")
    row = extract.text_values(extract.lines(df)).first()
    assert (row["fraction"], row["line"], row["text"]) == ("3/4", 3, "Accuracy: 3/4")


def named(before, first):
    """The name that leads up to a value which begins with ``first``: plain Python, right to left over the same words."""
    s = before.rstrip(" \t")
    hedge = next((h for h in sorted(patterns.HEDGES, key=len, reverse=True) if s.lower().endswith(h)), "")
    s = s[: len(s) - len(hedge)].rstrip(" \t")
    behind = (before + first)[len(s)]
    for verb in sorted(patterns.VERBS, key=len, reverse=True):
        word = verb.isalpha()
        if s.lower().endswith(verb) and not (word and (re.match(r"\w", behind) or re.match(r"\w", s[: -len(verb)][-1:]))):
            s = s[: -len(verb)]
            break
    s = s.rstrip(" \t")
    if s.endswith(")") and "(" in s and s.count(")", s.rindex("(")) == 1 and len(s) - s.rindex("(") <= patterns.MAX_REMARK + 2:
        s = s[: s.rindex("(")].rstrip(" \t")
    prefixes, splits = patterns.any_of(patterns.METRIC_PREFIXES), patterns.any_of([*patterns.SPLITS, "valid"])
    for cut, after in ((s[:-1], ".") if s.endswith(".") else (s, (before + first)[len(s)]), (s, (before + first)[len(s)])):
        for at in range(len(cut)):
            if not re.match(r"[\w.]", cut[at - 1 : at]) and re.fullmatch(rf"(?:{prefixes}[ _-]){{0,2}}{patterns.METRIC}(?:[_-]{splits})?", cut[at:], re.I) and not re.match("[a-zA-Z0-9]", after):
                return at, cut[at:]
    return None


def spec(line):
    """The rules of a text line in plain Python, over the same vocabulary."""
    if line.lstrip().startswith(patterns.TRACEBACK) or re.match(r"[\w.]*(?:" + "|".join(patterns.EXCEPTION_SUFFIXES) + "):", line.lstrip()):
        return []
    out, taken = [], []
    for m in re.finditer(rf"(?![.](?<=[A-Za-z][.])){patterns.NUMBER}", line):
        start = m.start()
        if re.match(r"[\w@]", line[start - 1 : start]) and re.match(r"\d+\.\d", m[0]):
            start += m[0].index(".") + 1
        name = named(line[:start], line[start])
        if not name:
            continue
        over = re.match(r"[ \t]*/[ \t]*(\d+)", line[m.end() :])
        end = m.end() + (over.end() if over else 0)
        rest = line[end : end + 2]
        if (rest[:1].isalpha() and rest[:1].lower() != "e") or (rest[:1] == "." and rest[1:2].isdigit()):
            continue
        if over and int(over[1]) == 0:
            continue
        out.append((name[1], float(line[start : m.end()]) / (int(over[1]) if over else 1)))
        taken.append((name[0], end + len(re.match(r"[ \t]*%?", line[end:])[0])))
    found = []
    for at in (k for k, c in enumerate(line) if c == "="):
        key = re.search(r"[\w.@]*$", line[:at].rstrip(" \t"))
        right = line[at + 1 :].lstrip(" \t")
        right = (right[1:] if right.startswith("[") else right).lstrip(" \t")
        value = re.match(patterns.NUMBER, right)
        if value and re.fullmatch(r"[A-Za-z][\w@]*(?:\.[A-Za-z][\w@]*)*", key[0]) and not re.match(r"[\w.]", right[value.end() :].removeprefix(".")[:1]) and right[value.end() : value.end() + 2] != "..":
            found.append((key.start(), len(line) - len(right) + value.end(), key[0], float(value[0])))
    cells = re.split(r"\t+", line.strip(" \t"))
    if len(cells) == 2 and re.fullmatch(r"[A-Za-z][\w@]*", cells[0]) and re.fullmatch(patterns.NUMBER, cells[1]):
        found.append((0, len(line), cells[0], float(cells[1])))
    return out + [(name, value) for start, end, name, value in found if not any(a < end and start < b for a, b in taken)]


def test_extraction_equals_the_plain_rules(spark):
    rng = random.Random(1)
    bits = ["loss", "val ", "train_", "acc", "accuracy", ":", "=", " ", " is ", "about ", "0.5", "91", "%", "/", "10", "0", "e-3", ".", "x", "(top) ", "lr", "\t", "f1", "-", "top-1 ", "[", "]", "é", "k.b"]
    lines = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, text string")
    got = {}
    for r in extract.text_values(df.select("id", F.col("text").alias("body"), F.lit(1).alias("line")), keep=["id"]).orderBy("id", "ord").collect():
        got.setdefault(r["id"], []).append((r["raw_name"], r["value"]))
    want = {i: s for i, x in enumerate(lines) if (s := spec(x))}
    assert got == want


def test_json_document_lines_and_kinds(spark):
    text = '{\n "a": {"b": [1, {"c": 2.5}, true, "x", null]},\n "acc": 3\n}'
    df = spark.createDataFrame([("f", text)], "source string, text string")
    rows = {r["raw_name"]: (r["value"], r["line"]) for r in extract.json_values(df, depth=5).collect()}
    assert rows == {"a.b[0]": (1.0, 2), "a.b[1].c": (2.5, 2), "acc": (3.0, 3)}


def test_json_lines_skip_bad_ones(spark):
    df = spark.createDataFrame([("f", '{"loss": 2.0}\nbad {\n{"loss": 1.0}')], "source string, text string")
    assert sorted((r["line"], r["value"]) for r in extract.json_values(df, depth=2).collect()) == [(1, 2.0), (3, 1.0)]


def test_csv(spark):
    df = spark.createDataFrame([("f", 'model,accuracy,"f,1"\nours,0.9,81.2%\n"a, b",x,1')], "source string, text string")
    rows = [(r["name"], r["row"], r["value"], r["percent"], r["line"]) for r in extract.csv_values(df).orderBy("ord").collect()]
    assert rows == [("accuracy", "ours", 0.9, False, 2), ("f,1", "ours", 81.2, True, 2), ("f,1", "a, b", 1.0, False, 3)]


def test_names(spark):
    cases = {"Test  Accuracy:": "test_accuracy", "acc_val": "val_accuracy", "F1-score": "f1_score", "top-5": "top5_accuracy", " AUROC ": "roc_auc", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    for r in df.select("n", names.normalize_metric(F.col("n")).alias("m")).collect():
        assert r["m"] == cases[r["n"]] == extract._plain_name(r["n"])
    d = spark.createDataFrame([("91.30", 2), ("-5", 0), ("1e-5", 0), (".5", 1)], "t string, n int")
    assert all(r[0] == r[1] for r in d.select(names.decimals(F.col("t")), "n").collect())


def test_numbers_durations_lines(spark):
    xs = [None, 0.0, 1.8857, 12345.678, 0.00012345, 84.3667, -0.5, 100.0, 1e-9, 999.9999]
    want = ["n/a", "0"] + [f"{x:.4g}" if abs(x) >= 1000 or abs(x) < 0.001 else f"{x:.6g}" for x in xs[2:]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(compact_number(F.col("x"))).collect()] == want
    t = spark.createDataFrame([(0, None), (1, 5.04), (2, 65.0), (3, 3725.0)], "i int, s double")
    assert [r[0] for r in t.orderBy("i").select(duration(F.col("s"))).collect()] == ["n/a", "5.0s", "1m 05s", "1h 02m"]
    ls = spark.createDataFrame([("a\r\nb\n",), ("",), ("a\n\nb",)], "t string").select(split_lines(F.col("t")), tail(F.col("t"), 1, 10)).collect()
    assert [tuple(r) for r in ls] == [(["a", "b"], "b"), ([], ""), (["a", "", "b"], "b")]


def test_wanted_caps_and_says_so(spark):
    df = spark.createDataFrame([("e", "loss", i) for i in range(5)] + [("e", "lr", 9)], "x string, name string, ord int")
    rows = extract.wanted(df, ["Loss"], ["x"], 3).orderBy("ord").collect()
    assert [(r["ord"], r["truncated"]) for r in rows] == [(0, True), (1, True), (2, True)]


def test_deep_json_and_wide_lists(spark):
    deep = "[" * 150 + '{"x": 7, "s": "\\"]]]"}' + "]" * 150
    wide = '{"loss": [' + ", ".join(str(k) for k in range(1200)) + '], "b": {"z": 1, "a": true}}'
    df = spark.createDataFrame([("deep", deep), ("wide", wide), ("lines", wide + "\nno json\n" + '{"acc": 3}'), ("none", None), ("empty", "")], "source string, text string")
    rows = {}
    for r in extract.json_values(df).orderBy("source", "ord").collect():
        rows.setdefault(r["source"], []).append((r["raw_name"], r["value"], r["line"]))
    assert rows["deep"] == [("[0]" * 150 + ".x", 7.0, 1)]
    assert rows["wide"] == [("b.z", 1.0, 1)] + [(f"loss[{k}]", float(k), 1) for k in range(1000)]
    assert rows["lines"] == rows["wide"] + [("acc", 3.0, 3)] and set(rows) == {"deep", "wide", "lines"}


def test_json_is_flattened_without_python(spark):
    flat = "[" + ", ".join('{"n": %d}' % k for k in range(14)) + ", " + "9" * 400 + ", 1e400, -0.1, 12345678901234567890123456789012345678901]"
    twice = '{"a": {"b": {"c": {"d": {"e": [1]}}}}}'
    df = spark.createDataFrame([("flat", flat), ("deep", twice), ("deep", twice), (None, twice)], "source string, text string")
    out = extract.json_values(df)
    rows = {}
    for r in out.collect():
        rows.setdefault(r["source"], []).append((r["raw_name"], r["value"]))
    assert rows["deep"] == [("a.b.c.d.e[0]", 1.0)] * 2 and rows[None] == rows["deep"][:1]  # repeated rows and null keys stay
    assert sorted(rows["flat"]) == sorted([(f"[{k}].n", float(k)) for k in range(14)] + [("[14]", float("inf")), ("[15]", float("inf")), ("[16]", -0.1), ("[17]", 12345678901234567890123456789012345678901.0)])
    assert not any(x in out._jdf.queryExecution().optimizedPlan().toString() for x in ("Python", "Arrow"))


def test_nesting_counts_open_brackets_outside_of_strings(spark):
    cases = {"": 0, "1": 0, "[]": 1, "[[],[]]": 2, '{"a[[": [{"b": "]]\\"[[["}]}': 3, '["\\\\", [[]]]': 3, "[{}, {}, {}, {}]": 2}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", extract.nesting(F.col("t"))).collect()} == cases


def test_deep_json_is_flattened_without_a_shuffle(spark):
    odd = '{"": {"": [1, {"a.b": [[[[2.5, null, "x", {"k": -3}]]]]}]}, "n": {"m": {"o": {"p": {"q": {}, "r": [], "s": false}}}}, "z": 4}'
    wide = '{"a": {"b": {"c": {"d": {"e": [' + ", ".join(str(k) for k in range(1200)) + "]}}}}}"
    out = extract.json_values(spark.createDataFrame([("odd", odd), ("wide", wide), ("line", "step\n" + odd), ("deepest", "[" * 999 + "7" + "]" * 999)], "source string, text string"))
    rows = {}
    for r in out.orderBy("source", "ord").collect():
        rows.setdefault(r["source"], []).append((r["raw_name"], r["value"], r["line"], len(r["ord"]["pos"])))
    leaves = [("[0]", 1.0, 3), (".".join(["[1]", "a", "b[0][0][0][0]"]), 2.5, 8), ("[1].a.b[0][0][0][3].k", -3.0, 9), ("z", 4.0, 1)]
    assert sorted(rows["odd"]) == sorted((k, v, 1, n) for k, v, n in leaves) and sorted(rows["line"]) == sorted((k, v, 2, n) for k, v, n in leaves)
    assert rows["wide"] == [(f"a.b.c.d.e[{k}]", float(k), 1, 6) for k in range(1000)]
    assert rows["deepest"] == [("[0]" * 999, 7.0, 1, 999)] and len(rows) == 4
    assert not any(x in out._jdf.queryExecution().optimizedPlan().toString() for x in ("UnionLoop", "Join", "Aggregate "))
    depths = {"]][[[": 1, "[[]][[[]]]": 3, "[{}]]][[": 2}
    assert {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in depths], "t string").select("t", extract.nesting(F.col("t"))).collect()} == depths


def test_refused_texts_are_parsed_twice_at_most(spark):
    texts = {"page": "\x0c[1]", "blank": " \n\u2003\n", "spaced": "\u2003{1}\u2003\n2", "twice": '{"a": 1, "a": 2}\n{"a": 1, "a": 2}\n', "closers": "]]" + "[" * 1002}
    out = extract.json_refused(spark.createDataFrame(list(texts.items()), "source string, text string"))
    got = {r["source"]: (r["lines_read"], r["lines_skipped"], r["reason"]) for r in out.collect()}
    assert got == {"spaced": (1, 1, "lines that are no JSON"), "twice": (0, 2, "no valid JSON document"), "closers": (0, 1, "lines that are no JSON")}
    # once as a whole, once line by line
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 2


def test_json_that_the_parser_refuses_has_a_reason(spark):
    texts = {"deep": "[" * 1001 + "]" * 1001, "digits": "[" + "1" * 1001 + "]", "twice": '{"a": 1, "a": 2}', "lines": '{"a": 1}\n\nstep 2\n[2]', "prose": "no json", "fine": "[1]", "all lines": "1\n[2]\n", "empty": "", "none": None}
    df = spark.createDataFrame(list(texts.items()), "source string, text string")
    got = {r["source"]: (r["lines_read"], r["lines_skipped"], r["reason"]) for r in extract.json_refused(df).collect()}
    assert got == {
        "deep": (0, 1, "nested over 1000 deep"), "digits": (0, 1, "a number of over 1000 digits"), "twice": (0, 1, "no valid JSON document"),
        "lines": (2, 1, "lines that are no JSON"), "prose": (0, 1, "lines that are no JSON"),
    }


def test_refused_texts_are_parsed_twice_at_most(spark):
    texts = {"page": "\x0c[1]", "blank": " \n\u2003\n", "spaced": "\u2003{1}\u2003\n2", "twice": '{"a": 1, "a": 2}\n{"a": 1, "a": 2}\n', "closers": "]]" + "[" * 1002}
    out = extract.json_refused(spark.createDataFrame(list(texts.items()), "source string, text string"))
    got = {r["source"]: (r["lines_read"], r["lines_skipped"], r["reason"]) for r in out.collect()}
    assert got == {"spaced": (1, 1, "lines that are no JSON"), "twice": (0, 2, "no valid JSON document"), "closers": (0, 1, "lines that are no JSON")}
    # once as a whole, once line by line
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 2


def test_odd_tables(spark):
    df = spark.createDataFrame([("a", "h,x\n\n1,2,3\n\"q\n,r\",4.5%\n"), ("b", None), ("c", ""), ("d", "only,head")], "source string, text string")
    rows = [(r["source"], r["name"], r["row"], r["value"], r["percent"], r["line"]) for r in extract.csv_values(df).orderBy("source", "ord").collect()]
    assert rows == [("a", "h", "1", 1.0, False, 3), ("a", "x", "1", 2.0, False, 3), ("a", "x", "q\n,r", 4.5, True, 4)]


def test_files_with_bad_bytes_and_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_FILE", 1000)
    (tmp_path / "a.log").write_bytes(b"caf\xe9\nloss 0.5 \xff")
    (tmp_path / "big.log").write_bytes(b"loss 0.25\n" * 200)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "c.log").write_bytes(b"loss 3")
    read = files.read_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["text"]) for r in read.collect()}
    assert got == {"a.log": (15, "caf\ufffd\nloss 0.5 \ufffd"), "big.log": (2000, None)}
    assert [(r["name"], r["value"], r["line"]) for r in files.metric_values(read).collect()] == [("loss", 0.5, 2)]
