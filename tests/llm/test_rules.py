from collections import Counter, defaultdict

from pyspark.sql import functions as F

from moveproof.llm import line_rules, url_rules
from moveproof.session import literal_rows

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"),
         ("a.com", "/", "allow"), ("", "", "block")]


def verdicts(spark, urls, rules=RULES, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = literal_rows(spark, "host string, path string, verdict string", rules)
    found = url_rules.filter_urls(pages, known, **options).orderBy("page_id").collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in found]


def test_longest_rule_wins_and_borders_are_labels(spark):
    got = verdicts(spark, [
        "http://X.example.ORG/es/1?q", "http://badexample.org/es/1", "https://b.a.com/de/x#y",
        "http://q.com/de", "HTTP://q.com/de/", "://a.com", "no url", None, "", "x://y://z.org/"])
    assert got == [
        ("x.example.org", "/es/1", "example.org/es/", "block"),
        ("badexample.org", "/es/1", "org/", "allow"),
        ("b.a.com", "/de/x", "com/de/", "block"),
        ("q.com", "/de", None, "allow"), ("q.com", "/de/", "com/de/", "block"),
        ("a.com", "", None, "allow"), ("", "", "", "block"), ("", "", "", "block"), ("", "", "", "block"),
        ("y:", "//z.org/", None, "allow")]


def test_ties_repeats_and_no_rules(spark):
    tie = [("b.c", "/x", "allow"), ("c", "/x/y", "block")]
    assert verdicts(spark, ["h://a.b.c/x/y"], tie) == [("a.b.c", "/x/y", "b.c/x", "allow")]
    same = [("c", "/", "allow"), ("c", "/", "block")]
    assert verdicts(spark, ["h://c/", "h://c/"], same) == [("c", "/", "c/", "block")] * 2
    assert verdicts(spark, ["h://c/"], [], default="block") == [("c", "/", None, "block")]
    assert verdicts(spark, [], RULES) == []
    long = "h://" + "a." * 3000 + "org/" + "p" * 50000
    assert verdicts(spark, [long])[0][2:] == ("org/", "allow")


def test_short_digests_are_confirmed(spark):
    urls = [f"h://h{i}.org/{i}" for i in range(200)]
    assert verdicts(spark, urls, digits=1) == verdicts(spark, urls)


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "h://a.org/", "x", "y")], "page_id int, url string, host string, rule string")
    known = literal_rows(spark, "host string, path string, verdict string", RULES)
    assert [tuple(r) for r in url_rules.filter_urls(pages, known).collect()] == [
        (1, "a.org", "/", "org/", "allow")]


def brute_repeats(words, window=5):
    seen = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
    gone = set()
    for i in range(len(words) - window + 1):
        if seen[tuple(words[i:i + window])] > 1:
            gone.update(range(i, i + window))
    return len(gone)


TEXTS = ["", None, " \n\t", "a b c d e a b c d e", "x " * 300, "a b c d e f", "é*$ &|\n\ny\ny\n y", "one\x0btwo\x0cthree\r\nfour",
         "a b a b a b a b c", "w" * 70000, " ".join(f"w{i % 700}" for i in range(20000))]


def test_measures(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumn("source", F.lit("s"))
    got = {r.doc_id: r for r in line_rules.quality_rules(docs).collect()}
    for i, text in enumerate(TEXTS):
        raw = text or ""
        words = [w.decode() for w in raw.encode().split()]
        full = [line for line in raw.split("\n") if line.encode().split()]
        repeats = brute_repeats(words)
        want = (len(words), sum(map(len, words)), sum(raw.count(c) for c in "#*$%&|<>"),
                len(full) - len(set(full)), repeats, len(words) < 10 or 100 * repeats > 20 * len(words))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, i


def test_common_lines_go_and_depleted_documents_are_rejected(spark):
    common = "Shared line of the site, with ten words in it."
    rows = [(i, f"{common}\nown{i} " + " ".join(f"w{i}x{j}" for j in range(20)), "h1") for i in range(30)]
    rows += [(100 + i, f"  {common.upper()}  \nonly w{i}", "h1") for i in range(5)]
    rows += [(200, common + " more", "h2"), (201, common + " more", "h2"), (300, f"{common}\nshort", None)]
    rows += [(400 + i, "\n".join([common] * 3 + [f"copy {i % 2}"]), "h3") for i in range(60)]
    rows += [rows[31]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = defaultdict(list)
    for r in line_rules.quality_rules(docs).collect():
        got[r.doc_id].append((r.n_common_words, r.kept))
    assert got[0] == [(0, True)] and got[1] == [(10, True)] and got[29] == [(10, True)]
    assert got[100] == [(10, False)] and got[101] == [(10, False)] * 2
    assert got[200] == [(0, True)] and got[300] == [(0, True)]
    # sixty copies of two texts are two documents, below the limit
    assert got[400][0][0] == 0


def test_rules_on_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_rules.quality_rules(empty).collect() == []
    text = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(None, text, None, 1, 2)], "doc_id long, text string, source string, key int, host int")
    assert [(r.doc_id, r.kept) for r in line_rules.quality_rules(docs).collect()] == [(None, True)]


def test_the_limit_does_not_grow_with_the_host(spark):
    """One host of 30,000 texts: 1 % of them would be 300, but a line in 201 of them is above the limit."""
    own = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("h").alias("source"), F.format_string(
        "w%da w%db w%dc w%dd w%de w%df w%dg w%dh w%di w%dj w%dk", *["id"] * 11).alias("own"))
    line = lambda name, n: F.when(F.col("doc_id") < n, F.concat(F.lit(f"the {name} line of the host\n"))).otherwise("")
    docs = own.withColumn("text", F.concat(line("frequent", 201), line("rarer", 200), "own"))
    got = line_rules.quality_rules(docs).groupBy("n_common_words").count().collect()
    assert sorted(map(tuple, got)) == [(0, 29_800), (6, 200)]


def test_kept_documents_are_those_that_the_rules_keep(spark, root, monkeypatch):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    common = "A line that all of them share, of eleven words or so."
    some = spark.createDataFrame(
        [(90_000 + i, f"{common}\nown {i}" if i % 3 else f"{common}\n" + " ".join(f"x{i}y{j}" for j in range(30)), "en",
          None if i % 2 else "src0", 1) for i in range(120)], docs.schema)
    docs = docs.unionByName(some).unionByName(some.limit(9))
    judged = line_rules.quality_rules(docs)
    assert judged.filter("not base_failed and not kept").count() > 60
    wanted = sorted(r.doc_id for r in judged.filter("kept").collect())
    assert sorted(r.doc_id for r in line_rules.kept_documents(docs).collect()) == wanted
    monkeypatch.setattr(line_rules, "BROADCAST_TEXTS", 0)
    assert sorted(r.doc_id for r in line_rules.kept_documents(docs).collect()) == wanted
