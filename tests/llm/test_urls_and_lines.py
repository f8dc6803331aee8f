import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from aliasmith.llm.oracles import OP1
from aliasmith.llm.site_lines import page_text, without_boilerplate
from aliasmith.llm.url_templates import RULES, best_rule, host_and_path, judged, templates, whole_path

URLS = [
    "https://Example.ORG/es/1",
    "http://sub.example.org/en/15?x=/y",
    "http://sub.example.org/en/25#top",
    "https://myexample.org/es/1",
    "https://x.com/fr/",
    "https://x.com/de",
    "https://x.com/de/7",
    "https://x.net/a//b/1.html",
    "no scheme",
    "",
    None,
    "a://b://c/d",
    "https://host.org?q",
    "https://ÉCOLE.org/a\nb",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fitting = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fitting, key=lambda r: len(r.text), default=None)
    return (best.text, best.verdict) if best else (None, None)


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    host, path = host_and_path(F.col("url"))
    rows = df.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"))).collect()
    for row in rows:
        assert (row.host, row.path) == parts(URLS[row.page_id])
        assert ((row.best.rule, row.best.verdict) if row.best else (None, None)) == rule_of(row.host, row.path)


def test_paths_are_whole(spark):
    df = spark.createDataFrame([("/a/12/b3.html",), ("",), ("//",), ("/1/2/3/4/5/6/7/8",)], "path string")
    found = [r[0] for r in df.select(whole_path(F.col("path"))).collect()]
    assert found == [["a", "#", "b#.html"], [], [], ["#"] * 8]


def test_many_kinds_become_a_wildcard_and_unlike_branches_stay(spark):
    rows = [("h", f"/news/{chr(97 + i)}{chr(97 + j)}/x", 0) for i in range(5) for j in range(5)]
    rows += [("h", f"/good/{i}", 0) for i in range(40)] + [("h", f"/spam/{i}", 1) for i in range(40)] + [("h", f"/fair/{i}", None) for i in range(5)]
    df = spark.createDataFrame(rows, "host string, path string, bad int")
    found = {tuple(r["shape"]): ("/".join(r.template), r.bad_share) for r in templates(df).collect()}
    assert {found[s][0] for s in found if s[0] == "news"} == {"news/*/x"}
    assert found["spam", "#"][0] == "spam/#" and found["spam", "#"][1] > 0.9
    assert found["good", "#"][1] < 0.1
    assert found["fair", "#"][0] == "*/#"


def _deep_rows():
    """Paths of many lengths: many kinds below deep nodes, like and unlike siblings, and one path of 200 segments."""
    rows = [(f"https://a.net/x/y/z/u/v/w/{chr(97 + i % 5)}{chr(97 + i // 5)}/t/{i}", None) for i in range(30)]
    rows += [(f"https://a.net/1/2/3/4/5/6/7/8/{('spam', 'ham')[i % 2]}/{i}", i % 2 == 0) for i in range(60)]
    rows += [(f"https://b.net/p/q/r/s/t/u/v/{'abc'[i % 3]}/{i}", i % 4 == 0) for i in range(40)]
    rows += [("https://b.net/" + "/".join("abcd"[i % 4] for i in range(200)), None), ("https://c.net/", None), (None, None)]
    return rows + [(f"https://d.net/{'k' * (i + 1)}", None) for i in range(14)]


def test_deep_paths_equal_the_sql(spark, tmp_path):
    rows = _deep_rows()
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id bigint, url string")
    last = {i: re.search(r"([0-9]+)[^0-9]*$", parts(u)[1]) for i, (u, _) in enumerate(rows)}
    numbered = {int(last[i].group(1)): bad for i, (u, bad) in enumerate(rows) if bad is not None}
    labels = spark.createDataFrame([(k, int(not b), 0) for k, b in numbered.items()], "doc_id bigint, quality int, toxic int")
    known = pages.select("page_id", F.regexp_extract(host_and_path(F.col("url"))[1], "([0-9]+)[^0-9]*$", 1).try_cast("bigint").alias("doc_id"))
    bad = known.join(labels, "doc_id").select("page_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    start = time.monotonic()
    found = judged(pages, bad).collect()
    assert time.monotonic() - start < 90
    con = duckdb.connect()
    for name, table in (("pages", pages), ("labels", labels)):
        con.register(name, table.toArrow())
    cursor = con.execute(OP1)
    columns = [c[0] for c in cursor.description]
    expected = {row[0]: dict(zip(columns, row, strict=True)) for row in cursor.fetchall()}
    assert len(found) == len(rows) == len(expected)
    for row in found:
        want = expected[row.page_id]
        assert (row.host, row.path, row.rule, row.verdict, row.template) == tuple(want[c] for c in ("host", "path", "rule", "verdict", "template"))
        assert row.bad_share == pytest.approx(want["bad_share"])
    made = {row.template for row in found}
    assert "x/y/z/u/v/w/*/t/#" in made and "#/#/#/#/#/#/#/#/spam/#" in made and "*" in made


def test_verdicts_come_from_the_rule_or_the_purity(spark):
    rows = [(i, f"https://x.net/spam/{i}") for i in range(20)] + [(100 + i, f"https://x.net/good/{i}") for i in range(20)]
    rows += [(200, "https://x.com/fr/1"), (201, None), (200, "https://x.com/fr/1")]
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in rows], "page_id bigint, url string, template string, host string")
    labels = spark.createDataFrame([(i, True) for i in range(10)] + [(100 + i, False) for i in range(10)] + [(0, False)], "page_id bigint, bad boolean")
    found = judged(pages, labels).collect()
    assert len(found) == len(rows)
    verdict = defaultdict(set)
    for r in found:
        verdict[r.page_id].add(r.verdict)
    assert all(verdict[i] == {"block"} for i in range(20)) and all(verdict[100 + i] == {"allow"} for i in range(20))
    assert verdict[200] == {"allow"} and verdict[201] == {"allow"}


def test_verdicts_differ_below_deep_branches(spark):
    deep = "https://x.net/a/b/c/d/e/f"
    rows = [(i, f"{deep}/spam/g/h/{i}") for i in range(30)] + [(100 + i, f"{deep}/good/g/h/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i < 100) for i, _ in rows], "page_id bigint, bad boolean")
    found = {r.page_id: (r.verdict, r.template) for r in judged(pages, labels).collect()}
    assert all(found[i] == ("block", "a/b/c/d/e/f/spam/g/h/#") for i in range(30))
    assert all(found[100 + i] == ("allow", "a/b/c/d/e/f/good/g/h/#") for i in range(60))


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    labels = spark.createDataFrame([], "page_id bigint, bad boolean")
    assert judged(pages, labels).collect() == []
    assert without_boilerplate(pages.select("page_id", F.col("url").alias("host"), F.col("html").alias("text"))).collect() == []


def brute_lines(rows, ratio, fewest):
    pages = Counter(h for _, h, _ in rows)
    counts = Counter((h, line) for _, h, t in rows for line in {x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")} - {""})
    frequent = {k for k, n in counts.items() if n >= fewest and n > ratio * pages[k[0]]}
    out = []
    for page_id, host, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (host, x.strip(" \t\n\x0b\x0c\r")) not in frequent]
        out.append((page_id, host, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("ratio", "fewest"), [(0.1, 1), (0.1, 3), (0.5, 2)])
def test_lines_equal_the_brute_force(spark, ratio, fewest):
    rows = [(i, "hot" if i % 3 else f"h{i % 5}", f"menu {i % 4}\n\n  body {i}\nbody {i}\n{'footer' if i % 2 else ' footer '}") for i in range(120)]
    rows += [(500, None, "menu 0\nx"), (501, None, "menu 0\ny"), (502, None, "menu 0"), (503, "hot", None), (504, "hot", ""), (1, "hot", "menu 1\n" * 3000)]
    rows += [(600, "tiny", "same"), (601, "tiny", "same")]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id bigint, host string, text string, lines string").repartition(6)
    found = without_boilerplate(pages, ratio, fewest).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute_lines(rows, ratio, fewest)))


def test_page_text_ends_lines_after_blocks(spark):
    df = spark.createDataFrame([("<p>a</p><li>b</li>c<br>d", )], "html string")
    assert df.select(page_text(F.col("html"))).first()[0] == "<p>a</p>\n<li>b</li>\nc<br>\nd"
