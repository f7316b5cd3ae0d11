"""Pages, URLs, quality rules, lines, licences and archives against plain Python."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ampliskew.llm import html_text, licenses, lines, quality, urls, warc

PAGES = "page_id long, url string, html string"
LONG = "A long sentence of the story, with many words in it, that goes on and on for the reader."


def test_article_without_boilerplate():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></li></ul></nav><header>Site</header><div class="cookie-notice">We use cookies on this site, please accept all of them now.</div>
    <article><h1>Head &amp; line</h1><p>{LONG}<p><b>Short</b>\n one &lt;x&gt;.<div class="ad">Buy now, a very good offer for all of our readers today.</div><p>End.</article>
    <aside>{LONG}</aside><form>Name <input><select><option>x</select></form><div id="comments"><p>{LONG}</p></div><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == f"Head & line\n{LONG}\nShort one <x>.\nEnd."


def test_article_without_semantic_elements():
    page = f"<div class=menu><a href=x>Home</a><a href=y>News</a></div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div>"
    assert html_text.main_text(page) == f"{LONG}\nShort.\n{LONG}"


def test_names_are_hints():
    """Names of what else is on a page, or of what isn't, don't empty an article; comments go under other names too."""
    body = f"<p>{LONG}</p><p>{LONG}</p><p>Short end.</p>"
    want = f"{LONG}\n{LONG}\nShort end."
    for page in ('<body class="has-sidebar">%s</body>', '<body class="no-sidebar single">%s</body>', '<body class="cookie-free"><article>%s</article></body>', '<div class="entry-content social-ready">%s</div>',
                 '<article class="post share-on">%s</article>', '<article class="ad-free has-comments">%s</article>', '<div class="post widget">%s</div>', '<body class="sidebar"><main id="menu">%s</main></body>',
                 '<div class="widget"><article>%s</article></div>', '<div class="sidebar">%s</div>'):
        assert html_text.main_text(page % body) == want, page
    for name in ('id="responses"', 'class="reader-opinions"', 'class="comment-list"', 'id=comments', 'class="user-comments box"', 'class="sidebar-left"', 'class="ad-slot-2"'):
        assert html_text.main_text(f"<article>{body}</article><section {name}><p>{LONG}</p><p>{LONG}</p></section>") == want, name
        assert html_text.main_text(f"<article>{body}<div {name}><p>{LONG}</p></div></article>") == want, name


def test_cut_succeeds_where_a_threshold_fails():
    """A paragraph that is all link, and a bare word, are carried by their neighbours; the same link in a menu isn't."""
    page = f'<div><a href="/m">{LONG}</a></div><div><p>{LONG}</p><p><a href="/x">{LONG}</a></p><p>{LONG}</p><p>Word</p><p>{LONG}</p></div>'
    blocks = html_text.read_blocks(page)
    gain = [html_text.score(b) for b in blocks]
    assert [g > 0 for g in gain] == [False, True, False, True, False, True]
    assert html_text.source_side(gain, html_text.edges(blocks)) == [False, True, True, True, True, True]
    assert html_text.main_text(page) == "\n".join([LONG, LONG, LONG, "Word", LONG])


def test_broken_markup_never_raises():
    r = random.Random(5)
    for _ in range(500):
        html_text.main_text("".join(r.choice(["<", "p>", ">", "</", "div ", "a href='", '"', "&am", "&#xD800;", "<!--", "-->", "text word.", "<article>", "<script>", "</p>", "\0"]) for _ in range(50)))


def brute_cut(gain, edges):
    n = len(gain)
    cost = lambda m: sum(-min(0, g) if m >> i & 1 else max(0, g) for i, g in enumerate(gain)) + sum(c for a, b, c in edges if (m >> a & 1) != (m >> b & 1))
    return min(map(cost, range(1 << n))), cost


def test_cut_is_minimal():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 8)
        gain = [r.randint(-9, 9) for _ in range(n)]
        edges = [(r.randrange(n), r.randrange(n), r.randint(0, 6)) for _ in range(r.randint(0, 14))]
        edges = [e for e in edges if e[0] != e[1]]
        best, cost = brute_cut(gain, edges)
        assert cost(sum(1 << i for i, k in enumerate(html_text.source_side(gain, edges)) if k)) == best


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "v", f"<article><p>{LONG}</p></article>"), (2, "v", f"<article><p>{LONG}</p></article>"), (3, "w", "<article>" + f"<p>{LONG}</p>" * 3000)], PAGES).withColumn("text", F.lit(1))
    got = sorted(map(tuple, html_text.extract_text(df).collect()), key=repr)
    want = [(1, "u", "", 0), (None, None, "", 0), *[(2, "v", LONG, len(LONG))] * 2, (3, "w", "\n".join([LONG] * 3000), 3000 * (len(LONG) + 1) - 1)]
    assert got == sorted(want, key=repr)
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_url_rules_and_list(spark):
    url = ["https://WWW.Bad.net/a/?utm_source=x#f", "http://m.bad.net/a", "http://bad.net/b", None, "no scheme", "http://x.org", "http://x.org/", "https://a.example.org/es/1", "https://example.org/en/123", "http://shop.com/fr/1", "http://com/de/", "http://notcom.net/de/", "http://h?q#x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(url)] + [(2, url[2])], "page_id long, url string").withColumn("host", F.lit(0)).withColumn("key", F.lit(0))
    listed = spark.createDataFrame([("https://bad.net/a?ref=1",), (None,), ("junk",)], "url string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(df, listed, urls.RULES).collect()}
    assert len(got) == 13 and urls.judge_urls(df, listed, urls.RULES).count() == 14
    assert got[0] == ("www.bad.net", "/a/", None, "block") and got[1][3] == "block" and got[2][3] == "allow"
    assert got[3] == got[4] == ("", "", None, "allow") and got[5] == ("x.org", "", None, "allow") and got[6] == ("x.org", "/", "org/", "allow")
    assert got[7][2:] == ("example.org/es/", "block") and got[8][2:] == ("example.org/en/1", "block") and got[9][2:] == ("com/fr/", "allow") and got[10][2:] == ("com/de/", "block")
    assert got[11][2:] == (None, "allow") and got[12][:2] == ("h", "")
    assert urls.judge_urls(df.limit(0), listed, urls.RULES).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, listed.limit(0), []).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negative(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("k"))
    block, words = urls.bloom_words(F.col("k"))
    j = keys.select(block.alias("at"), *(w.alias(f"p{i}") for i, w in enumerate(words))).join(urls.bloom_filter(keys, "k"), F.col("at") == F.col("block"))
    for i in range(4):
        j = j.where(F.col(f"w{i}").bitwiseAND(F.col(f"p{i}")) == F.col(f"p{i}"))
    assert j.count() == 3000


def brute_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    g = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if g[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_rule_statistics():
    r = random.Random(2)
    for _ in range(2000):
        t = "".join(r.choice(["a", "b", "\n", " ", "#", "\x0b", "ab\nab\n", "\x85", "é"]) for _ in range(r.randint(0, 60)))
        assert quality.rule_statistics(t) == brute_rules(t), repr(t)
    assert quality.rule_statistics(None) == (0, 0, 0, 0, 0)


def test_forest_isolates_the_odd_row():
    r = np.random.default_rng(0)
    rows = np.concatenate([r.normal(size=(500, 2)), [[8.0, 8.0]]])
    s = quality.IsolationForest.fit(rows).score(rows)
    assert s.argmax() == 500 and s[500] > 0.65 > np.median(s)
    assert quality.calibrated([(0.5, 100, 0), (0.6, 0, 0), (0.8, 0, 7)], 25) == 0.7
    assert quality.calibrated([(0.5, 100, 0), (0.8, 1, 7)], 25) == float("inf")


def test_quality_rules(spark, docs):
    r = random.Random(3)
    text = lambda end="": " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) + end for _ in range(80))
    rows = [(i, text()) for i in range(200)] + [(i, text("%%%")) for i in range(200, 206)] + [(300, None), (301, ""), (302, "a b c " * 40), (None, text()), (5, "x y")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(200, 0, 0), (202, 0, 0), (0, None, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(rows)
    out = quality.quality_rules(df, labels)
    got = out.collect()
    assert len(got) == len(rows)
    by = {(g.doc_id, g.n_words): g for g in got if g.doc_id != 5}
    assert all(g.kept for (i, _), g in by.items() if i is None or i < 200) and not any(g.kept for (i, _), g in by.items() if i is not None and i >= 200)
    assert sum(g.base_failed for g in got) == 4
    passed = quality.quality_rules(df, labels, passing=True)
    assert passed.columns[:len(df.columns)] == df.columns and len(set(map(str.lower, passed.columns))) == len(passed.columns)
    odd = df.withColumns({"my col": F.lit(1), "a.b": F.lit("x"), "c,d": F.array(F.lit(1))}).withColumnRenamed("doc_id", "doc.id")
    again = quality.quality_rules(odd, labels.withColumnRenamed("doc_id", "doc.id"), id_col="doc.id", passing=True)
    assert sorted(again.select(again.columns[-1]).collect()) == sorted(passed.select(passed.columns[-1]).collect()) and again.columns[:len(odd.columns)] == odd.columns
    none = quality.quality_rules(df, labels.limit(0)).collect()
    assert all(g.kept != g.base_failed for g in none)
    assert quality.quality_rules(df.limit(0), labels).count() == 0


def test_lines(spark, docs):
    rows = [(i, f"menu of the site\nown text {i}\n\nfoot") for i in range(8)] + [(8, None), (9, ""), (10, "menu of the site"), (None, "x\n x\nmenu of the site ")] + [(20 + i, "a copy\nof it") for i in range(9)]
    df = docs(rows)
    out = lines.drop_lines(df)
    assert out.columns[:len(df.columns)] == df.columns
    got = {r["doc_id"]: (r["text"], r[-2], r[-1]) for r in out.collect()}
    assert got[0] == ("own text 0\n", 4, 2) and got[8] == (None, 0, 0) and got[9] == ("", 1, 0) and got[10] == ("", 1, 1)
    assert got[None] == ("x\n x\nmenu of the site ", 3, 0) and got[20] == ("a copy\nof it", 2, 0)
    shuffled, lines.BROADCAST_LINES = lines.BROADCAST_LINES, -1
    try:
        assert {r["doc_id"]: (r["text"], r[-2], r[-1]) for r in lines.drop_lines(df).collect()} == got
    finally:
        lines.BROADCAST_LINES = shuffled
    assert lines.drop_lines(df.limit(0)).count() == 0
    null_site = df.withColumn("source", F.lit(None).cast("string"))
    assert {r["doc_id"]: r["text"] for r in lines.drop_lines(null_site).collect()}[1] == "own text 1\n"


def test_licences(spark):
    rows = [(1, "a/LICENSE", "x\n" + licenses.TEMPLATES["MIT"]), (2, "a/b/c/f.py", "code"), (3, "a/b/LICENSE", licenses.TEMPLATES["GPL-3.0"]), (4, "z/f.py", "version 3 of it\nlicensed"), (5, "a/own.py", "# Licensed under the Apache License, Version 2.0."), (6, None, None), (7, "a/x.py", ""), (7, "a/x.py", ""), (8, "ab/x.py", "code")]
    df = spark.createDataFrame(rows, "id long, path string, text string").withColumn("license", F.lit(0)).withColumn("score", F.lit(0))
    got = sorted((tuple(r) for r in licenses.scan_licenses(df).select("id", "license", "how", "from_dir").collect()), key=repr)
    want = [(1, "MIT", "own", None), (2, "GPL-3.0", "inherited", "a/b"), (3, "GPL-3.0", "own", None), (4, None, None, None), (5, "Apache-2.0", "own", None), (6, None, None, None), *[(7, "MIT", "inherited", "a")] * 2, (8, None, None, None)]
    assert got == sorted(want, key=repr)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_archives(spark):
    rows = [(3, "http://a/\r\nX: y", "same"), (1, "u", "same"), (2, None, "é\r\n\r\nWARC/1.1\r\n\r\n"), (None, "v", "same"), (4, "w", None), (5, "w", ""), (6, "x", "long " * 50000), (1, "u", "same")]
    df = spark.createDataFrame(rows, PAGES).withColumn("bytes", F.lit(0)).withColumn("digest", F.lit(0))
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()

    def want(least):
        out = []
        for i, _, h in rows:
            same = [j for j, _, g in rows if j is not None and (g or "") == (h or "")]
            first = min(same, default=None)
            again = len((h or "").encode()) >= least and first is not None and i != first
            out.append((i, len((h or "").encode()), sha(h), "revisit" if again else "response", first if again else None))
        return sorted(out, key=repr)

    for least in (0, 3):
        folder = warc.write_archives(df, min_bytes=least, file_bytes=1 << 10)
        assert sorted(map(tuple, warc.read_archives(spark, folder).collect()), key=repr) == want(least)
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).count() == 0
