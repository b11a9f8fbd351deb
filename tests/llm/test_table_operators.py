"""Operators on tables of sizes, vectors, URLs and pages against brute force."""

import re

from pyspark.sql import functions as F

from tillroll.llm import catalog, mixing, urls, warc

SF = "/root/testdata/sf0.001"


def test_word_count(spark):
    texts = [None, "", " ", "a", " a  b\tc\n\n d\x0b\x0c\r", "\x1c q é", "\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.word_count(F.col("text")).alias("n"))
    assert all(r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows.collect())


def test_targets_by_repeated_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 300, "d": 5, None: 50}
    totals = spark.createDataFrame(list(sizes.items()), "source string, total bigint")
    got = {
        r["source"]: r["target"]
        for r in mixing.capped_targets(mixing.cycled_weights(totals, "source", (5, 2, 1)), "total", "weight", 3).collect()
    }
    order = ["a", "b", "c", "d", None]
    weight = dict(zip(order, (5, 2, 1, 5, 2)))
    left, open_, expected = float(sum(sizes.values())), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not above:
            break
        for s in above:
            expected[s] = 3.0 * sizes[s]
            left -= expected[s]
        open_ -= above
    expected |= {s: weight[s] * level for s in open_}
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in order)


def test_mix_comes_near_targets_and_reruns_agree(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "w " * (1 + i * 37 % 90)) for i in range(1500)] + [(9000, "s1", None), (9001, "s1", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("g", F.lit("x")).repartition(5)
    first = mixing.balanced_mix(docs, key=F.col("doc_id")).collect()
    again = mixing.balanced_mix(docs.repartition(2), key=F.col("doc_id")).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in first) == sorted((r["doc_id"], r["copies"]) for r in again)
    for source in {r["source"] for r in first}:
        own = [r for r in first if r["source"] == source]
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - own[0]["target"]) <= 0.01 * own[0]["target"] + 1
        assert all(0 <= r["copies"] <= 3 and abs(r["copies"] - r["rate"]) < 1.001 for r in own)
    assert {r["size"] for r in first if r["doc_id"] >= 9000} == {0}


def test_url_rules_and_verdicts(spark):
    cases = [
        (1, "https://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/"),
        (2, "http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/"),
        (3, "http://notexample.com/en/1", "notexample.com", "/en/1", "com/"),
        (4, "http://x.net/es/9", "x.net", "/es/9", "net/es/"),
        (5, "http://x.com", "x.com", "", None),
        (6, "x.com/en/", "", "", None),
        (7, None, "", "", None),
        (8, "a://b?://c/d", "b", "", None),
    ]
    df = spark.createDataFrame([(i, u) for i, u, *_ in cases], "page_id bigint, url string")
    got = {r["page_id"]: r for r in urls.judge(df, catalog.RULES).collect()}
    for i, _, host, path, rule in cases:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block")
    assert got[1]["verdict"] == "allow" and got[2]["verdict"] == "block"
    assert urls.judge(df.limit(0), catalog.RULES).count() == 0


def test_url_trees_learn_held_out_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    labelled = pages.withColumn("label", (urls.matching_rule(host, path, catalog.RULES)[1] == "block").cast("int")).where("label is not null")
    model = urls.fit(labelled.where("page_id % 4 <> 2"))
    out = urls.predict(labelled.where("page_id % 4 = 2"), model).collect()
    assert sum((r["block_score"] > 0.5) == bool(r["label"]) for r in out) >= 0.8 * len(out)


def test_url_shares_count_all_labelled_urls(spark):
    rows = [(f"http://h{i}.s{i}.t{i % 3}/a/{j}", int(i % 4 == 0)) for i in range(60) for j in range(3)]
    model = urls.fit(spark.createDataFrame(rows, "url string, label int"), sample_rows=40, trees=2)
    assert model.overall == sum(b for _, b in rows) / len(rows)
    got = {(r["kind"], r["key"]): r["share"] for r in model.shares.collect()}
    assert sum(k == "site" for k, _ in got) == 60
    for i in range(60):
        expected = (3 * (i % 4 == 0) + urls.PRIOR_ROWS * model.overall) / (3 + urls.PRIOR_ROWS)
        assert abs(got["site", f"s{i}.t{i % 3}"] - expected) < 1e-12


def test_url_sample_ranks_few_rows(spark):
    known = spark.range(20_000).selectExpr("concat('http://a/', id) AS url", "cast(id % 5 = 0 as int) AS _label")
    hashed = known.select("url", "_label", F.xxhash64("url").alias("h")).collect()
    least = {r["url"] for b in (0, 1) for r in sorted((r for r in hashed if r["_label"] == b), key=lambda r: r["h"])[:100]}
    assert {r["url"] for r in urls._sample(known, (16_000, 4_000), 100).collect()} == least
    passed = sum(r["h"] < int(300 / 16_000 * 2**64) - 2**63 for r in hashed if r["_label"] == 0)
    assert known.where("_label = 0").where(urls._least_hashed(300 / 16_000)).count() == passed < 600


def test_url_shares_reach_rows_of_hot_and_rare_keys(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://a.s{i % 9 if i % 2 else 0}.com/x") for i in range(200)] + [(900, None)], "page_id bigint, url string")
    shares = spark.createDataFrame([("site", f"s{i}.com", i / 10) for i in range(5)], "kind string, key string, share double")
    for parts in (10_000, 5):  # all keys hot; one of them
        monkeypatch.setattr(urls, "HOT_PARTS", parts)
        out = urls._with_shares(pages, "url", shares, 0.75).select("_row.*", "_s_site", "_s_suffix").collect()
        assert len(out) == 201
        for r in out:
            site = r["url"] and int(r["url"].split(".")[1][1:])
            assert r["_s_site"] == (site / 10 if site is not None and site < 5 else 0.75) and r["_s_suffix"] == 0.75


def test_warc_records_link_back(spark):
    html = "<html lang='de'><head><title>A &amp; B</title><script>x<y</script></head><body><p>eins&#33; &lt;b&#x3e;</p><!-- c --><a href='/u?a=1&amp;b=2'>zwei</a><br>drei  vier</body></html>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None)], "page_id bigint, url string, html string")
    source = {r["source_key"]: r for r in warc.responses(pages).collect()}
    rows = {(r["source_key"], r["warc_type"]): r for r in warc.derive(warc.responses(pages)).collect()}
    assert len(rows) == 4 and len({r["record_id"] for r in rows.values()}) == 4
    for (key, _), r in rows.items():
        assert r["refers_to"] == source[key]["record_id"] and f"WARC-Refers-To: {r['refers_to']}" in r["header"]
        assert r["source_payload_digest"] == source[key]["payload_digest"]
        assert r["content_length"] == len(r["block"].encode())
    assert rows[1, "conversion"]["block"] == "A & B\neins! <b>\nzwei\ndrei vier"
    assert rows[1, "metadata"]["block"] == "title: A & B\r\nlanguage: de\r\noutlinks: 1\r\noutlink: /u?a=1&b=2"
    assert rows[2, "conversion"]["block"] == "" and "Target-URI" not in rows[2, "conversion"]["header"]


def test_warc_cells_entities_and_links(spark):
    cases = [
        ("<table><tr><td>12</td><td>34</td></tr><tr><th>a<th>b</table>", "12 34\na b", []),
        ("<dl><dt>x</dt><dd>y</dd></dl><main>m</main><aside>n</aside><select><option>1<option>2</select>", "x\ny\nm\nn\n1\n2", []),
        ("<figure>f<figcaption>c</figcaption></figure><b>in</b>line<form>g</form>", "f\nc\ninline\ng", []),
        ("caf&eacute; &uuml;&ntilde; &amp;lt; &nosuch; &NotEqualTilde; &#233; R&D; & Co", "café üñ &lt; &nosuch; ≂̸ é R&D; & Co", []),
        ("<a href=/u/1>a</a><a class=x href = \"it's\">b</a><a data-href='n' href='say \"q\"'>c</a>", "abc", ["/u/1", "it's", 'say "q"']),
        ("<a href='/x?a=1&amp;b=&eacute;'>a</a><a\nhref=\"/l\nine\">b</a><a name=z>c</a><a HREF=''>d</a>", "abcd", ["/x?a=1&b=é", "/line", ""]),
    ]
    pages = spark.createDataFrame([(i, "http://a/", h) for i, (h, *_) in enumerate(cases)], "page_id bigint, url string, html string")
    rows = {(r["source_key"], r["warc_type"]): r["block"] for r in warc.derive(warc.responses(pages)).collect()}
    for i, (_, text, links) in enumerate(cases):
        assert rows[i, "conversion"] == text
        assert rows[i, "metadata"].split("\r\n")[2:] == [f"outlinks: {len(links)}", *[f"outlink: {x}" for x in links]]
