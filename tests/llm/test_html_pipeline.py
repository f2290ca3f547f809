"""HTML extraction on known pages, hierarchical decoding against all choices, and the pipeline as a whole."""

import random
import re
from html import unescape
from itertools import product

import numpy as np

import corpus_pipeline
from featspark.llm import bpe_split, dom, exact_dedup, html_text, line_crf, mix_sources, prob_minhash

SF = "/root/testdata/sf0.001"


def gold(html):
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == gold(r.html) and got[r.page_id].url == r.url and got[r.page_id].n_chars == len(gold(r.html))


def test_constructed_pages():
    rng = random.Random(77)
    texts = ["The river runs past the old mill, where people met each summer. They told long stories and sang.", "A second paragraph of plain words follows here; it has its own commas, and an end.", "Short one."]
    model = html_text.fit([], made=300)
    hit = made = known = 0
    for _ in range(120):
        page = html_text.constructed(texts, rng)
        nodes, labels = html_text.labelled(page)
        want = [n.text for n, ok in zip(nodes, labels) if ok and n.tag == "#text"]
        got = html_text.main_texts([page.replace(" data-main", "").replace(" data-side", "")], model)[0].split("\n")
        both = sum(min(want.count(x), got.count(x)) for x in set(want))
        hit, made, known = hit + both, made + len(got), known + len(want)
    assert hit / made > 0.93 and hit / known > 0.93


def texts(html):
    return [x.text for x in dom.ordered(dom.parse(html)) if x.tag == "#text"]


def test_parsing():
    assert texts("<p>a &amp; b&nbsp;c<p>d<br>e</p>f") == ["a & b c", "d e", "f"]
    assert texts("<div>x<script>var a='</p>'; if (a<b) {}</script>y<!-- <p>no</p> --></div>") == ["x", "y"]
    assert texts("<ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table>") == ["one", "two", "1", "2", "3"]
    assert texts("a < b and <i>c</i>d <div class='x' title=\"1>2\">e") == ["a < b and cd", "e"]
    assert texts("") == [] and texts("<") == ["<"] and texts("<div") == [] and texts("&am &lt;p&gt; &#x41;") == ["&am <p> A"]
    deep = "<div>" * 3000 + "end"
    assert texts(deep) == ["end"]


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(5)
    for _ in range(40):
        nodes = [dom.Node("html", None)]
        for i in range(int(rng.integers(2, 9))):
            nodes.append(dom.Node("#text" if rng.random() < 0.5 else "div", nodes[int(rng.choice([k for k, n in enumerate(nodes) if n.tag != "#text"]))]))
        nodes = dom.ordered(nodes[0])
        odds = rng.normal(size=len(nodes)).tolist()
        place = {id(n): k for k, n in enumerate(nodes)}
        best = max((sum(o for o, v in zip(odds[1:], y) if v), y) for y in product((0, 1), repeat=len(nodes) - 1)
                   if all(not v or n.parent is nodes[0] or y[place[id(n.parent)] - 1] for n, v in zip(nodes[1:], y)))
        got = dom.decode(nodes, list(odds))
        assert [id(n) for n in got] == [id(n) for n, v in zip(nodes[1:], best[1]) if v and n.tag == "#text"]


def test_extract_edges(spark):
    rows = [(1, None, None, 1), (2, "u", "", 1), (3, "u", "<html><body><article><p>" + "long text, really. " * 20000 + "</p></article></body></html>", 1), (None, "u", "<p>x</p>", 1), (4, "u", "<article><p>same</p></article>", 1), (4, "u", "<article><p>same</p></article>", 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == by[2].text == "" and by[1].n_chars == 0 and by[3].n_chars == len(("long text, really. " * 20000).strip())
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.stash(stage(spark, seen[-1], SF)))
    raw, good, distinct, apart, mixed, out = seen
    assert all(d.columns == docs.columns for d in seen[:-1]) and out.count() == mixed.count()
    verdict = line_crf.line_quality(raw, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in verdict.collect())
    assert {r.doc_id for r in distinct.collect()} == {r.doc_id for r in exact_dedup.exact_duplicates(good).filter("kept").collect()}
    assert {r.doc_id for r in apart.collect()} == {r.doc_id for r in prob_minhash.near_duplicates(distinct).filter("kept").collect()}
    copies = {r.doc_id: r.copies for r in mix_sources.mix(apart).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    assert out.filter("not exact").count() == 0 and bpe_split.decode(out).count() == out.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in whole.collect()) == sorted((r.doc_id, r.n_tokens) for r in out.collect())


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string"
    odd = spark.createDataFrame([(None, None, None, None, None, None), (1, "", "en", None, 0, "x"), (2, "word and other words here " * 3000, None, "a", 5, None), (2, "word and other words here " * 3000, None, "a", 5, None), (3, " ".join(f"t{i}" for i in range(90)), "en", "b", 9, "y")], schema)
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, SF)
            n = got.count()
            assert n <= 3 * table.count() and (name == "bpe_tokens" or got.columns == table.columns)
