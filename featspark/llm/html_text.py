"""Main text of HTML pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A node is a block element or a text block. Its features are its kind and its parent's, attribute tokens of
itself and its ancestors, depth, text, link and punctuation density of its subtree, position and sibling
statistics. The trees give each node the log-odds of leading to main text. Decoding takes the choice of nodes
with the largest sum in which every chosen node lies inside chosen ancestors, so an ancestor and its
descendants never contradict each other.

No page is labelled, so the trees are fitted under distant supervision on a bounded, documented sample
(``sample`` expected pages, chosen by a hash of the identifier): pages with an article or main element label
themselves, and their paragraphs are set into pages of varied make-up (other wrappers and attribute names,
side bars, notices, forms, comments) whose labels are known by construction.

Defined results: null or empty html has the empty text; text outside any element counts as a block of the page;
unclosed and stray tags are tolerated; broken character references stay as they are; rows are independent.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .boosting import BoostedTrees
from .common import map_rows

LEFT_OUT = {"nav", "aside", "footer", "form", "header", "button", "label"}


def labelled(html: str) -> tuple[list[dom.Node], list[bool]] | None:
    """Nodes and labels of a page that marks its main text itself: an element with the attribute ``data-main``
    inside constructed pages, else article or main; boilerplate elements inside it are left out."""
    nodes = dom.summarize(dom.parse(html))
    marked = "data-main" in html
    inside, good = {}, {}
    for x in nodes:
        up = inside.get(id(x.parent), False)
        if "data-side" in x.attr:
            inside[id(x)] = False
        elif marked:
            inside[id(x)] = up or "data-main" in x.attr
        else:
            inside[id(x)] = (up or x.tag in ("article", "main")) and x.tag not in LEFT_OUT
    for x in reversed(nodes):
        own = x.tag == "#text" and inside[id(x)]
        good[id(x)] = good.get(id(x), False) or own
        if good[id(x)] and x.parent is not None:
            good[id(x.parent)] = True
    if not any(good.values()):
        return None
    for x in nodes:
        x.attr = ""
    return nodes, [good[id(x)] for x in nodes]


def constructed(texts: list[str], rng: random.Random) -> str:
    """A page of random make-up around some of the texts."""
    words = " ".join(rng.choice(texts) for _ in range(6)).split()

    def some(a, b):
        n = rng.randint(a, b)
        at = rng.randrange(max(1, len(words) - n))
        return " ".join(words[at:at + n])

    def links(n):
        return "".join(f"<li><a href='/{i}'>{some(1, 3)}</a></li>" for i in range(n))

    def side(kind):
        names = {"nav": ["nav", "menu", "navbar", "navigation", "breadcrumbs"], "ad": ["ad", "ads", "advert", "sponsored", "promo", "banner"], "notice": ["notice", "cookie-consent", "cookies", "popup"], "side": ["sidebar", "widget", "related", "popular"],
                 "comments": ["comments", "comment-list", "respond"], "share": ["share", "social", "tags"], "foot": ["footer", "copyright", "site-footer"], "head": ["header", "masthead", "topbar"], "form": ["search", "newsletter", "subscribe", "login"]}[kind]
        tag = {"nav": "nav", "side": "aside", "foot": "footer", "head": "header", "form": "form", "comments": "section"}.get(kind, "div")
        tag, name = (tag, rng.choice(["", f" class='{rng.choice(names)}'"])) if tag != "div" and rng.random() < 0.5 else (rng.choice(["div", "section"]) if kind != "form" else "form", f" {rng.choice(['class', 'id'])}='{rng.choice(names)}'")
        body = {"nav": lambda: f"<ul>{links(rng.randint(3, 9))}</ul>", "ad": lambda: rng.choice(["{}", "<p>{}</p>", "<a href='x'>{}</a>"]).format(some(2, 25)), "notice": lambda: f"<p>{some(5, 25)}</p><button>{some(1, 2)}</button>",
                "side": lambda: f"<h3>{some(1, 4)}</h3>" + rng.choice([f"<ul>{links(rng.randint(3, 7))}</ul>", f"<p>{some(5, 40)}</p>"]), "comments": lambda: f"<h3>{some(1, 3)}</h3>" + "".join(rng.choice(["<div class='comment'><p>{}</p></div>", "<li>{}</li>", "<p>{}</p>"]).format(some(3, 50)) for _ in range(rng.randint(1, 6))),
                "share": lambda: f"<ul>{links(rng.randint(2, 5))}</ul>", "foot": lambda: f"&copy; {some(2, 14)} <a href='x'>{some(1, 3)}</a>", "head": lambda: f"<a href='/'>{some(1, 3)}</a><p>{some(1, 8)}</p>", "form": lambda: f"<label>{some(1, 3)}</label><input><button>{some(1, 2)}</button>"}[kind]()
        return f"<{tag}{name} data-side>{body}</{tag}>"

    def block():
        k = rng.random()
        if k < 0.72:
            return f"<p>{some(1, rng.choice([4, 30, 150]))}{rng.choice(['.', ''])}</p>"
        if k < 0.8:
            return f"<h2>{some(1, 6)}</h2>"
        if k < 0.86:
            return "<ul>" + "".join(f"<li>{some(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if k < 0.9:
            return f"<blockquote><p>{some(5, 30)}</p></blockquote>"
        if k < 0.94:
            return "<table>" + "".join(f"<tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>"
        return f"<div>{some(10, 80)}</div>"

    parts = [f"<h1>{some(2, 9)}</h1>", *(block() for _ in range(rng.choice([1, 2, 4, 8, 16])))]
    for kind in ("ad", "share", "comments", "form", "notice"):
        if rng.random() < 0.2:
            parts.insert(len(parts) if kind in ("comments", "share") else rng.randint(1, len(parts)), side(kind))
    tag, attr = rng.choice([("article", ""), ("article", " class='post'"), ("main", ""), ("div", " class='content'"), ("div", " id='main-content'"), ("div", " class='post entry'"), ("section", " class='story'"), ("div", ""), ("div", " class='article-body'")])
    page = [f"<{tag}{attr} data-main>{''.join(parts)}</{tag}>"]
    for kind, chance in (("notice", 0.3), ("ad", 0.5), ("form", 0.25), ("nav", 0.8), ("head", 0.4)):
        if rng.random() < chance:
            page.insert(0, side(kind))
    for kind, chance in (("side", 0.4), ("ad", 0.3), ("comments", 0.3), ("form", 0.2), ("nav", 0.2), ("foot", 0.85)):
        if rng.random() < chance:
            page.append(side(kind))
    inner = "".join(page)
    if rng.random() < 0.4:
        inner = f"<div class='{rng.choice(['wrapper', 'container', 'row', 'page'])}'>{inner}</div>"
    return f"<html><head><title>x</title></head><body>{inner}</body></html>"


DEFAULT_TEXT = "plain words stand here so that pages can be made when no page of the table marks its article"


def fit(htmls: list[str], made: int = 300, seed: int = 11) -> BoostedTrees:
    """Trees from self-labelled pages and ``made`` constructed ones."""
    rng, known, texts = random.Random(seed), [], []
    for h in htmls:
        got = labelled(h)
        if got:
            known.append(got)
            texts += [x.text for x, ok in zip(*got) if ok and x.tag == "#text"]
    texts = texts or [DEFAULT_TEXT]
    known += [got for _ in range(made) if (got := labelled(constructed(texts, rng)))]
    x = np.array([row for nodes, _ in known for row in dom.features(nodes)], float)
    y = np.array([ok for _, labels in known for ok in labels], float)
    weight = np.array([(3.0 if n.tag == "#text" else 1.0) for nodes, _ in known for n in nodes])
    return BoostedTrees.fit(x, y, weight)


def main_texts(htmls: list[str | None], model: BoostedTrees) -> list[str]:
    trees = [dom.summarize(dom.parse(h)) if h else None for h in htmls]
    rows = [r for t in trees if t for r in dom.features(t)]
    odds = model.log_odds(np.array(rows, float)).tolist() if rows else []
    out, at = [], 0
    for t in trees:
        if t is None:
            out.append("")
            continue
        out.append("\n".join(x.text for x in dom.decode(t, odds[at:at + len(t)])))
        at += len(t)
    return out


def extract(pages: DataFrame, sample: int = 150, made: int = 300) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("html"), "page_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter("page_id is not null and html is not null").filter(draw < float(sample) / max(1, n)).select("page_id", "html").collect()  # about ``sample`` pages
    model = fit([r.html for r in sorted(chosen, key=lambda r: (r.page_id, r.html))], made)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        text = main_texts(b["html"].to_pylist(), model)
        return pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_rows(rows, run, "page_id long, url string, text string, n_chars long", rows=64)
