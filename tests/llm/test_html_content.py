import html as H
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryweb.html import parse
from quarryweb.llm.html_content import MARK, blocks, extract_main_text, features, forest_marginals, labelled_pages, marginals, op7_html_extraction, trained


def test_messages_equal_enumeration():
    rnd = random.Random(0)
    for _ in range(20):
        n = rnd.randint(1, 7)
        parent = [-1] + [rnd.randrange(i) for i in range(1, n)]
        score, pair = [rnd.gauss(0, 2) for _ in range(n)], [[rnd.gauss(0, 1) for _ in range(2)] for _ in range(2)]
        weight = {y: math.exp(sum(s * v for s, v in zip(score, y, strict=True)) + sum(pair[y[parent[i]]][y[i]] for i in range(1, n))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(weight.values())
        belief, pairs = marginals(score, parent, pair)
        assert np.allclose(belief, [sum(w for y, w in weight.items() if y[i]) / z for i in range(n)])
        want = np.zeros((2, 2))
        for y, w in weight.items():
            for i in range(1, n):
                want[y[parent[i]], y[i]] += w / z
        assert np.allclose(pairs, want)


def test_many_trees_at_once_equal_one_by_one():
    rnd, rng = random.Random(2), np.random.default_rng(2)
    pair = rng.normal(size=(2, 2))
    scores, parents, depths, beliefs, total = [], [], [], [], np.zeros((2, 2))
    for _ in range(30):
        n = rnd.randint(1, 40)
        parent = [-1] + [rnd.randrange(i) for i in range(1, n)]
        score = (rng.normal(size=n) * 3).tolist()
        belief, pairs = marginals(score, parent, pair.tolist())
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        parents += [max(p, 0) + len(scores) for p in parent]
        scores, depths, beliefs, total = scores + score, depths + depth, beliefs + belief, total + pairs
    levels = [np.flatnonzero(np.array(depths) == d) for d in range(max(depths) + 1)]
    belief, pairs = forest_marginals(np.array(scores), np.array(parents), levels, pair)
    assert np.allclose(belief, beliefs) and np.allclose(pairs, total)


def test_held_out_pages():
    model, right, n = trained(), 0, 0
    for page in labelled_pages(100, seed=77):
        nodes, runs = blocks(parse(page))
        belief, _ = marginals((features(nodes, runs) @ model.weights).tolist(), [b.parent for b in nodes], model.pair)
        right += sum((belief[at] >= 0.5) == (MARK in nodes[at].element.attrs) for at, _ in runs)
        n += len(runs)
    assert right / n > 0.99


def article(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1].replace("<br>", " ")
    parts = [re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:h1|p)>", inner)]
    return "\n".join(p for p in parts if p)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    rows = op7_html_extraction(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_pages(spark):
    body = "".join(f"<p>This is paragraph number {i} of the long article, and it says something.</p>" for i in range(3000))
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    rows = [(1, None), (2, ""), (3, "   "), (4, f"<nav><a href=/>x</a></nav><article>{body}</article><footer>f</footer>"), (4, f"<nav><a href=/>x</a></nav><article>{body}</article><footer>f</footer>"), (None, "<script>var a = 1</script>"), (5, deep), (6, "<article><p>a &lt;b&gt;\n  &amp;c<br>d&nbsp;e</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(7)).withColumn("element", F.lit("q"))
    got = extract_main_text(df)
    assert got.columns == ["page_id", "html", "text", "element"]
    texts = [r.text for r in got.collect()]
    assert texts[:3] == ["", "", ""] and texts[3] == texts[4] and texts[3].count("\n") == 2999 and texts[5] == "" and texts[7] == "a <b> &c d e"
    assert extract_main_text(df.limit(0)).count() == 0


def test_formulas_and_drawn_text_stay():
    page = "<html><body><article><p>Words before <math><mrow><mi>xq</mi><mo>+</mo><mn>17</mn></mrow></math> and <svg><style>.k{}</style><g><text>Drawn label</text></g></svg> after it.</p></article></body></html>"
    _, runs = blocks(parse(page))
    assert " ".join(text for _, text in runs) == "Words before xq+17 and Drawn label after it."
