import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryweb.llm import jaccard
from quarryweb.llm.jaccard import Similarity, components, deduplicate, near_duplicates, op4_ngram_jaccard_join, representative_links

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), len(s), str(i if not s else least.get(root(k)))) for k, (i, s) in enumerate(sets))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op4_ngram_jaccard_join(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize(("short", "hot"), [(4, 1000), (16, 6), (1000, 1000), (4, 0)])
def test_edited_copies_chains_and_odd_rows(spark, monkeypatch, short, hot):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "HOT", hot)
    rnd = random.Random(4)
    base = [rnd.choice("abcdefghij") * rnd.randint(1, 3) + str(rnd.randint(0, 300)) for _ in range(120)]
    rows, i = [], 100
    for edits in [0, 0, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 7, 8] * 3:
        w = list(base)
        for _ in range(edits):
            w[rnd.randrange(len(w))] = f"edit{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(w).upper() if rnd.random() < 0.3 else "\t".join(w)))
        i -= 1
    chain = list(base[::-1])
    for k in range(12):  # each is near the one before, the ends are far apart
        rows.append((1000 + k, " ".join(chain)))
        chain[k * 9] = f"link{k}"
    rows += [(5000, ""), (5001, None), (5002, "   \n"), (5003, "one two"), (5004, "One TWO"), (5005, "one two three four five"), (7, "one two"), (None, "one two"), (None, "only null id here now"), (7, "one two"), (5006, "é É ÀÁ"), (5007, "é é ÀÁ"), (6000, "long " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("component_id", F.lit("x")).repartition(5)
    assert got(near_duplicates(df)) == brute(rows)
    kept = deduplicate(df)
    assert kept.columns == df.columns
    want = Counter((r.doc_id, r.text) for r in df.collect() if not shingles(r.text))
    for rows_of in groups([(r.doc_id, r.text) for r in df.collect()]):
        least = min((i for i, _ in rows_of if i is not None), default=None)
        want[next((i, t) for i, t in rows_of if i == least)] += 1
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert left == want or {i for i, _ in left} == {i for i, _ in want} and left.total() == want.total()
    assert near_duplicates(df.limit(0)).count() == 0 and deduplicate(df.limit(0)).count() == 0


def groups(rows):
    """Lists of rows of each component, by brute force."""
    sets = [(i, t, shingles(t)) for i, t in rows if shingles(t)]
    out = []
    for row in sets:
        near = [g for g in out if any(100 * len(row[2] & x[2]) >= 75 * len(row[2] | x[2]) for x in g)]
        out = [g for g in out if not any(g is x for x in near)] + [[row, *(x for g in near for x in g)]]
    return [[(i, t) for i, t, _ in g] for g in out]


def test_deduplicate_keeps_one_row_of_a_group_whatever_its_ids(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    near = text + " more"
    rows = [(3, text), (3, near), (3, text), (None, text), (9, near), (None, "only null here and nothing else"), (None, "only null here and nothing else"), (1, ""), (1, ""), (None, None)]
    left = sorted((str(r.doc_id), r.text) for r in deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.text)
    assert left[1:] == [("None", "only null here and nothing else")] and left[0][0] == "3" and left[0][1] in (text, near)
    assert deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5


def test_many_null_ids_and_a_shared_shingle_of_unrelated_documents(spark, monkeypatch):
    pairs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.expr("concat(array_join(transform(sequence(1, 40), x -> concat('p', id div 2, 'w', x)), ' '), ' end', id % 2)").alias("text"))
    found = near_duplicates(pairs)
    assert found.where("component_id is null and n_shingles = 37").count() == 5000
    assert deduplicate(pairs).count() == 2500
    # Half of each document's few shingles are shared with all others, in the rarest place.
    apart = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("concat('a b c d e ', id div 2, ' x', id)").alias("text"))
    rows = near_duplicates(apart).collect()
    assert len(rows) == 3000 and all(r.component_id == r.doc_id for r in rows)


def test_many_near_copies_move_in_proportion_to_the_input(spark, monkeypatch):
    rows = {}

    def counted(df, name, real=jaccard.written):
        out = real(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(60, 90))) for _ in range(100)]
    docs = spark.createDataFrame([(1000 * k + i, f"{t} and copy number{k}" if k else t) for i, t in enumerate(texts) for k in range(12)], "doc_id long, text string").repartition(3)
    assert all(r.component_id == r.doc_id % 1000 for r in near_duplicates(docs).collect())
    assert rows["jaccard-lists"] <= 1.5 * rows["jaccard-postings"]
    # Each text is compared about once, though any two of a dozen are alike.
    assert rows["jaccard-near"] <= 3 * docs.count() and rows["jaccard-links"] <= docs.count()


def test_sketches_never_tell_like_sets_apart():
    rnd, sim = random.Random(2), Similarity()
    for n in [1, 2, 5, 31, 64, 65, 100, 127, 128, 129, 300, 1000]:
        for m in {n, max(1, n * 3 // 4), n + 1, n * 4 // 3}:
            both = rnd.sample(range(1 << 62), n + m)
            for shared in {min(n, m), min(n, m, sim.overlap(n, m)), 0}:
                a, b = set(both[:n]), set(both[:shared] + both[n : n + m - shared])
                x, y = (jaccard.sketch(np.array(sorted(v), np.uint64)) for v in (a, b))
                assert jaccard.differ(x, y) == jaccard.differ(y, x) <= len(a ^ b)
                assert sim.may_link(n, x, m, y) or 100 * len(a & b) < 75 * len(a | b)


def test_links_are_true_and_join_every_component(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    links = [tuple(r) for r in representative_links(docs).collect()]
    assert links and all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and a < b for a, b in links)
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    first = {}
    for d, s in sorted(sets.items()):
        first.setdefault(frozenset(s) if s else d, d)
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        if a != b:
            parent[b] = a
    want = {d: root(first[frozenset(s)]) if s else d for d, s in sets.items()}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 500)]
    random.Random(0).shuffle(edges)
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def test_ordered_paths_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(jaccard, "written", lambda df, name, real=jaccard.written: rounds.append(name) or real(df, name))
    links = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(links).agg(F.max("label"), F.count("*")).first() == (0, 1001)
    assert sum(n.endswith("-step") for n in rounds) <= 2 * math.log2(1001)


def test_similarity_bounds():
    sim = Similarity()
    for a in range(1, 40):
        for b in range(1, 40):
            for shared in range(min(a, b) + 1):
                assert (100 * shared >= 75 * (a + b - shared)) == (shared >= sim.overlap(a, b))


def test_edited_copies_move_their_texts_a_few_times(spark, monkeypatch):
    """Copies with other words here and there are linked with the first text, but not with each other, and share lists that many of them lead."""
    r, rows = random.Random(5), []
    for g in range(4):
        words = [f"w{g}_{i}" for i in range(400)]
        rows.append((g * 100, " ".join(words)))
        for k in range(1, 24):
            rows.append((g * 100 + k, " ".join(f"q{g}_{k}_{i}" if r.random() < 1 / 45 else w for i, w in enumerate(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    moved, compare = [], jaccard._compare
    monkeypatch.setattr(jaccard, "_compare", lambda units, *a: moved.append(units.count()) or compare(units, *a))
    found = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(396)} for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    assert found == label
    assert sum(moved) <= 4 * len(rows)


def test_many_unlinked_texts_that_sketches_do_not_tell_apart_give_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = []

    def counted(df, name, real=jaccard.written):
        out = real(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    r, texts = random.Random(7), []
    for i in range(60):  # any two differ in 60 of 196 shingles or a few less, linked ones in 56 at most
        places = {10 + 60 * k + 5 * r.randrange(11) for k in range(3)}
        texts.append((i, " ".join(f"own{i}_{k}" if k in places else f"w{k}" for k in range(200))))
    found = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert got(found) == brute(texts)
    names = [name for name, _ in rows]
    met = [n for name, n in rows[names.index("jaccard-units") :] if name == "jaccard-apart"]
    assert met and max(met) <= 2 * len(texts)


def test_texts_are_fetched_without_a_join(spark, monkeypatch):
    plans = {}

    def seen(df, name, real=jaccard.written):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return real(df, name)

    monkeypatch.setattr(jaccard, "written", seen)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("concat(array_join(transform(sequence(1, 60), x -> concat('p', id % 20, 'w', x)), ' '), ' copy', id)").alias("text"))
    assert deduplicate(docs).count() == 20
    assert plans["jaccard-texts"] == 1
