import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from quarryweb.llm import decontaminate
from quarryweb.llm.decontaminate import find_contamination, op6_decontamination, remove_contamination
from quarryweb.llm.fingerprint import containment, distinct_shingles, merge, merge_groups, op5_fingerprints, resemblance, sketch, with_next

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_hits(text, items):
    words, hit, ids = item_words(text), set(), set()
    for item_id, item in items:
        w = item_words(item)
        size = min(10, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                ids.add(item_id)
    return len(words), len(hit), sorted(map(str, ids))


@pytest.mark.parametrize("sent", [50_000, 0])
def test_contamination_equals_brute_force(spark, sent, monkeypatch):
    monkeypatch.setattr(decontaminate, "SENT_WINDOWS", sent)
    item = "One two, three four five six seven eight nine ten eleven twelve"
    items = [(1, item), (2, "short ITEM é"), (3, None), (4, "..."), (10, item + " more"), (None, "null id item")]
    texts = [item, f"x {item} y {item}", "the short item é here", "short item e", "", None, "two three four five six seven eight nine ten", item.replace(",", " -- "), "short item é short item é", "w " * 30_000 + item]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)] + [(0, item, 1, "q"), (None, item, 1, "q")], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = find_contamination(docs, bench).collect()
    want = sorted((str(r.doc_id), *brute_hits(r.text, [x for x in items if x[0] is not None])) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in rows) == want
    left = remove_contamination(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    cut = {r.doc_id: r.text for r in remove_contamination(docs, bench, remove="spans").collect()}
    assert cut[1] == "x y " and cut[2] == "the here" and cut[5] is None and cut[6] == texts[6] and cut[9].strip(" w") == ""
    assert find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert find_contamination(docs.limit(0), bench).count() == 0


def test_large_benchmark_is_looked_up_without_a_shuffle_of_windows(spark):
    """More than 200,000 windows; only hits and one row for each document are shuffled."""
    items = spark.range(20).select(F.col("id").alias("item_id"), F.expr("array_join(transform(sequence(1, 10100), x -> concat('w', id * 20000 + x)), ' ')").alias("text"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("concat(repeat('clean words here ', 200), if(id % 10 = 0, 'w20005 w20006 w20007 w20008 w20009 w20010 w20011 w20012 w20013 w20014 w20015', 'end'))").alias("text"))
    found = find_contamination(docs, items)
    rows = {r.doc_id: (r.n_hit, list(r["items"])) for r in found.collect()}
    assert rows == {i: (11, ["1"]) if i % 10 == 0 else (0, []) for i in range(300)}
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_op6_whole_table(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op6_decontamination(spark, sf_dir).collect():
        n, hit, ids = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)


def x64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed % 2**64)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_sketch(text, k=128):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate(LOW)) if w]
    hashes = [signed(x64(w.encode())) for w in words]
    runs = [hashes[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [hashes] if words else []

    def chain(run):
        seed = 42
        for h in run:
            seed = x64(struct.pack("<q", h), seed)
        return signed(seed)

    return sorted({chain(r) for r in runs})[:k]


def brute_near(a, b, k=128):
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def test_op5_equals_brute_force(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op5_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, (d, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e, b = brute_sketch(text), brute_sketch(edited), brute_sketch(after)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x % 2**64:016X}" for x in a) and r.edited_fingerprint == "".join(f"{x % 2**64:016X}" for x in e)
        assert r.near_edited == pytest.approx(brute_near(a, e)) and r.near_next == pytest.approx(brute_near(a, b))


def test_next_with_null_equal_and_few_ids(spark):
    rows = [(5, "a"), (5, "b"), (None, "c"), (9, ""), (-7, "d"), (5, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    got = with_next(df, "doc_id", "text").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted((a is None, a or 0, b) for a, b in rows)
    by = {(r.doc_id, r.text): r.next_text for r in got}
    assert by[(9, "")] in ("a", "b") and by[(-7, "d")] == "c" and by[(None, "c")] == ""
    assert with_next(df.limit(0), "doc_id", "text").count() == 0
    assert with_next(df.where("doc_id = 9"), "doc_id", "text").first().next_text == ""


def test_sketch_estimates(spark):
    words = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[1000:]), "", None)], "a string, b string, c string, d string")
    a, b = sketch(F.col("a")), sketch(F.col("b"))
    r = df.select(resemblance(a, b).alias("r"), containment(b, a).alias("c"), distinct_shingles(a).alias("n"), merge(a, b).alias("m"), a.alias("a"), sketch(F.col("c")).alias("e"), sketch(F.col("d")).alias("z")).first()
    assert abs(r.r - 2996 / 3996) < 0.15 and abs(r.c - 1) < 0.2 and abs(r.n / 3996 - 1) < 0.3 and r.m == r.a and r.e == [] and r.z == []
    halves = spark.createDataFrame([("k", " ".join(words[:2004])), ("k", " ".join(words[2000:]))], "k string, t string").select("k", sketch(F.col("t")).alias("s"))
    assert merge_groups(halves, ["k"], "s").first().s == r.a
