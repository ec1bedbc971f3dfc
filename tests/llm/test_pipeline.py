import re
import sys
import zlib
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from quarryweb.llm import jaccard
from quarryweb.llm.decontaminate import find_contamination
from quarryweb.llm.jaccard import near_duplicates
from quarryweb.llm.packing import pack_documents

SF = "/root/testdata/sf0.01"


def test_each_stage_does_its_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        rows[name] = docs.collect()
        if name == "quality":
            ids = {r.doc_id for r in rows[name]}
            for label in (0, 1):
                kept = [d in ids for d, y in labels.items() if y == label]
                assert sum(kept) / len(kept) >= 0.97 if label else sum(kept) / len(kept) <= 0.03
        elif name == "near_duplicates":
            want = {r.component_id if r.n_shingles else r.doc_id for r in near_duplicates(before).collect()}
            assert {r.doc_id for r in rows[name]} == want and len(rows[name]) == len(want) < before.count()
        elif name == "decontamination":
            hit = {r.doc_id for r in find_contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
            assert hit and {r.doc_id for r in rows[name]} == {r.doc_id for r in before.collect()} - hit
        elif name == "secrets":
            old = {r.doc_id: r for r in before.collect()}
            assert len(old) == len(rows[name])
            for r in rows[name]:
                assert not re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text) and r.n_chars == len(r.text)
                assert r.text == old[r.doc_id].text or "[SECRET]" in r.text
            assert any("[SECRET]" in r.text for r in rows[name])
        else:
            assert {r.doc_id for r in rows[name]} == {r.doc_id for r in before.collect()}
    run = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, run)) == sorted(map(key, rows["packing"]))


def test_stages_on_odd_and_empty_tables(spark):
    long = "word and text. " * 20_000
    rows = [(1, None, "en", None, None), (None, "", None, "s", 0), (2, "A plain line of text, and more of it.", "en", "s", 5), (2, "A plain line of text, and more of it.", "en", "s", 5), (3, long, "en", "s", len(long)), (4, "x token=abcdefgh123 y", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("quality_score", F.lit("mine")).withColumn("node", F.lit(1))
    flat = lambda df: Counter(tuple(r) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out, have = stage(spark, docs, SF), flat(docs)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        got = flat(out)
        if name == "quality":
            assert not got - have and got[next(r for r in have if r[0] == 2)] in (0, 2)
        elif name == "near_duplicates":
            assert got == Counter({r: 1 for r in have})
        elif name == "decontamination":
            assert got == have
        elif name == "secrets":
            texts = {1: None, None: "", 4: "x [SECRET] y"}
            want = Counter()
            for r, n in have.items():
                text = texts.get(r[0], r[1])
                want[(r[0], text, *r[2:4], None if text is None else len(text), *r[5:])] += n
            assert got == want
        else:
            lengths = Counter()
            for r in out.collect():
                lengths[r.doc_id] += r.length
            assert (lengths[1], lengths[None], out.where("doc_id = 2").count()) == (1, 1, 2) and lengths[3] > 60_000


def test_pieces_carry_their_ids(spark):
    df = spark.createDataFrame([(1, "some words here"), (1, "some words here"), (2, None), (3, "ab " * 3000)], "doc_id long, text string")
    rows = pack_documents(df, with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows) and len(rows) == 5


def test_near_duplicates_of_near_copies_write_about_a_row_for_each_posting(spark, monkeypatch):
    rows = {}

    def counted(df, name, real=jaccard.written):
        out = real(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    docs = spark.range(480).select(F.col("id").alias("doc_id"), F.expr("concat(array_join(transform(sequence(1, 60), x -> concat('p', id % 40, 'w', x)), ' '), ' copy', id div 40)").alias("text"))
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    assert rows["jaccard-lists"] <= 1.5 * rows["jaccard-postings"]
