from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryweb.llm import slices
from quarryweb.llm.common import bounded_batches, discard, shared_dir, written
from quarryweb.llm.words import hashed_words, word_hash


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


def test_a_cluster_without_a_shared_folder_raises():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"


def test_written_tables_can_go_and_settings_stay(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    one = written(spark.range(10).repartition(3), "test")
    assert one.count() == 10 and spark.conf.get(key) == before
    files = one.inputFiles()
    discard(one)
    left = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    assert files and not any(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) for p in left)


def test_batches_are_bounded_by_bytes(spark):
    bounded_batches(spark)
    texts = spark.range(40).select(F.repeat(F.lit("word "), 100_000).alias("text"))
    sizes = texts.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) > 20_000_000 and max(r.n for r in sizes) < 6_000_000


def test_filters_by_slice_drop_nothing():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000).astype(np.uint64) << np.uint64(1))
    for n in (1, 7, 1000):
        of = slices.slice_of(keys, n)
        assert of.max() < n and (np.diff(of.astype(np.int64)) >= 0).all()
        parts = [slices.segment(keys[of == p], p, n) for p in range(n)]
        bits = slices.filter_of([(low, words.tobytes()) for low, words in parts])
        assert slices.may_have(bits, keys).all()
        assert slices.may_have(bits, rng.integers(0, 1 << 63, 50_000).astype(np.uint64)).mean() < 0.02
    a, b, c = keys[:100], np.arange(100) - 50, rng.normal(size=100)
    for got, want in zip(slices.unpack(slices.pack(a, b, c), "uif"), (a, b, c), strict=True):
        assert (got == want).all()


def test_word_hashes_of_either_case():
    texts = pa.array(["Aa aA", None, "AA"])
    ((_, folded, cuts),) = hashed_words(texts, True)
    ((_, plain, _),) = hashed_words(texts, False)
    assert cuts.tolist() == [0, 2, 2, 3] and len(set(folded.tolist())) == 1 and len(set(plain.tolist())) == 3
    assert folded[0] == word_hash(b"aa") and plain[2] == word_hash(b"AA", False)
