import io
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryweb.llm.packing import best_fit, complete, lower_bound, op2_best_fit_packing, pack, pack_documents
from quarryweb.llm.tokens import VOCABULARY, WordEncoder
from quarryweb.llm.tokfile import ShardReader, op10_token_files, read_token_files, write_shard, write_token_files


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "á ́b é", "x y z\x1cq\x85r", "İSTANBUL ΣΑΣ ſ", "<|endoftext|> <|startoftext|>a<|endoftext|>", "it's 's '\ns don't", "１２3 a1b2", "日本語 テスト", "\t tab\vx\fy\r\nz", "!!! *** &&&", "퟿\U0001f600 ok", "a<|endoftext|> b", "<|ENDOFTEXT|> ABC", "ÀÉÞ ÷× µª ÿŸ ΑΣ", "ÀÉÞ÷×µªº ÐØ", "İ ŒUVRE", "a… … b…… ©x"]


def test_words_joined_equal_whole_texts(whole):
    e, rnd = WordEncoder(VOCABULARY, kept=300), random.Random(3)
    every = "".join(map(chr, range(0x21, 0x180)))
    for word in [c + t for c in every for t in ("", "x", ",")] + [f"{a}{b}" for a in "\xc0\xff\xdf" for b in every]:
        assert np.frombuffer(e.encode(word), "<u4").tolist() == whole(word), repr(word)
    chars = "ab Cé'’s1 2\n\t!*́ <|>ñß"
    for text in ODD + ["".join(rnd.choices(chars, k=rnd.randint(0, 60))) for _ in range(1500)]:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == whole(text), repr(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2_and_op10_on_all_documents(spark, sf_dir, whole):
    docs = {r.doc_id: whole(r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op2_best_fit_packing(spark, sf_dir).collect()
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in got:
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs) and len(got) == sum(map(len, pieces.values()))
    for d, ids in docs.items():
        ids = [*ids, 0]
        assert len(pieces[d]) == -(-len(ids) // 2048)
        for k, r in pieces[d].items():
            part = ids[k * 2048 : (k + 1) * 2048]
            assert (r.start, r.length, r.ids_crc32) == (k * 2048, len(part), crc(part))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(x) + 1 for x in docs.values())
    assert len(sequences) == -(-total // 2048)

    start = 0
    rows = {r.doc_id: r for r in op10_token_files(spark, sf_dir).collect()}
    assert set(rows) == set(docs)
    for d in sorted(docs):
        ids = [*docs[d], 1]
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def optimum(items, capacity):
    """Fewest bins, by trying every subset for the bin of the largest item."""
    items = tuple(sorted(items, reverse=True))
    seen = {}

    def best(rest):
        if not rest:
            return 0
        if rest not in seen:
            first, others = rest[0], rest[1:]
            seen[rest] = 1 + min(
                best(tuple(x for i, x in enumerate(others) if i not in chosen))
                for k in range(len(others) + 1)
                for chosen in map(set, combinations(range(len(others)), k))
                if first + sum(others[i] for i in chosen) <= capacity
            )
        return seen[rest]

    return best(items)


def packed(plan, capacity):
    used = Counter()
    for pattern, n in plan:
        assert 0 < sum(pattern) <= capacity and n > 0
        for x in pattern:
            used[x] += n
    return used, sum(n for _, n in plan)


def test_completion_is_optimal_on_small_cases_and_whole_on_large():
    rnd = random.Random(1)
    for _ in range(150):
        capacity = rnd.choice([10, 30, 100])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 8))]
        hist = Counter(items)
        used, n = packed(complete(hist, capacity), capacity)
        assert used == hist and n == optimum(items, capacity)
        assert lower_bound(hist, capacity) <= n
    hist = Counter(min(2048, int(rnd.lognormvariate(6, 1)) + 1) for _ in range(50_000))
    used, n = packed(complete(hist), 2048)
    assert used == hist and n <= lower_bound(hist, 2048) + 2
    used, n = packed(best_fit(hist, 2048), 2048)
    assert used == hist
    assert complete({}) == []


def planted(n, seed, capacity=2048):
    """n full bins of three pieces each, none near the ends of the range."""
    rnd, hist = random.Random(seed), Counter()
    for _ in range(n):
        a = rnd.randint(760, 980)
        b = rnd.randint(500, (capacity - a) // 2)
        hist.update((a, b, capacity - a - b))
    return hist


@pytest.mark.parametrize(("n", "most"), [(60, 61), (500, 502), (2000, 2010)])
def test_completion_finds_planted_packings(n, most):
    hist = planted(n, 3)
    used, bins = packed(complete(hist), 2048)
    assert used == hist and n <= bins <= most < packed(best_fit(hist, 2048), 2048)[1]


def test_completion_of_many_small_pieces_and_of_few_lengths():
    for hist in ({1: 5000, 2000: 3}, {700: 10**9}, {1025: 1000, 600: 3000}, {2048: 4, 1: 1}, {3: 10**6, 1000: 7, 2045: 10**5}):
        used, bins = packed(complete(hist), 2048)
        assert used == Counter(hist) and bins <= packed(best_fit(hist, 2048), 2048)[1]


def test_equal_rows_are_ranked_apart(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("doc_id"), F.lit(500).alias("length"))
    got = pack(rows).groupBy("sequence_id").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("places")).groupBy("n", "places").count().collect()
    assert [tuple(r) for r in got] == [(4, 4, 10_000)]


def test_hot_length_repeated_rows_and_clashing_columns(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 2000, 700).otherwise(F.col("id") % 2048 + 1).alias("length"), F.lit("x").alias("offset"), F.lit(1).alias("sequence_id"))
    rows = pack(df).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 3000
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048
    assert pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(df.select(F.lit(None).cast("int").alias("length")))


def test_edge_documents(spark, tmp_path, whole):
    long = "abc def " * 6000
    df = spark.createDataFrame([(None, "zz"), (5, None), (5, ""), (5, "b"), (5, "b"), (-3, long)], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = pack_documents(df).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got if r.doc_id in (None, 5)) == [(0, 0, len(whole("zz")) + 1), (5, 0, 1), (5, 0, 1), (5, 0, len(whole("b")) + 1), (5, 0, len(whole("b")) + 1)]
    assert sum(r.length for r in got if r.doc_id == -3) == len(whole(long)) + 1
    assert pack_documents(df.limit(0)).count() == 0
    manifest = write_token_files(df, str(tmp_path / "t"))
    rows = sorted(read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -3, 5, 5, 5, 5] and [r.n_tokens for r in rows][2:4] == [1, 1]
    assert manifest.agg(F.sum("n_ids")).first()[0] == sum(r.n_tokens for r in rows)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(6)]
    only = read_token_files(spark, str(tmp_path / "t"), doc_ids=[-3]).collect()
    assert len(only) == 1 and bytes(only[0].ids) == np.array([*whole(long), 1], "<u4").tobytes()
    write_token_files(df.limit(0), str(tmp_path / "e"))
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_a_document_beyond_a_frame_raises(monkeypatch):
    monkeypatch.setattr("quarryweb.llm.tokfile.MOST_FRAME", 1000)
    with pytest.raises(ValueError, match="more ids"):
        write_shard(io.BytesIO(), [(1, b"1234"), (2, b"0" * 1000)])


def test_shard_reads_only_wanted_frames_and_finds_damage():
    docs = [(i, np.arange(i * 7 % 50, dtype="<u4").tobytes()) for i in range(200)]
    out = io.BytesIO()
    assert write_shard(out, docs, frame_bytes=400) == (200, sum(len(x) // 4 for _, x in docs))
    data = out.getvalue()
    reader = ShardReader(io.BytesIO(data), len(data))
    assert [(d, bytes(x)) for d, _, x in reader.read()] == docs
    reader.frames_read = 0
    assert [(d, bytes(x)) for d, _, x in reader.read({101})] == [docs[101]] and reader.frames_read == 1
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data[: int(reader.at[-1])]), read_across_frames=True).read()
    assert plain == b"".join(x for _, x in docs)
    bad = bytearray(data)
    bad[int(reader.at[3]) + 9] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(ShardReader(io.BytesIO(bytes(bad)), len(bad)).read())
    with pytest.raises(ValueError):
        ShardReader(io.BytesIO(data[:-1]), len(data) - 1)
