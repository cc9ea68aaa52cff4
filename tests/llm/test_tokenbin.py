"""Token files: exact blocks, whole-text tokenization, order, ties and odd rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pipelens.llm import tokenbin

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1), st.just(7)), max_size=900))
def test_blocks_round_trip(values):
    ids = np.array(values, dtype=np.uint32)
    blocks = tokenbin.encode_blocks(ids)
    sizes = np.array([len(b) for b in blocks], dtype=np.int64)
    back = tokenbin.decode_blocks(b"".join(blocks), np.cumsum(sizes) - sizes) if blocks else np.zeros(0, dtype=np.uint32)
    assert np.array_equal(back[: len(ids)], ids)


def test_width_follows_the_percentile_and_outliers_are_exceptions():
    ids = np.full(256, 1000, dtype=np.uint32)
    ids[:100] += np.arange(100, dtype=np.uint32) % 8
    ids[5] = 2**31
    (block,) = tokenbin.encode_blocks(ids)
    assert block[4] == 3 and int.from_bytes(block[5:7], "little") == 1
    assert len(block) == 7 + 3 * 32 + 5


ODD = [
    (5, "The quick  brown\tfox; don't stop 12345!"), (1, None), (1, ""), (None, "null id"), (3, "same"), (3, "same"), (3, "tie b"), (3, "tie a"), (9, "x" * 200_000), (10, "word " * 50_000),
    (11, "a\x01b \x01 c"), (12, "é ́a ΣΑΣ ﬁ İstanbul. Σ!"), (13, "<|endoftext|>x <|startoftext|>"), (14, "\u2003wide\u00a0space\x1c\x85"), (15, "a'b 'll we'll. hi!? (x) …"), (2**40, "far"),
]


def test_files_hold_what_the_library_gives(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, tie int, start string")
    folder, files = tokenbin.write(df, PATH, f"file://{tmp_path}/ids")
    got = sorted(tokenbin.read(spark, folder, files).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(PATH)
    want = sorted(((i, zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes())) for i, x in ODD), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), c) for i, c in want)
    ends = 0
    for r in got:
        assert r.start == ends
        ends += r.n_tokens
    again = tokenbin.round_trip(df.repartition(3), PATH).drop("file").collect()
    assert sorted(map(tuple, again), key=lambda r: r[1]) == [tuple(r)[:4] for r in got]


def test_long_texts_cross_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenbin, "BATCH_IDS", 512)
    w = tokenbin.Writer(str(tmp_path), "f")
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 49408, n).astype(np.uint32) for n in (0, 1, 255, 256, 5000, 3, 700)]
    for i, d in enumerate(docs):
        w.add(None if i == 3 else i, d)
    assert w.close() == ("f", 7, sum(map(len, docs)))
    back = list(tokenbin.read_file(str(tmp_path), "f"))
    assert [b[0] for b in back] == [0, 1, 2, None, 4, 5, 6] and all(np.array_equal(a, b[1]) for a, b in zip(docs, back))


def test_truncated_file_is_refused(tmp_path):
    w = tokenbin.Writer(str(tmp_path), "f")
    w.add(1, np.arange(300, dtype=np.uint32))
    w.close()
    (tmp_path / "g").write_bytes((tmp_path / "f").read_bytes()[:-3])
    with pytest.raises(ValueError):
        list(tokenbin.read_file(str(tmp_path), "g"))


def test_forgetting_words_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(tokenbin, "KEPT_WORDS", 30)
    cache, t = tokenbin.WordCache(PATH), Tokenizer.from_file(PATH)
    for n in range(12):
        texts = [" ".join(f"w{(n * 7 + i) % 90}x" for i in range(25)), "common words. again"]
        for x, ids in zip(texts, cache.encode([x.encode() for x in texts], None)):
            assert ids.tolist() == t.encode(x, add_special_tokens=False).ids


WORD = st.text(st.one_of(st.sampled_from("aZİıßςΣé'́̇ʼ漢अ్😀ﬁǅ𐵀0_-<|"), st.characters(exclude_categories=["Cs", "Z", "Cc"])), min_size=1, max_size=4)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(WORD, st.sampled_from(["", ".", ",", "!?", "...", ";:"])), min_size=1, max_size=12), st.randoms(use_true_random=False))
def test_ids_do_not_depend_on_what_is_cached(words, rng):
    """Stems and stops of any characters, learnt in any order and together with any others, give the ids of the whole text."""
    cache, t = CACHE[0], CACHE[1]
    if len(cache.of) > 2000:
        CACHE[0] = cache = tokenbin.WordCache(PATH)
    texts = [" ".join(w + stop for w, stop in words), " ".join(w for w, _ in words), " ".join((w + stop).swapcase() for w, stop in words)]
    rng.shuffle(texts)
    for x in texts:
        if "<|" not in x:
            (ids,) = cache.encode([x.encode()], None)
            assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x


CACHE = [tokenbin.WordCache(PATH), Tokenizer.from_file(PATH)]


@pytest.mark.parametrize("known", [["ALİ"], ["ALİ,"], ["ali", "ALI", "geldi"], []])
def test_dotted_capitals_before_stops(known):
    cache, t = tokenbin.WordCache(PATH), Tokenizer.from_file(PATH)
    for w in known:
        cache.encode([w.encode()], None)
    for x in ("ALİ, geldi", "İ. İ, İİ!", "ALİ geldi. ALİ, ALİ"):
        assert cache.encode([x.encode()], None)[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_empty_table(spark):
    assert tokenbin.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_a_table_keeps_its_order(spark, tmp_path):
    rows = [(int(i), f"word{i} " * (1 + i % 7)) for i in np.random.default_rng(5).permutation(900)] + [(3, "again"), (3, "again"), (None, None), (4, "")]
    t = Tokenizer.from_file(PATH)
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in rows]
    starts = np.cumsum([0, *map(len, ids)])[:-1]
    want = [(i, int(a), len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for (i, _), a, x in zip(rows, starts, ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int").repartitionByRange(12, "n").sortWithinPartitions("n")
    ordered.select("doc_id", "text").write.option("maxRecordsPerFile", 40).parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for table in (spark.read.parquet(f"{tmp_path}/docs"), frame.coalesce(1), ordered.select("doc_id", "text")):
            folder, files = tokenbin.write(table, PATH, as_it_is=True)
            got = sorted(map(tuple, tokenbin.read(spark, folder, files).drop("file").collect()), key=lambda r: r[1])
            assert got == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
