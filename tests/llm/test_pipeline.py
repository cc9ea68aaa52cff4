"""The corpus pipeline stage by stage on a small corpus with planted cases."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pipelens.llm import mixing, queries, simhash, tokenbin
from tests.llm.test_toxicity_decontam import corpus, plain_hits


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus(700, seed=4)
    rng = random.Random(2)
    clean = [i for i, y in labels if not y]
    words = {i: t.split() for i, t in rows}
    extra, bench = [], []
    for i in clean[:20]:
        extra.append((10_000 + i, " ".join(words[i])))  # an exact copy
    for i in [i for i in clean[20:200] if len(words[i]) > 120][:20]:
        w = list(words[i])
        w[rng.randrange(len(w))] = "edited"
        extra.append((20_000 + i, " ".join(w)))
    for n in range(10):
        item = " ".join(f"b{n}q{k}x{rng.randrange(99)}" for k in range(30))
        bench.append((n, item))
        i = clean[200 + n]
        extra.append((30_000 + n, " ".join(words[i][:10] + item.split() + words[i][10:])))
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows + extra] + [(50_000, None, None, None, None), (50_001, "", "en", "src1", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    frames = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(bench, "item_id long, text string"),
    }
    for name, df in frames.items():
        df.repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path, rows, labels, docs, bench


def groups(docs):
    """The smallest id that pairs with a similarity of 0.8 reach, for each of ``docs``, by comparing all."""
    sets = {i: set(simhash.features((t or "").encode(), 5)) for i, t, *_ in docs}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in sets}


def test_stages(spark, folder):
    path, rows, labels, docs, bench = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    toxic = {i for i, y in labels if y}

    kept = corpus_pipeline.drop_toxic(spark, frame, path)
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(toxic & ids) <= 0.1 * len(toxic) and {d[0] for d in docs} - toxic <= ids

    alone = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, kept, path).collect()}
    assert not any(10_000 <= i < 30_000 for i in alone) and 50_000 in alone and 50_001 not in alone
    assert alone == {i for i, least in groups([d for d in docs if d[0] in ids]).items() if i == least}

    clean = corpus_pipeline.drop_benchmark(spark, kept, path)
    text = {d[0]: d[1] for d in docs}
    assert {r.doc_id for r in clean.collect()} == {i for i in ids if not plain_hits(text[i], bench)}

    mixed = corpus_pipeline.mix_sources(spark, clean, path)
    assert mixed.columns == frame.columns
    got = corpus_pipeline.write_token_ids(spark, mixed, path).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want
    got.sort(key=lambda r: r.start)  # in training order, which test_token_files_follow_the_curriculum checks
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()


def test_run_is_its_stages(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, docs.drop("file").collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mix_sources", "token_ids"]


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 AS score", "2 AS p_fp", "3 AS m_size", "4 AS tie")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("doc_id < 40"), path).columns == docs.columns
        assert stage(spark, docs.where("false"), path).count() == 0
    assert corpus_pipeline.write_token_ids(spark, docs.where("false"), path).count() == 0


def test_token_files_follow_the_curriculum(spark, folder, tmp_path):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    mixing.mix(docs).write.parquet(f"{tmp_path}/mixed")
    folder_, files = tokenbin.write(spark.read.parquet(f"{tmp_path}/mixed"), public_tokenizers.path("word_bpe_49k.json"), as_it_is=True)
    written = [i for name, *_ in files for i, _ in tokenbin.read_file(folder_, name)]
    ordered = sorted((r.t, r.doc_id) for r in mixing.mix(docs, position="t").collect())
    assert written == [i for _, i in ordered] and len(set(written)) < len(written)
    starts = [r.doc_id for r in corpus_pipeline.write_token_ids(spark, spark.read.parquet(f"{tmp_path}/mixed"), path).orderBy("start").collect()]
    assert starts == written


def test_near_duplicates_are_those_of_brute_force(spark, folder):
    path, rows, labels, docs, _ = folder
    some = [d for d in docs if d[0] >= 10_000 or d[0] < 260]
    frame = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
    alone = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, path).collect()}
    least = groups(some)
    assert alone == {i for i in least if least[i] == i} and len(least) - len(alone) > 30


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
