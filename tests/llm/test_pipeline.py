from collections import Counter

import corpus_pipeline
import pytest
from brute import words

from glintframe.llm import queries


def test_stages(spark, docs, empty, corpus, tmp_path, monkeypatch):
    folder = str(tmp_path)
    docs.select(*empty.columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, corpus[40][1][:150])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark", "tokens"]
    df, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, folder)
        df.write.parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r["doc_id"]: r["text"] for r in df.collect()}
        assert df.columns[:5] == empty.columns
    assert len(seen["quality"]) == 100  # without labels nothing is rejected
    assert not {90, 99} & set(seen["near_duplicates"]) and 30 in seen["near_duplicates"]
    assert 40 not in seen["benchmark"] and set(seen["tokens"]) == set(seen["benchmark"])
    windows = lambda stage: Counter(tuple(w[i : i + 50]) for t in seen[stage].values() for w in [words(t)] for i in range(len(w) - 49))
    repeated = {k for k, n in windows("near_duplicates").items() if n > 1}
    assert repeated and not repeated & set(windows("repeated_passages"))
    assert corpus_pipeline.run(spark, folder).count() == len(seen["tokens"])
    assert corpus_pipeline.ORACLE_SQL is None


def test_copies_are_dropped_by_row(spark, empty):
    long = {i: " ".join(f"{c}{k}" for k in range(70)) for i, c in enumerate("abcdefg")}
    near = long[4].replace("e69", "edit")
    rows = [(None, long[0], "en", "s", 1)] * 3 + [(None, long[0], None, "en", 1), (None, long[0], "en", None, 1)]  # copies without ids
    rows += [(7, long[1], "en", "s", 1)] * 4  # one row repeated
    rows += [(8, long[2], "en", "s", 1), (8, long[3], "en", "s", 1)]  # one id, two texts
    rows += [(1, long[4], "en", "s", 1), (9, near, "en", "s", 1), (9, long[5], "en", "s", 1)]  # a dropped near copy and a clean text of its id
    rows += [(None, long[6], "en", "s", 1), (3, long[6], "en", "s", 1), (3, long[6], "en", "s", 1)]  # an id comes before none
    rows += [(5, "", "en", "s", 1)] * 2 + [(None, None, "en", "s", 1)] * 2  # no words
    df = spark.createDataFrame(rows, empty.schema).repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    want = [(None, long[0]), (7, long[1]), (8, long[2]), (8, long[3]), (1, long[4]), (9, long[5]), (3, long[6])] + [(5, "")] * 2 + [(None, None)] * 2
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(want)
    texts = Counter(r["text"] for r in corpus_pipeline.repeated_passages(spark, kept, "").collect() if r["text"])
    assert texts == Counter(long.values())


def test_stages_take_nothing(spark, empty, tmp_path):
    folder = str(tmp_path)
    for name, schema in (("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_is_registered(n):
    assert any(k.startswith(f"op{n}_") for k in queries.queries())
