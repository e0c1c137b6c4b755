"""The pipeline's stages on a small corpus, against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 7))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """documents, labels and benchmark with planted junk, copies, passages and personal data."""
    d, rng = tmp_path_factory.mktemp("sf"), random.Random(9)
    clean = [prose(rng, 80) for _ in range(150)]
    items = [prose(rng, 40) for _ in range(8)]
    texts, kind = [], []

    def add(k, t):
        kind.append(k)
        texts.append(t)

    for t in clean:
        add("clean", t)
    for t in clean[:10]:
        add("copy", t)
        add("copy", t + " tail")
    for _ in range(60):
        add("junk", " ".join(w + "###" for w in prose(rng, 60).split()))
    for t in items:
        add("leak", prose(rng, 30) + " " + t.upper() + " " + prose(rng, 30))
    add("private", prose(rng, 40) + " card 4539578763621486 and mail someone@mail1.example.com")
    rows = [(i, t, "en", f"src{i % 5}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(k != "junk"), 0) for i, k in enumerate(kind) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), kind, texts


def test_stages(spark, corpus, tmp_path):
    d, kind, texts = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.toPandas()
    of = lambda name: [kind[i] for i in kept[name]["doc_id"]]
    assert of("quality").count("junk") == 0 and len(of("quality")) == len(kind) - kind.count("junk")
    assert of("near_duplicates").count("copy") == 0 and of("near_duplicates").count("clean") == 150
    assert of("decontamination").count("leak") == 0 and of("decontamination").count("clean") == 150
    final = dict(zip(kept["pii"]["doc_id"], kept["pii"]["text"], strict=True))
    private = final[kind.index("private")]
    assert "4539578763621486" not in private and "someone@" not in private
    assert all(final[i] == texts[i] for i in final if kind[i] == "clean")
    assert kept["packing"].groupby("doc_id").length.sum().to_dict() == kept["packing"].groupby("doc_id").doc_tokens.first().to_dict()
    assert set(kept["packing"]["doc_id"]) == set(final)


def test_survivors_do_not_depend_on_the_order_of_rows(spark, corpus, monkeypatch):
    """Shuffled ids and 1, 3 and 7 partitions: the smallest id of each group stays, of equal ids the same text."""
    d, _, _ = corpus
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    rng = random.Random(21)
    base = [prose(rng, 60) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip((50, 3, 41, 8, 30, 9), base, strict=True)]
    rows += [(5, base[0], "en", "s", 1), (70, base[0] + " more", "en", "s", 1), (4, base[1], "en", "s", 1), (9, base[5] + " end", "en", "s", 1), (None, base[3], "en", "s", 1)]
    found = []
    for partitions in (1, 3, 7):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(partitions)
        found.append(sorted((repr(r["doc_id"]), r["text"]) for r in stage(spark, docs, d).collect()))
    monkeypatch.setattr(corpus_pipeline, "MOST_BROADCAST", -1)
    found.append(sorted((repr(r["doc_id"]), r["text"]) for r in stage(spark, docs, d).collect()))
    assert found[0] == found[1] == found[2] == found[3]
    assert [i for i, _ in found[0]] == sorted(["5", "3", "41", "None", "30", "9"])


def test_run(spark, corpus):
    d, kind, _ = corpus
    rows = corpus_pipeline.run(spark, d).collect()
    assert {kind[r.doc_id] for r in rows} == {"clean", "private"}


def test_empty_corpus(spark, corpus, tmp_path):
    d, _, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "x y z", "en", "s", 5), (2, None, None, None, None), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in out) == [(-1, "x y z"), (1, "a b c d e f"), (2, ""), (2, "")]
    assert pii.pseudonymise(docs, "k").count() == 5


def test_columns_with_the_names_used_inside(spark, corpus):
    """Columns called like those that stages add come back as they were."""
    d, kind, texts = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 40")
    clash = ["row", "doc", "__row", "__own", "__quality", "__h", "__p", "host", "path", "own", "n", "s", "id", "t", "node", "token", "__finds"]
    for k, name in enumerate(clash[:-1]):
        docs = docs.withColumn(name, F.lit(k))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all([r[c] for c in clash[:-1]] == list(range(len(clash) - 1)) for r in rows), name


def test_stages_delete_what_earlier_ones_wrote(spark, corpus, tmp_path):
    """After the last stage only what its result reads is left of the stages' own tables."""
    from tessera.storage import shared_root

    d, _, _ = corpus
    root = shared_root(spark).removeprefix("file://")
    docs, before = spark.read.parquet(f"{d}/documents.parquet"), set(os.listdir(f"{root}/tessera")) if os.path.isdir(f"{root}/tessera") else set()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(f"{root}/tessera")) - before}
    assert left <= {"pack-blocks", "pack-dealt"}
