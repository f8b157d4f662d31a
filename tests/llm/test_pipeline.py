"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from auditlake.llm import common

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghijklm") for _ in range(R.randint(2, 8))) for _ in range(500)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    items = [(i, prose(30)) for i in range(5)]
    passage = prose(120)
    docs, labels = [], []
    for i in range(200):
        bad = i % 5 == 0
        docs.append((i, " ".join(w + "###" for w in prose(60).split()) if bad else prose(60)))
        labels.append((i, int(not bad), 0))
    base = prose(100)
    words = base.split()
    docs += [(300, base), (301, base), (302, " ".join([*words[:50], "edit", *words[51:]]))]
    docs += [(310, prose(50) + " " + passage), (311, passage + " " + prose(50))]
    docs += [(320, prose(40) + " " + items[2][1] + " " + prose(40))]
    docs += [(330, prose(6000)), (340, None), (341, ""), (342, None), (0, docs[0][1]), (7, docs[7][1]), (None, prose(60)), (None, prose(61))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(docs), passage


def test_stages(spark, planted):
    folder, texts, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = common.saved(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    good = {i for i, t in texts.items() if i is None or t and (i >= 200 or i % 5)}
    assert len({i for i in seen["quality"].keys() ^ good if i is None or texts[i]}) <= 3
    assert 330 in seen["packing" if "packing" in seen else "decontamination"]
    assert {300, 301, 302} & seen["near_dedup"].keys() == {300}
    # Of the empty texts that are left one stays.
    assert seen["quality"].keys() - seen["near_dedup"].keys() - {340, 341, 342} == {301, 302} & seen["quality"].keys()
    assert len({340, 341, 342} & seen["near_dedup"].keys()) <= 1 and None in seen["near_dedup"]
    cut = seen["suffix_dedup"]
    assert cut.keys() == seen["near_dedup"].keys()
    for i, r in cut.items():
        assert r.n_chars == len(r.text) if r.text is not None else r.n_chars is None or not texts[i]
        if i in (310, 311):
            assert passage not in r.text and len(r.text) < len(texts[i]) - 400
        elif i is not None:
            assert r.text == texts[i]
    assert cut.keys() - seen["decontamination"].keys() == {320}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == seen["decontamination"].keys()


def test_empty(spark, planted):
    folder, *_ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.saved(stage(spark, docs, folder), name)
        assert docs.count() == 0
