"""Each stage of the pipeline against brute force over what the stage before kept."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chronolake.llm import quality, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(21)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(k, make(25)) for k in range(4)]
    texts = [make(random.randint(60, 150)) for _ in range(150)]
    texts += [" ".join(f"{w}%%%" for w in make(80).split()) for _ in range(25)]  # poor
    texts += [texts[k % 5] for k in range(12)]  # copies
    texts += [texts[8].rsplit(" ", 1)[0] + f" end{k}" for k in range(6)]  # near copies
    texts += [make(40) + " " + items[k % 4][1] + " " + make(40) for k in range(6)]  # leaks
    texts += [None, ""]
    docs = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    labels = [(k, 0 if 150 <= k < 175 else 1, 0) for k in range(0, 175, 2)]
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def cut(text):
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", (text or "").lower()) if w]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r.text for r in docs.collect()}

    def run(name):
        nonlocal docs
        docs = corpus_pipeline.materialize(stages[name](spark, docs, folder), "stage")
        return docs

    kept = {r.doc_id for r in quality.importance_resample(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.kept}
    after = {r.doc_id: r.text for r in run("quality classifier").collect()}
    assert docs.columns == COLUMNS and set(after) == kept
    assert sum(150 <= k < 175 for k in after) <= 2 and sum(k < 150 for k in after) >= 145

    before = after
    last = {}
    for k, t in sorted(before.items()):
        last[t or ""] = k
    after = {r.doc_id: r.text for r in run("exact dedup").collect()}
    assert docs.columns == COLUMNS and set(after) == set(last.values())

    before = after
    sets = {k: set(shingles.shingle_set(t, 5).tolist()) for k, t in before.items()}
    parent = {k: k for k in before}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    after = {r.doc_id: r.text for r in run("near dedup").collect()}
    assert docs.columns == COLUMNS and set(after) == {find(k) for k in before} and len(after) < len(before)

    before = after
    wins = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() for w in [cut(r.text)] for i in range(len(w) - 9)}
    clean = {k for k, t in before.items() if not any(tuple(cut(t)[i : i + 10]) in wins for i in range(len(cut(t))))}
    after = {r.doc_id: r.text for r in run("decontamination").collect()}
    assert docs.columns == COLUMNS and set(after) == clean and len(after) < len(before)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = run("bpe").collect()
    assert {r.doc_id for r in out} == set(after)
    for r in out:
        assert r.ids == library.encode(after[r.doc_id] or "", add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256((after[r.doc_id] or "").encode()).hexdigest()


def test_run_equals_the_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "decontamination", "bpe"]
    assert corpus_pipeline.run(spark, folder).count() > 100
