"""run() against the stages' rules, written out slowly, on a small fixture."""

from collections import defaultdict

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_similar_texts import slow_components
from tests.llm.test_substring_dedup import WORD


def cut(texts):
    """doc_id -> text without windows of 50 words that a smaller doc_id has."""
    first, words = {}, {d: WORD.findall(t) for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    out = {}
    for d, w in words.items():
        gone = {k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for k in range(i, i + 50)}
        if not gone:
            out[d] = texts[d]
        elif len(gone) < len(w):
            out[d] = " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


def test_pipeline(spark, documents, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = source.columns
    folder = str(tmp_path)
    odd = spark.createDataFrame([(10_000, None, "en", "src1", 0), (10_001, documents[0][1], "fr", None, 1), (10_001, documents[0][1], "fr", None, 1)], source.schema)
    docs = source.union(odd)
    docs.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = {name: f for name, f in corpus_pipeline.STAGES}

    kept = stage["quality rules"](spark, docs, folder)
    assert kept.columns == columns
    kept = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 10_000 not in kept and 10_001 in kept

    good = docs.where(docs.doc_id.isin(list(kept)))
    one = stage["SimHash near-dedup"](spark, good, folder)
    assert one.columns == columns
    root = slow_components(kept)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d for d in kept if root[d] == d)

    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    less = stage["substring dedup"](spark, one, folder)
    assert less.columns == columns and {r["doc_id"]: r["text"] for r in less.collect()} == cut(texts)

    rows = [(r["doc_id"], r["text"], r["source"]) for r in less.collect()]
    mixed = stage["mixing"](spark, less, folder)
    assert mixed.columns == columns
    from quadloom.llm.mixing import mix

    want = check_mix(mix(less).collect(), rows)
    got = defaultdict(int)
    for r in mixed.collect():
        got[r["source"]] += len(WORD.findall(r["text"]))
    assert got == {s: n for s, n in want.items() if n}

    # the whole run packs just the tokens of the mix
    from tokenizers import Tokenizer

    from quadloom.llm.packing import default_tokenizer

    public = Tokenizer.from_file(default_tokenizer())
    total = sum(len(public.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sum(r["length"] for r in packed) == total
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed.collect()}
    assert len({r["sequence_id"] for r in packed}) <= 1.02 * -(-total // 1024) + 1


def test_empty(spark):
    none = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
