"""Each stage of the pipeline against plain Python over what the stage before it gave."""

from collections import Counter

import pytest
from test_documents import BYTES, WORD, brute_components, brute_lines, check_packing, labelled, line_rows

import corpus_pipeline
from logweave.llm import classifier


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs, labels = labelled(spark)
    docs = docs.where("doc_id < 60")
    more = spark.createDataFrame([(1000 + k if i is not None else None, t, None, "t" if k % 2 else None, 0) for k, (i, t) in enumerate(line_rows())] + [(2000 + r.doc_id, r.text, "x", "u", 1) for r in docs.limit(8).collect()], docs.schema)
    docs.union(more).repartition(2).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, model = docs.columns, classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = stage(spark, now, sf_dir)
        now.write.parquet(out := f"{sf_dir}/{name.replace(' ', '-')}")
        now = spark.read.parquet(out)
        after = now.collect()
        if name != "packing":
            assert now.columns == columns
        if name == "quality classifier":
            good = {r.doc_id for r in classifier.score(docs, model).where("predicted = 1").collect()}
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if r.doc_id in good)
            assert 0 < len(after) < len(before)
        elif name == "line dedup":
            dropped = {(i, k) for i, k, *_, kept in brute_lines([(r.doc_id, r.text) for r in before]) if not kept}
            want = Counter((r.doc_id, None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, k) not in dropped)) for r in before)
            assert Counter((r.doc_id, r.text) for r in after) == want and dropped
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        elif name == "minhash near-dedup":
            label = brute_components({r.doc_id: r.text for r in before if r.doc_id is not None}, 80)
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if r.doc_id is None or label[r.doc_id][1] == r.doc_id)
        elif name == "source mixing":
            words = Counter()
            for r in before:
                words[r.source] += len(WORD.findall(r.text or ""))
            got = Counter()
            for r in after:
                got[r.source] += len(WORD.findall(r.text))
            assert all(got[s] <= 2 * n for s, n in words.items())
            assert abs(sum(got.values()) - 1.5 * sum(words.values())) <= 2 * len(words)
            whole = {(r.doc_id, r.text) for r in before}
            assert sum((r.doc_id, r.text) not in whole for r in after) <= len(words)  # one repetition per source is in part
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(BYTES)
            check_packing([tuple(r) for r in after], [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in before])


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 0
