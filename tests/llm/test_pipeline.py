"""The pipeline, stage by stage, against plain Python."""

import hashlib
import re

import corpus_pipeline
from quietlake.llm import quality
from quietlake.llm.common import read_table, with_rows, without_rows


def _rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = read_table(spark, sf, "documents")
    state, names = {"start": _rows(docs)}, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "jaccard_join", "secret_scan", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            state[name] = _rows(docs)

    scores = {r["doc_id"]: r["score"] for r in quality.score(read_table(spark, sf, "documents"), quality.train(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))).collect()}
    assert state["quality"].keys() == {i for i, s in scores.items() if s >= 0.5}

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last: dict = {}
    for i, r in state["quality"].items():
        digest = hashlib.sha256(r["text"].translate(fold).encode()).digest()
        last[digest] = max(i, last.get(digest, i))
    assert state["exact_dedup"].keys() == set(last.values())

    sets = {}
    for i, r in state["exact_dedup"].items():
        w = re.findall("[^\x20\x09-\x0d]+", r["text"].translate(fold))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    assert state["jaccard_join"].keys() == {find(i) for i in sets}

    assert state["secret_scan"].keys() == state["jaccard_join"].keys()
    secret = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")
    for i, r in state["secret_scan"].items():
        assert not secret.search(r["text"]) and r["n_chars"] == len(r["text"])
        if "[SECRET]" not in r["text"]:
            assert r["text"] == state["jaccard_join"][i]["text"]
    assert {r["doc_id"] for r in docs.collect()} == state["secret_scan"].keys()
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_row_numbers_outlast_another_cut_of_the_files(spark, tmp_path):
    spark.range(80).selectExpr("id as doc_id", "concat('one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen ', array_join(transform(sequence(1, 90), i -> concat('w', id % 40, 'x', i)), ' ')) as text").repartition(8).write.parquet(str(tmp_path / "docs"))
    cut = "spark.sql.files.minPartitionNum"  # stands for the number of cores, which changes with the executors
    spark.conf.set(cut, 8)
    try:
        numbered, row = with_rows(spark.read.parquet(str(tmp_path / "docs")))
        kept = without_rows(numbered, row, numbered.filter("doc_id < 40").select(row))
        copies = corpus_pipeline.exact(spark, spark.read.parquet(str(tmp_path / "docs")), "")
        near = corpus_pipeline.near(spark, spark.read.parquet(str(tmp_path / "docs")), "")
        spark.conf.set(cut, 1)
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40, 80))
        assert sorted(r["doc_id"] for r in copies.collect()) == list(range(40, 80))
        assert sorted(r["doc_id"] for r in near.collect()) == list(range(40))
    finally:
        spark.conf.unset(cut)
