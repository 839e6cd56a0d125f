import corpus_pipeline
import pytest

from wavelark.llm import decontaminate, packing, quality, secrets, simhash

from test_near import plain_classes

D = "/root/testdata/sf0.01"


def least_of_both(one, other, ids):
    """Least id of each component of two partitions' links together."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for links in (one, other):
        for i, j in enumerate(links):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {ids[find(i)] for i in range(len(ids))}


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    left = {r.doc_id for r in quality.score(docs, model).collect() if r.keep}
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in now.collect()}
        now = stage(spark, now, D)
        if k == 4:
            break
        assert now.columns == docs.columns, name
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "quality":
            assert set(after) == left and len(left) < len(texts)
        elif name == "near_dedup":
            part = spark.createDataFrame(sorted(before.items()), "doc_id long, text string")
            found = {r.doc_id: r.component_id for r in simhash.near_duplicates(part).collect()}
            ids = sorted(before)
            assert set(after) == least_of_both([ids.index(found[i]) for i in ids], plain_classes([before[i] for i in ids]), ids) and len(after) < len(set(found.values()))
        elif name == "decontamination":
            part = spark.createDataFrame(sorted(before.items()), "doc_id long, text string")
            bad = {r.doc_id for r in decontaminate.contaminated(part, spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - bad and bad
        else:
            found = {r.doc_id for r in secrets.scan(spark.createDataFrame(sorted(before.items()), "doc_id long, text string")).collect() if r.spans}
            assert set(after) == set(before) and found and all(("[SECRET]" in (t or "")) == (i in found) for i, t in after.items())
        if name != "secrets":
            assert all(before[i] == t for i, t in after.items())
    rows = now.collect()
    assert {r.doc_id for r in rows} == set(after) and sum(r.length for r in rows if r.doc_id == rows[0].doc_id) == len(packing.Encoder()(after[rows[0].doc_id])) + 1


def test_run_and_odd_tables(spark, make_docs, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = make_docs([None, "", "plain text here", "plain text here", "key: token = 0123456789abcdeffedc", (None, "x")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} >= {2, None} and 3 not in {r.doc_id for r in rows}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_registry_goes_without_the_subpackage(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as entry

    real = builtins.__import__

    def gone(name, *a, **k):
        if name == "corpus_pipeline" or "wavelark.llm" in name:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a, **k)

    all_of_them = set(entry.queries())
    monkeypatch.setattr(builtins, "__import__", gone)
    few = set(importlib.reload(entry).queries())
    monkeypatch.undo()
    importlib.reload(entry)
    assert all_of_them - few == {*__import__("wavelark.llm.catalog", fromlist=["x"]).QUERIES, "pipeline"}
    with pytest.raises(KeyError):
        few.remove("pipeline")
