"""The corpus pipeline on a small fixture: what each stage must keep and drop."""

import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from thalweg.llm import exact_dedup, secrets, simhash, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    return " ".join(hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[:7] for i in range(n))


def shingles(text):
    own = (text or "").lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, words(i, 60), "en", "s", 479) for i in range(40)]
    rows += [(100 + i, f"you vile slime {words(i + 500, 20)}", "en", "s", 0) for i in range(40)]
    rows += [(200, words(1, 60), "en", "s", 479), (201, None, None, None, None), (202, "", "", "", 0), (203, "password = hunter2hunter2 " + words(7000, 50), "en", "s", 1)]
    rows += [(204, words(2, 600) + " x", "en", "s", 1), (205, words(2, 600), "en", "s", 1), (200, words(1, 60), "en", "s", 479)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_keep_and_drop(spark, sf_dir, tmp_path):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: sorted(r.doc_id for r in rows) for name, rows in kept.items()}
    assert ids["toxicity"] == sorted([*range(40), 200, 200, 201, 202, 203, 204, 205])
    texts = {}
    for r in kept["toxicity"]:
        texts.setdefault(r.text or "", []).append(r.doc_id)
    assert ids["exact_dedup"] == sorted(map(max, texts.values()))
    sets = {r.doc_id: shingles(r.text) for r in kept["exact_dedup"]}
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    assert group[205] == 204
    assert ids["simhash_dedup"] == sorted(set(group.values()))
    assert ids["secret_scan"] == ids["simhash_dedup"]
    masked = {r.doc_id: r for r in kept["secret_scan"]}
    assert "hunter2" not in masked[203].text and "[SECRET]" in masked[203].text and masked[203].n_chars == len(masked[203].text)
    assert masked[3].text == words(3, 60) and masked[3].n_chars == 479
    assert {r.doc_id for r in kept["packing"]} == set(ids["secret_scan"])


def test_columns_that_clash_stay(spark):
    schema = "doc_id long, text string, _k1 string, key0 string, KEY1 int, secret_spans string, count long, score string, n_chars long"
    rows = [(1, "a b c", "x", "y", 1, "s", 5, "z", 5), (2, "a b c", "x", "y", 2, "s", 5, "z", 5), (2, "a b c", "x", "y", 2, "s", 5, "z", 5), (3, "secret: abcdefgh12", "x", "y", 3, "keep", 5, "z", 18), (None, None, None, None, None, None, None, None, None)]
    some = spark.createDataFrame(rows, schema)
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mask_secrets):
        out = stage(spark, some, "")
        assert out.columns == some.columns
        by = {r.doc_id: r for r in out.collect()}
        assert by[3].secret_spans == "keep" and by[3].key0 == "y" and by[3].KEY1 == 3 and by[None].text is None
        if stage is corpus_pipeline.drop_copies:
            assert sorted(by, key=str) == [2, 3, None]
    np = __import__("numpy")
    model = toxicity.fit([], [], [], np.zeros(0, bool), np.zeros(0, int))
    assert toxicity.reject(some, model, threshold=0.6).columns == some.columns


def test_empty_tables_run_through(spark, sf_dir, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_operators_take_clashing_columns_and_no_rows(spark):
    schema = "doc_id long, text string, _k1 string, row_no string, fp string, digest string"
    some = spark.createDataFrame([(1, "a b c", "x", "x", "x", "x"), (2, "a b c", "x", "x", "x", "x"), (None, None, None, None, None, None)], schema)
    assert sorted(r.doc_id or 0 for r in exact_dedup.exact_dedup(some).filter("kept").collect()) == [0, 2]
    assert len({r.component_id for r in simhash.near_duplicates(simhash.fingerprints(some)).collect()}) == 2
    none = some.limit(0)
    np = __import__("numpy")
    model = toxicity.fit([], [], [], np.zeros(0, bool), np.zeros(0, int))
    assert exact_dedup.drop_copies(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0
    assert toxicity.score(none, model).count() == 0 and secrets.scan(none).count() == 0


def test_batches_are_bounded_and_smaller_settings_stay(spark):
    import pyarrow as pa

    from thalweg.llm.common import BATCH_BYTES, BATCH_ROWS, small_batches

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    kept = [spark.conf.get(n) for n in names]
    try:
        for own, inside in ((("10000", "64m"), (BATCH_ROWS, BATCH_BYTES)), (("0", "1g"), (BATCH_ROWS, BATCH_BYTES)), (("7", "1m"), ("7", "1m"))):
            for n, x in zip(names, own, strict=True):
                spark.conf.set(n, x)
            with small_batches(spark):
                rows = spark.range(3000).repartition(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
                assert [size_text(spark.conf.get(n)) for n in names] == [size_text(x) for x in inside]
            assert max(r.n for r in rows) <= int(inside[0])
            assert [size_text(spark.conf.get(n)) for n in names] == [size_text(x) for x in own]
    finally:
        for n, x in zip(names, kept, strict=True):
            spark.conf.set(n, x)


def size_text(x):
    from thalweg.llm.common import size_of

    return size_of(str(x))


def test_parts_of_a_batch_hold_every_text():
    import pyarrow as pa

    from thalweg.llm.bpe import in_parts

    texts = ["", "ä" * 50, "x" * 300, "", "y", "z" * 90, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    parts = list(in_parts(batch, 100))
    assert [t for _, own in parts for t in own] == texts and [i for ids, _ in parts for i in ids.to_pylist()] == list(range(7))
    assert [len(own) for _, own in parts] == [3, 4] and not list(in_parts(batch.slice(0, 0)))
