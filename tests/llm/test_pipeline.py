import random

import corpus_pipeline
from duewise.llm import bpe, jaccard, lines, mixing, toxicity


def fixture(spark, path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeimnor") for _ in range(rng.randint(2, 7)))
    docs = []
    for i in range(240):
        text = "\n".join(" ".join(word() for _ in range(rng.randint(8, 20))) for _ in range(4))
        if i % 6 == 0:
            text += "\nyou idiot moron, stupid scum " + word()
        docs.append([i, text, "en", f"src{i % 4}", len(text)])
    for i in range(240, 280):
        base = docs[rng.randrange(1, 100)][1].split(" ")
        base[rng.randrange(len(base))] = word()
        text = " ".join(base)
        docs.append([i, text, None, "src1", len(text)])
    docs += [[300, None, None, None, None], [301, "", "en", "src1", 0]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_stages_act_one_after_another(spark, tmp_path):
    docs = fixture(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        frame = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen.append(frame)
        if name != "bpe":
            assert frame.columns == corpus_pipeline.COLUMNS
    toxic, deduped, single, mixed, encoded = seen
    left = {r["doc_id"] for r in toxic.collect()}
    assert not {i for i in left if i < 240 and i % 6 == 0} and {i for i in range(240) if i % 6} | {300, 301} <= left
    cut = lines.dedup(toxic).collect()
    emptied = {r["doc_id"] for r in cut if r["n_dropped"] and not r["text"].strip()}
    assert emptied and {r["doc_id"] for r in deduped.collect()} == {r["doc_id"] for r in cut} - emptied
    again = lines.dedup(deduped.select("doc_id", "text"))
    assert again.filter("n_dropped > 0").count() == 0 or again.agg({"n_dropped": "sum"}).first()[0] < 5
    rows, _ = jaccard.join(deduped.select("doc_id", "text"))
    want = {r["doc_id"] for r in rows.collect() if r["doc_id"] == r["component_id"]}
    assert {r["doc_id"] for r in single.collect()} == want
    sizes = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(single).collect()}
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert all(times.get(i, 0) == (1 if not n else int(taken / n + 0.5)) for i, (n, taken) in sizes.items())
    vocabulary = bpe.Vocabulary(bpe.vocabulary_path())
    plain = bpe.Codec(vocabulary, bpe.Lexicon.mapped(bpe.Lexicon.build({})))
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in encoded.collect():
        assert " ".join(map(str, r["token_ids"])) == plain.text(text[r["doc_id"]])[1]
    assert encoded.count() == mixed.count()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["token_ids"]) for r in whole.collect()) == sorted((r["doc_id"], r["token_ids"]) for r in encoded.collect())
    assert len(docs) > whole.select("doc_id").distinct().count() and toxicity.THRESHOLD == 0.7


def test_missing_and_repeated_ids_and_empty_tables(spark, tmp_path):
    docs = fixture(spark, tmp_path)
    text = lambda k: "\n".join(" ".join(f"w{k}x{j}y{i}" for i in range(12)) for j in range(3))
    rows = [(None, text(1), "en", "a", 1, 5), (None, text(2), "en", "a", 1, 5), (7, text(3), None, None, 1, 5), (7, text(4), "en", "a", 1, 5), (7, text(4), "en", "a", 1, 5), (9, None, None, None, None, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int")
    for _, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, str(tmp_path))
    got = sorted((repr(r["doc_id"]), r["text"] or "") for r in frame.collect())
    assert got == sorted([("None", text(1)), ("None", text(2)), ("7", text(3)), ("7", text(4)), ("9", "")]) and docs
    copies = spark.createDataFrame([(k, text(5), "en", "a", 1) for k in (None, 4, 3, 4)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, copies, str(tmp_path)).collect()] == [3]
    empty = frame.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
        empty = empty if "text" in empty.columns else None


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    """Long texts don't come to Python 10,000 at a time; a session's own smaller bound stays."""
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    fixture(spark, tmp_path)
    docs = spark.range(1500, numPartitions=1).selectExpr("id as doc_id", "repeat('some words ', 900) as text", "'en' as lang", "'s' as source", "9900L as n_chars")

    def largest(batches):
        yield pa.RecordBatch.from_pydict({"b": [max(b.nbytes for b in batches)]})

    try:
        spark.conf.unset(name)
        corpus_pipeline.toxic(spark, docs, str(tmp_path))
        assert docs.mapInArrow(largest, "b long").first()["b"] < 2 * corpus_pipeline.BATCH_BYTES
        spark.conf.set(name, "100000")
        corpus_pipeline.encoded(spark, docs, str(tmp_path))
        assert spark.conf.get(name) == "100000"
    finally:
        spark.conf.unset(name)
