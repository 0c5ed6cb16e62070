import corpus_pipeline


def test_stages_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    docs.cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, sf).cache()
        if name != "tokens":
            assert kept.columns == docs.columns
            assert 0 < kept.count() <= docs.count()
            assert kept.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
            docs = kept
    assert kept.count() == docs.count() and kept.where("not lossless").count() == 0
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [r.text for r in benchmark.collect()]
    assert not any(i in r.text for r in docs.collect() for i in items)


def test_null_and_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "a b c d e f", "en", None, 11), (4, "a b c d e f", None, "s", 11), (4, "a b c d e f", None, "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() >= 1 and (name == "tokens" or out.columns == docs.columns)
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_one_row_of_each_repeated_document_stays(spark):
    rows = [(1, "a b c d e f"), (1, "A b  c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"), (None, None), (None, ""), (3, "x"), (3, "x"), (4, "other words of that one"), (4, "quite another text of this id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    got = sorted(map(tuple, kept.collect()), key=str)
    assert got == sorted([(1, "A b  c d e f"), (None, "g h i j k l"), (None, None), (None, ""), (3, "x"), (4, "other words of that one"), (4, "quite another text of this id")], key=str)
