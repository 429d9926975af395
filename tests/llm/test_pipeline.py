import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_every_stage_is_written_and_reread(spark, monkeypatch):
    read = []

    def stage(name):
        def apply(spark, docs, sf_dir):
            read.append(docs.inputFiles())
            return docs.filter("doc_id % 5 != 0") if name == "b" else docs

        return name, apply

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c")])
    out = corpus_pipeline.run(spark, SF)
    assert [{f.split("/")[-2] for f in files} for files in [*read[1:], out.inputFiles()]] == [{"a"}, {"b"}, {"c"}]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.schema == docs.schema and out.count() == docs.filter("doc_id % 5 != 0").count() > 0
