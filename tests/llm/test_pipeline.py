import hashlib

import numpy as np

import corpus_pipeline
from wireloom.llm.common import read

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage keeps the columns, works on what came before, and the last one encodes what is left."""
    from tokenizers import Tokenizer

    from wireloom.llm import bpe, decontam, neardup, toxicity
    docs = read(spark, DATA, "documents")
    columns, kept = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        new = spark.read.parquet(f"{tmp_path}/{i}")
        n = new.count()
        if name == "toxicity":
            bad = toxicity.toxicity(docs, read(spark, DATA, "labels")).filter("predicted = 1").count()
            assert n == kept - bad
        elif name == "near_duplicates":
            assert n == neardup.near_duplicates(docs).select("class_id").distinct().count()
        elif name == "decontamination":
            assert n == kept - decontam.contamination(docs, read(spark, DATA, "benchmark")).filter("contaminated").count()
        else:
            assert n == kept
        if name != "bpe":
            assert new.columns == columns
            docs, kept = new, n
    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in new.collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
