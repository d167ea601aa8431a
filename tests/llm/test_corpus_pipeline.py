"""The pipeline's stages on a small table, one after the other."""

import pandas as pd


def test_stages(spark, tmp_path):
    import corpus_pipeline as c

    rows = []
    for i in range(260):
        toxic = i % 5 == 0
        words = [f"n{(i * 37 + k * k) % 997}x{(i + k) % 89}" for k in range(30)] + (["idiot", "scum"] if toxic else [])
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
    rows += [(1000 + i, rows[1][1] + " tail", "en", "s1", 0) for i in range(4)]
    rows += [(2000, 'plain words here token = "0123456789abcdef0123456789abcdef01234567" and more of them', "en", "s2", 0), (2001, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = pd.DataFrame({"doc_id": range(260), "quality": 1, "toxic": [int(i % 5 == 0) for i in range(260)]})
    spark.createDataFrame(labels).write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in c.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.toPandas()
    assert [len(x.columns) for x in list(seen.values())[:-1]] == [5] * 4
    kept = set(seen["toxicity"].doc_id)
    assert not kept & set(range(0, 260, 5)) and kept >= {i for i in range(260) if i % 5} | {2000, 2001}
    one = set(seen["ngram_jaccard_join"].doc_id)
    assert 1 in one and not one & {1000, 1001, 1002, 1003}
    masked = seen["secret_scans"].set_index("doc_id").text
    assert "0123456789abcdef" not in masked[2000] and len(seen["secret_scans"]) == len(one)
    assert seen["mixing"].doc_id.value_counts().max() <= 2
    assert (seen["bpe"].ids.map(len) == 4 * seen["bpe"].n_tokens).all()
    assert c.run(spark, str(tmp_path)).count() == len(seen["bpe"])
