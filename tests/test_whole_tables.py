from cadenza.plans import library


def test_kmeans_is_fitted_on_all_rows(spark, tmp_path, monkeypatch):
    from pyspark.ml.clustering import KMeans

    fit, seen = KMeans.fit, []
    monkeypatch.setattr(KMeans, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    df = spark.range(10_050).selectExpr("id as vec_id", "array(cast(id % 5 as float), 1f) as embedding")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = library.kmeans(spark, str(tmp_path)).collect()
    assert seen == [10_050] and sum(r.n for r in out) == 10_050


def test_clusters_and_faults_cover_every_row(spark, tmp_path):
    from cadenza.plans import records, stores

    rows = spark.range(300).selectExpr("id as vec_id", "cast(id % 2 as int) as label", "array(cast(id as float), cast(id % 7 as float)) as embedding")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = records.udf14(spark, str(tmp_path)).collect()
    assert sorted(r.vec_id for r in out) == list(range(300)) and {r.cluster for r in out} == set(range(8))
    spark.createDataFrame([(i, i) for i in (1, 2, 900, 900)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, stores.snk26(spark, str(tmp_path)).collect())) == [(900, "duplicate")]
