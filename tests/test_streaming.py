from quadloom import fixtures as fx
from quadloom.plans.render import import_features
from quadloom.streaming import importer

SF = "/root/testdata/sf0.001"


def test_streamed_store_equals_the_batch_one(spark, tmp_path):
    features = fx.features(spark, SF)
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    features.where("id % 2 = 0").write.parquet(source)
    features.where("id % 2 = 1").write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 4).parquet(source)
    query = importer.start(stream, store, str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination(240)
    assert query.exception() is None
    key = ["id", "layer", "geom_type", "cell_x", "cell_y"]
    got = sorted(map(tuple, spark.read.parquet(store).select(*key).collect()))
    assert got == sorted(map(tuple, import_features(features).select(*key).collect()))
