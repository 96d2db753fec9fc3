from spanloom.plans.config import load
from spanloom.streaming import build_stream


def test_micro_batches(spark, tmp_path):
    schema = "doc_id string, text string, words array<struct<text:string,start:bigint,end:bigint>>"
    for i in range(2):
        spoken = [(w, n * 100, n * 100 + 90) for n, w in enumerate("remarkable water flows downhill".split())]
        spark.createDataFrame([(f"d{i}", "Remarkable water flows downhill.", spoken)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}

    def sink(made, number):
        for r in made.spans.collect():
            seen[r.doc_id] = (number, r.method)

    config = load(alignment={"method": "fuzzy", "min_accept": 0.82, "warn_accept": 0.75})
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = build_stream(stream, sink, config).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert {k: v[1] for k, v in seen.items()} == {"d0": "fuzzy", "d1": "fuzzy"} and len({v[0] for v in seen.values()}) == 2
