"""Running totals over a stream that is stopped and goes on."""

import json
import shutil

import pytest

from shellgraph.streaming import watch


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old)


def test_totals_go_on_after_a_restart(spark, tmp_path, rocks):
    (tmp_path / "in").mkdir()
    seen = {}

    def put(name, rows):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("run", "structure_id", "total", "matched"), r, strict=True))) for r in rows))
        shutil.move(tmp_path / f"{name}.json", tmp_path / "in" / f"{name}.json")

    def run():
        stream = spark.readStream.schema("run string, structure_id string, total long, matched long").json(f"{tmp_path}/in")
        each = lambda df, n: seen.update({r.run: tuple(r)[1:] for r in df.collect()})
        q = watch.running_totals(stream).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    put("one", [("r", "a", 10, 4), ("r", "b", 0, 0), ("s", "a", 5, 5)])
    run()
    assert seen == {"r": (2, 1, 10, 4, 40.0), "s": (1, 0, 5, 5, 100.0)}
    put("two", [("r", "c", 10, 10), ("r", "b", 20, 2)])  # b comes again
    run()
    assert seen["r"] == (3, 0, 40, 16, 40.0) and seen["s"] == (1, 0, 5, 5, 100.0)
    run()
    assert seen["r"] == (3, 0, 40, 16, 40.0)
