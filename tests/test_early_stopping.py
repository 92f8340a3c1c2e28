"""Boosting that stops early, and classes that are texts."""

import math
import random

import pytest

from cohortry.operators import models as M


def test_noise_stops_early_and_signal_goes_on(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random() < 0.5) for i in range(300)]
    frame = spark.createDataFrame([(i, x, float(rng.random()), 3 * math.sin(20 * x)) for i, x, _ in rows], "id int, x double, noise double, signal double")
    used = lambda target, **more: M.trees_used(M.train(frame, target, "regression", ["x"], **{"trees": 12, "depth": 4} | more))
    held = {"hold_out": 0.3, "id_col": "id"}
    assert used("noise") == [12] and used("noise", **held)[0] < 6
    assert used("signal", depth=2, **held)[0] > used("noise", depth=2, **held)[0]
    with pytest.raises(ValueError, match="id_col"):
        used("noise", hold_out=0.3)


def test_text_classes_come_back(spark, tmp_path):
    rng = random.Random(2)
    frame = spark.createDataFrame([(i, x := rng.random(), "ab"[x > 0.5], ["low", "mid", "top"][int(x * 3)] if i % 9 else None) for i in range(200)], "id int, x double, two string, three string")
    for target, kind in (("two", "binary"), ("three", "multi")):
        model = M.train(frame, target, kind, ["x"], trees=3, depth=2, hold_out=0.2, id_col="id")
        model.write().overwrite().save(str(tmp_path / target))
        back = M.PipelineModel.load(str(tmp_path / target))
        got = M.predict(back, frame.drop(target), kind, ["x"]).join(frame.select("id", target), "id").where(f"{target} is not null").collect()
        assert sum(r["xgb_prediction"] == r[target] for r in got) > 0.95 * len(got)
        assert len(M.trees_used(model)) == (1 if kind == "binary" else 3)
