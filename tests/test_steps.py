import pytest

from voxelmill import steps


def test_chains_check_names_and_parameters_and_keep_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, -1.0, 0.0, 0.0)], "frame_id long, x double, y double, z double")
    run = steps.resolve([{"step": "keep_where", "condition": "x > 0"}, {"step": "rot_scale_trans", "seed": 3, "turn": (0, 0), "scale": (2, 2), "shift": 0.0}])
    assert [tuple(r) for r in run(df).collect()] == [(1, 2.0, 4.0, 6.0)]
    with pytest.raises(KeyError, match="no step named"):
        steps.resolve([{"step": "missing"}])
    with pytest.raises(ValueError, match="twice"):
        steps.step("flip")(lambda df: df)


def test_epochs_draw_anew(spark):
    df = spark.createDataFrame([(k, 1.0, 2.0, 3.0) for k in range(5)], "frame_id long, x double, y double, z double")
    outs = [steps.resolve([{"step": "rot_scale_trans", "seed": 3, "turn": (-1, 1), "scale": (0.9, 1.1), "shift": 0.1, "epoch": e}])(df).collect() for e in (0, 1, 0)]
    assert outs[0] == outs[2] != outs[1]


def test_with_columns_replaces(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert steps.with_columns(df, b="a + 1", d="a").first().asDict() == {"a": 1, "b": 2, "d": 1}
