"""The boosting presets run all of their rounds, and the recursive SQL text grows the learner's trees."""

from __future__ import annotations

import duckdb
import numpy as np

import catalog.learning as learning
from catalog.tree_sql import boosting_sql, looped_boosting_sql
from labelweave.learning import models


def test_presets_run_all_of_their_rounds(spark, monkeypatch):
    rounds = {}
    one = spark.createDataFrame([("a", 0, 0, 1.0, 0.0)], "key string, y_true int, y_pred int, p0 double, p1 double")
    monkeypatch.setattr(learning, "matrix", lambda *a: None)
    monkeypatch.setattr(learning, "_scored", lambda df, model, params: rounds.update({model: models.job_spec(model, params).n_trees}) or one)
    assert learning.train_gbt_presets(spark, "").count() == 3
    assert rounds == {name: models.BOOSTING[name].rounds[1] for name in rounds} == {"histogram_gradient_boosting": 100, "xgboost": 100, "catboost": 1000}


def test_looped_sql_grows_the_trees_of_the_unrolled_one():
    random = np.random.default_rng(3)
    x = np.round(random.normal(size=(90, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int)
    db = duckdb.connect()
    db.execute("CREATE TABLE t (key VARCHAR, features DOUBLE[], label INT)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(f"k{i}", x[i].tolist(), int(y[i])) for i in range(90)])
    for given in ({"depth": 3, "rate": 0.3, "l2": 1.0, "hessian": 1.0}, {"depth": 2, "rate": 0.1, "leaf": 9}):
        found = [sorted(db.sql(sql).fetchall()) for sql in (boosting_sql("SELECT * FROM t", rounds=3, **given), looped_boosting_sql("SELECT * FROM t", 3, **given))]
        assert len(found[0]) == 18 and found[0] == found[1]
