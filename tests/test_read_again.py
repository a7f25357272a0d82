"""Tables that are read more than once are made once."""

from waymark.plans import registry, training


def test_segment_table_of_the_folds_is_made_once(spark, monkeypatch):
    """Each scan of the folds reads files: no window or exchange of the samples is in its plan."""
    plans = []
    fit = training.training.ridge_folds

    def seen(rows, *args, **kwargs):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return fit(rows, *args, **kwargs)

    monkeypatch.setattr(training.training, "ridge_folds", seen)
    assert registry.QUERIES["q_ridge_folds"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 1 and "parquet" in plans[0].lower() and "Window" not in plans[0] and "Exchange" not in plans[0]
