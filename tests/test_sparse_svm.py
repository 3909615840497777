"""M2 second phase: the proximal-gradient solution satisfies the L1 optimality conditions."""

import numpy as np

from rarebird.operators.profile import assemble, class_weights
from rarebird.plans.sparse_svm import fit_sparse_svm
from rarebird.spec import TableSpec


def test_kkt_conditions(spark, ev_small):
    spec = TableSpec("event_id", "learn", ("value", "hr", "k", "usr_value"), ())
    from rarebird.operators import scaling

    scaled, _ = scaling.fit_apply_scaler(ev_small, spec)
    data = assemble(class_weights(scaled, spec), spec, keep=["weight"])
    C = 0.05
    m = fit_sparse_svm(data, "learn", "weight", 4, C, max_iter=3000, tol=1e-6)
    pdf = scaled.join(class_weights(scaled, spec).select("event_id", "weight"), "event_id").toPandas()
    X = np.column_stack([pdf[c].values for c in spec.numerics] + [np.ones(len(pdf))])
    s = 2 * pdf.learn.values - 1
    beta = np.append(m.coefficients, m.intercept)
    slack = np.maximum(0, 1 - s * (X @ beta))
    grad = C * (-2 * (pdf.weight.values * s * slack) @ X)
    for j in range(5):
        if beta[j] != 0:
            assert abs(grad[j] + np.sign(beta[j])) < 2e-2
        else:
            assert abs(grad[j]) <= 1 + 2e-2


def test_l2_gradient_is_zero_and_differs_from_l1(spark, ev_small):
    from rarebird.operators import scaling

    spec = TableSpec("event_id", "learn", ("value", "hr", "k", "usr_value"), ())
    scaled, _ = scaling.fit_apply_scaler(ev_small, spec)
    data = assemble(class_weights(scaled, spec), spec, keep=["weight"])
    m = fit_sparse_svm(data, "learn", "weight", 4, 0.05, max_iter=250, tol=1e-6, penalty="l2")
    pdf = class_weights(scaled, spec).toPandas()
    X = np.column_stack([pdf[c].values for c in spec.numerics] + [np.ones(len(pdf))])
    s = 2 * pdf.learn.values - 1
    beta = np.append(m.coefficients, m.intercept)
    grad = beta + 0.05 * (-2 * (pdf.weight.values * s * np.maximum(0, 1 - s * (X @ beta))) @ X)
    assert np.abs(grad).max() < 2e-2


def test_parameters_are_not_ignored(spark, ev_small):
    import pytest

    from rarebird.plans import models as mo

    spec = TableSpec("event_id", "learn", ("value", "hr"), ())
    with pytest.raises(ValueError, match="max_leaf_nodes"):
        mo.fit(ev_small, spec, mo.TREE.with_params(max_leaf_nodes=2))
    with pytest.raises(ValueError, match="penalty"):
        mo.fit(ev_small, spec, mo.LINEAR_SVM.with_params(penalty="l1", loss="hinge"))
