"""The queries of kernels and checks are registered, each with SQL; ``test_queries`` runs them like all others."""

from glossa.plans import catalogue, kernels


def test_every_kernel_query_has_sql():
    names = [k for k, f in catalogue.QUERIES.items() if f.__module__ == kernels.__name__]
    assert len(names) > 35 and all(catalogue.ORACLES.get(k) for k in names)
