"""Views over the given tables and the registry of queries with their SQL checks."""


def load():
    """All registered queries and their SQL checks."""
    from pyspark import cloudpickle

    import stockweave
    from stockweave.plans import (  # noqa: F401
        catalog_queries, event_queries, fusion_queries, gap_queries, graph_queries, member_queries, registry, source_queries, stock_queries)

    # Python functions travel to the workers by value, so the package need not be installed there.
    cloudpickle.register_pickle_by_value(stockweave)
    return registry.QUERIES, registry.ORACLES
