"""Training-data operators: PII, dedup, packing, token files, toxicity, mixing, search, language ID.

Nothing outside this subpackage imports it.  ``queries`` registers one query per operator.
"""


def register(queries: dict, oracle: dict) -> None:
    """Add the operators' queries and their SQL to the two registries."""
    from . import queries as q

    import corpus_pipeline

    queries.update(q.QUERIES)
    oracle.update(q.ORACLE)
    queries["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        oracle["pipeline"] = corpus_pipeline.ORACLE_SQL
