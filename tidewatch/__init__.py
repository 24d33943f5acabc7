"""tidewatch: malicious-URL analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
built-in expressions, joins, aggregates and windows.  The package layout:

- ``functions``  Column builders (lexical features, entropy, probability vectors)
- ``sources``    table readers/writers, public-suffix rule table, test tables
- ``operators``  relational operators (cleaning, splits, suffix join, reputation,
                 graph propagation, guard rules, fusion, metrics, models)
- ``plans``      jobs that chain operators (feature job, legacy graph job,
                 batch scoring, evaluation)
- ``streaming``  Structured Streaming scoring
"""

__version__ = "0.1.0"
