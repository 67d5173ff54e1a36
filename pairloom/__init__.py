"""pairloom: a Spark-native engine for listing-pair data.

Subpackages: ``sources`` (scans, sinks, schema alignment), ``functions``
(column expressions and Arrow UDFs), ``operators`` (DataFrame to DataFrame),
``plans`` (the registered queries with their SQL), ``streaming``.
"""
