"""Column expressions (JVM-side, codegen'd): no Python UDFs.

UDF surface of the reference, re-expressed: row lambdas (X1) are these
column expressions; the custom non-null-count aggregate (X3) is ``count``;
group apply (X4) is a window or a ``min_by``/``collect_list`` aggregate; there
is no UDTF (X5) in the reference and none here. The batch scorer hook (X2)
is ``operators.prep.batch_score`` (``mapInPandas``).
"""
