"""synthkit: infer, synthesise and validate tabular data on Spark.

All work is expressed as DataFrame / SQL / Structured Streaming plans so that
Catalyst and AQE choose the physical strategy.  Sub-packages:

* ``sources``   – readers and sinks (files, exports, JDBC/vendor option wrappers)
* ``functions`` – Column-expression helpers (hash uniforms, normal CDF, text)
* ``operators`` – row operations, sampling, profiling, synthesis, rules, validation
* ``plans``     – the spec format and the end-to-end infer → synthesise → validate flow
* ``streaming`` – windowed profiles, sessions, dedup, drift and PII on streams
"""

from synthkit.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
