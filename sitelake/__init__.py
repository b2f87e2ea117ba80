"""sitelake: a Spark-first engine that turns fetched web pages and source trees into clean corpora."""

__version__ = "0.1.0"
