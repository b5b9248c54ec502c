"""postmill: a Spark-first engine for certified-mail archives and the text inside them."""

__version__ = "0.1.0"
