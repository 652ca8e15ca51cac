"""prismora: a Spark-first engine for reflectance-spectrum libraries."""

__version__ = "0.1.0"
