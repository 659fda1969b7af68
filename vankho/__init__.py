"""vankho: document collections, retrieval and document analytics as Spark DataFrame operators."""
