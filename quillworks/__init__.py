"""quillworks: DataFrame operators for a content workflow on Apache Spark."""
