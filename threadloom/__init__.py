"""Analysis of opinion texts on Spark: DataFrame operators for threads, articles, search, labels and streams."""
