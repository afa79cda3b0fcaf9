"""termloom: term-set mining, retrieval and corpus preparation as Spark DataFrame pipelines."""
