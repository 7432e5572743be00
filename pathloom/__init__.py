"""pathloom: Spark-first analytics over biological pathway graphs and text corpora."""
