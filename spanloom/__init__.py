"""A Spark-first engine that aligns texts with word-level time stamps over whole corpora."""
