"""heddle: text retrieval, corpus analytics and incremental crawling on PySpark DataFrames."""
