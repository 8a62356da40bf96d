"""docloom: document retrieval and literature analytics on Apache Spark."""
