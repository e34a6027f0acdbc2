"""A Spark-native URL rule filter, with training-data operators beside it in `llm`."""
