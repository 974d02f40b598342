"""A Spark-native analytics engine: data-frame verbs with reasoned missing values, SQL, statistics and models."""
