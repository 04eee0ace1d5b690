"""cubelens: Spark-native analytics for evaluating text-classification outputs over an experimental cube."""
