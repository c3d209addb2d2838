"""quotelens: a Spark-native quotation detection and text alignment engine."""
