"""A Spark-native engine for MPEG-audio bitstreams and block-transform signals."""
