"""Video streams as tables: Spark-first demuxing, stream analytics and coding."""
