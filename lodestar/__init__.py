"""Spark-native analytics over embedding columns: exact, filtered and radius
nearest-neighbour joins, inverted-list and graph search, clustering, codecs,
evaluation, and search that calibrates how much work each query gets."""
