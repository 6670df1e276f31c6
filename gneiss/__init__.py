"""gneiss: Spark-native analytics for labelled point, graph and raster data."""

__version__ = "0.1.0"
