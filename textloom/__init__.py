"""Text and embedding analytics as composable ``DataFrame -> DataFrame`` operators."""

__version__ = "0.1.0"
