"""lattica: Spark-first analytics for signals measured over ordered positions, with the
data-quality and key-handling operators that large data pipelines need."""

__version__ = "0.1.0"
