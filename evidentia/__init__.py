"""Evidence-fusion analytics as PySpark DataFrame transforms."""
