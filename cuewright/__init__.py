"""cuewright: time-based media analytics as PySpark DataFrame operators."""
