"""Support-forum analytics as Spark DataFrame transformations."""
