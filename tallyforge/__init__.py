"""Event analytics and text-corpus preparation as Spark DataFrame operators."""
