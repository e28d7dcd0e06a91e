"""Panel, survey and series statistics as Spark DataFrame transformations."""
