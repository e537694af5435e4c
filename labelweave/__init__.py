"""Label, network and classification analytics as Spark DataFrame operators."""
