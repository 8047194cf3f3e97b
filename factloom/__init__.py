"""factloom: knowledge-graph fact checking and training-data preparation as Spark DataFrame operators."""
