"""Amplicon-bias analytics on Spark: DataFrame -> DataFrame operators."""
