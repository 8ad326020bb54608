"""Labelled arrays, message streams, dataflow graphs and telemetry on Spark DataFrames."""
