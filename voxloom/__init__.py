"""Spark-native analytics for speech corpora: manifests, transcripts, hypotheses and frames as DataFrames."""
