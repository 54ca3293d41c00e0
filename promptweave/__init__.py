"""Spark jobs that turn model-comparison logs into labelled, featurised prompts."""
