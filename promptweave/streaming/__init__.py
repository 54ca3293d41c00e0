"""The row-wise part of the feature job on streams of prompts."""
