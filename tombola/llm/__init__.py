"""Operators of a training-data pipeline over documents, pages and vectors.

Nothing outside this folder (but corpus_pipeline.py and the guarded lookup in
__spark_entry__.py) imports it.
"""
