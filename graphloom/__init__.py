"""Weighted similarity graphs over named entities, as Spark DataFrame operators."""
