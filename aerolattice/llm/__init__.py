"""Operators of a training-data pipeline: text cleaning, de-duplication, mixing and tokenisation."""
