"""Subtitle and corpus analytics on Spark DataFrames."""
