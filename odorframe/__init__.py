"""Labelled multichannel sensor sequences on Spark DataFrames."""
