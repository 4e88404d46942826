"""Hydrologic and erosion-risk analytics of road-stream crossings on Spark DataFrames."""
