"""Listing-price pipeline on Spark DataFrames: cleaning, brands, text features, models, blending."""
