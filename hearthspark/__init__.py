"""Household-and-resident registry analytics written for Spark DataFrames."""
