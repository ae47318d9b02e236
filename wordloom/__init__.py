"""wordloom: next-word analytics and table hygiene, declared on Spark DataFrames.

Importing the package does no work; every operator is a function from
DataFrames to DataFrames.
"""

__version__ = "0.1.0"
