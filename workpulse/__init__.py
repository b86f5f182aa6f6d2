"""Process and workload reporting on Spark DataFrames.

``sources`` read landed files, ``functions`` clean single columns, ``operators`` filter, group and rank
any frame, ``plans`` hold the four reports, ``checks`` bind them to the test tables.
"""
