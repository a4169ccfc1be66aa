"""Spark-native analytics over posts and comments of many communities.

Every operator is a function from DataFrame to DataFrame with column names as
parameters. Layers:

``schemas``     explicit StructTypes of the stage inputs
``sources``     archives, word lists, table stores
``functions``   column expressions and the few helpers that keep plans bounded
``operators``   filters, joins, aggregates, ranking, similarity, graphs, density
``plans``       whole stages composed of operators
``streaming``   the same filters on Structured Streaming
``catalog``     named queries over the test tables with their SQL oracles
"""
