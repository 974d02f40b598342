"""Operators of a training-data pipeline over the tables documents, pages, conversations, embeddings and benchmark.

Nothing outside this package imports it. Each module holds one operator with
its general interface and the registered query that applies it to a whole
table; ``registry`` lists the queries and their SQL counterparts.
"""
