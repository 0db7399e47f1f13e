"""Message analytics on Spark DataFrames.

`plans.engine.Engine` is the way in: it registers tables of messages under a connection's name and
answers listing, recent, search, fetch, delete, move, classification and analysis requests.
"""
