"""The request interface, and the queries that the driver compares with SQL."""
