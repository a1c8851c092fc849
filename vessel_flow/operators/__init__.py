"""Pipeline operators: DataFrame -> DataFrame functions built on windows,
joins and aggregations."""
