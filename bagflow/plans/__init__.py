"""Running actions, what they measure, and the queries of the library."""
