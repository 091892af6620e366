"""Pull-request analytics as Spark DataFrame operators.

Every public function takes DataFrames and options and returns a lazily built
DataFrame.  See README.md for the map of modules.
"""
