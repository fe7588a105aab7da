"""Repeat-sales price indices as Spark jobs.

Every public function takes and returns Spark DataFrames; nothing runs until the
caller acts on the result, apart from the iterative estimators, which say so.
"""

__version__ = "0.1.0"
