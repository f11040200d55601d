"""stackmill: a Spark-native engine for research-source queues, bibliography imports and download history.

Every operator is a function from DataFrame to DataFrame; Catalyst plans it. Python runs only where
no built-in expression holds the semantics, and then on Arrow batches.
"""

__version__ = "0.1.0"
