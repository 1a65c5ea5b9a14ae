"""millrace: analytics over scored merge answers and text corpora, written as Spark plans.

The optional subpackage ``millrace.llm`` holds the training-data operators; nothing else imports it.
"""

__version__ = "0.1.0"
