"""ledgerleaf: a PySpark-native engine for paged documents.

Layout elements, sections, chunks, vectors and question answering are expressed as DataFrame and Column
operations. Sub-packages: ``sources`` (tables, stores, ingestion), ``functions`` (Column functions),
``operators`` (DataFrame to DataFrame), ``plans`` (named queries with their SQL), ``streaming``.
"""

__version__ = "0.1.0"
