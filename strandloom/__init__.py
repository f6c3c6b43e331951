"""strandloom: a PySpark-native engine for ab initio gene finding.

Every step is a ``DataFrame -> DataFrame`` builder; see README.md.
"""

__version__ = "0.1.0"
