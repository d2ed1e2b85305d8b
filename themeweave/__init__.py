"""themeweave: Spark-native analysis of thematic text corpora.

Layers: ``sources`` (reading and writing), ``functions`` (Column -> Column),
``operators`` (DataFrame -> DataFrame), ``plans`` (named queries over the test
tables with their SQL oracles) and ``streaming``.
"""

__version__ = "0.1.0"
