"""glyphsieve: LIKE-pattern analytics over text corpora, expressed as Spark plans."""

__version__ = "0.1.0"
