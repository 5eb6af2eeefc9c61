"""Sources and sinks: text, FASTA and delimited files, pattern files, limits, results."""
