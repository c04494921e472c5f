"""runledger: analytics over program-verification runs, expressed as Spark plans."""
