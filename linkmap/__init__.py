"""Set-similarity and graph analysis of fingerprinted sequences on Spark."""
