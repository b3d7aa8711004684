"""plumbline: canonical strings and content hashes of supply-chain visibility events, as Spark plans."""

__version__ = "0.1.0"
