"""The boundary to models outside Spark: protocols, offline stand-ins, retry rules, UDF wrappers."""
