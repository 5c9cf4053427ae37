"""Part of meshweave."""
