"""shelfspark: a catalog engine written as Spark plans (see README.md)."""
