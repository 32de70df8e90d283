"""Spark-native analytics over mailbox archives: catalog events, ledgers, folder trees, packing and record repair."""
