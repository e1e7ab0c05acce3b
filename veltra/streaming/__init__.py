"""Streams into key-value stores, and the policy of their rate."""
