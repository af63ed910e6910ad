"""Conversation analytics and corpus preparation on Spark."""
