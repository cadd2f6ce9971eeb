"""Booking corpus analytics as Spark DataFrame jobs."""
