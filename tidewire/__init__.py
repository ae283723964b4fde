"""Spark jobs over news signals, rumours, evidence and forecasts."""
