"""Operators: KPIs, content, audience, pairs, recommendations, models, forecast, feeds."""
