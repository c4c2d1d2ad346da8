"""Composed plans: marts, insights, evaluation, portfolio, reports, health."""
