"""Registered queries: fixtures, governed SQL and one plan per operator."""
