"""Governed analytics over business tables, written for Spark."""
