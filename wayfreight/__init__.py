"""Assess, rewrite and provision large estates of warehouse-hosted data apps with Spark."""
