"""Recurring jobs: batch functions and their micro-batch adapter."""
