"""Operators on interval, alignment and variant tables."""
