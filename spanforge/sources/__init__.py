"""Readers: tables of a data folder and the text and block formats."""
