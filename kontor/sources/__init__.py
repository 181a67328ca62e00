"""Readers: tables, lead files, pages, test cases, load statistics, search pages."""
