"""Folders of the given tables, importable whatever other test folders are collected."""

SF = "/root/testdata/sf0.01"
SF_TINY = "/root/testdata/sf0.001"
