"""Folders of the given tables that the tests read."""

SF_SMALL = "/root/testdata/sf0.001"
SF_TEST = "/root/testdata/sf0.01"
